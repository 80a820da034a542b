import random

from shiftlens.llm import decontaminate as d


def distance_within(pattern, text):
    """Least edits of the whole pattern against any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def items(rng, n):
    return [(i, " ".join("".join(rng.choice("abcdeést") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(14, 30)))) for i in range(n)]


def test_matches_equal_brute_force():
    rng = random.Random(6)
    bench = items(rng, 6)
    index = d.Index.parse(d.Index([(i, t, 1) for i, t in bench]).dump())
    hits = 0
    for _ in range(60):
        k = rng.randrange(len(bench))
        s = list(bench[k][1])
        for _ in range(rng.randint(0, int(index.edits[k]) + 4)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        noise = items(rng, 2)
        text = d.normalise(noise[0][1] + " " + "".join(s) + " " + noise[1][1])
        got = {i: n for i, _, _, n in index.matches(text)}
        for i, t in bench:
            best = distance_within(t, text)
            assert (got.get(i) == best) if best <= index.edits[i] else i not in got
            hits += i in got
    assert hits > 30


def test_query_edge_rows_and_blocks(spark):
    rng = random.Random(7)
    bench = [*items(rng, 5), (5, None), (6, ""), (7, "tiny"), (None, "no id for this item but a text of some length")]
    texts = [None, "", "Tiny", "x " + bench[0][1].upper() + "\n y", bench[1][1] + " " * 5 + bench[1][1], "clean words only here", "q" * 3_000_000 + " " + bench[2][1], "No id  for this\nitem but a text of some length"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, item_id int")
    bench = [*bench, bench[1]]  # a repeated row
    b = spark.createDataFrame([(*r, "z") for r in bench], "item_id long, text string, doc_id string")
    want = sorted([(4, 1, 0), (4, 1, 0), (2, 7, 0), (3, 0, 0), (3, 0, 0), (4, 1, 0), (4, 1, 0), (6, 2, 0), (7, None, 0)], key=str)
    for block in (8_000_000, 100):
        got = sorted(((r.doc_id, r.item_id, r.edits) for r in d.find_leaks(docs, b, block_chars=block).collect()), key=str)
        assert got == want
        kept = sorted(r.doc_id for r in d.drop_leaked(docs, b, block_chars=block).collect())
        assert kept == [0, 1, 5]
    assert len(d.write_index(b, block_chars=100)) > 3 and len(d.write_index(b)) == 1
    assert d.find_leaks(docs.limit(0), b).count() == 0
    assert d.find_leaks(docs, b.limit(0)).count() == 0
