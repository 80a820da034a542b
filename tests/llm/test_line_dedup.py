import random
from collections import Counter

from shiftlens.llm import line_dedup


def lines(tag, n):
    return [f"{tag} line number {i} with words" for i in range(n)]


def plain(rows):
    """Brute force: the first occurrence, by doc_id and place, of each repeated chunk stays."""
    where = {}
    for doc_id, text in rows:
        for a, b in line_dedup.chunks(text) if text else []:
            where.setdefault("\n".join(text.split("\n")[a:b]), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        if not text:
            out.append((doc_id, text, 0))
            continue
        all_lines, gone, seen = text.split("\n"), set(), Counter()
        for a, b in line_dedup.chunks(text):
            part = "\n".join(all_lines[a:b])
            if len(where[part]) > 1:
                seen[part] += 1
                if doc_id != min(where[part]) or seen[part] > 1:
                    gone |= set(range(a, b))
        out.append((doc_id, "\n".join(x for i, x in enumerate(all_lines) if i not in gone), len(gone)))
    return out


def test_equals_brute_force_and_finds_a_shifted_passage(spark):
    passage = lines("shared", 12)
    solo = " ".join(f"w{i}" for i in range(55))
    rows = [
        (1, "\n".join(lines("a", 3) + passage + lines("b", 4))),
        (2, "\n".join(lines("c", 7) + passage + lines("d", 1))),
        (3, "\n".join([*lines("e", 2), solo, *lines("f", 2)])),
        (4, "\n".join([solo, *lines("g", 5)])),
        (5, "\n".join(lines("h", 9) * 2)),
        (6, "one line"),
        (7, "one line"),
        (8, None),
        (9, ""),
        (10, "\n\n\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    assert got == sorted(plain(rows))
    by_id = {r[0]: r for r in got}
    assert by_id[1][1] == rows[0][1] and by_id[2][2] >= 6  # the later one loses most of the passage
    assert solo in by_id[3][1] and solo not in by_id[4][1]
    assert by_id[7] == (7, "one line", 0)


def test_clashing_columns_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc", 1, "x"), (2, "a\nb\nc", 2, "y")], "doc_id long, text string, lines_removed int, h1 string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "h1", "lines_removed"]
    assert out.count() == 2
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_a_hash_of_two_texts_removes_nothing():
    assert line_dedup.cut("a\nb\nc", [{"first": 0, "after": 2, "kept1": None, "kept2": None}]) == ("c", 2)
    assert line_dedup.cut("a\nb\na\nb", [{"first": 0, "after": 2, "kept1": 1, "kept2": 1}, {"first": 2, "after": 4, "kept1": 1, "kept2": 1}]) == ("a\nb", 2)


def weak_hash(data):
    """A real collision: the lines "left" and "right" share their hash."""
    return (7, 7) if data in (b"left", b"right") else line_dedup.hash_pair(data)


def test_lines_whose_hash_stands_for_two_texts_are_left_alone(spark):
    rows = [(1, "a\nleft\nb\nc\nd"), (2, "a\nright\nb\nc\nd"), (3, "x\nleft\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, hashed=weak_hash).collect()}
    assert got == {1: rows[0][1], 2: "a\nright", 3: rows[2][1]}  # b, c, d repeat; "a, left" is not "a, right"


def test_chunks_by_their_definition():
    long = "w " * 40
    for text, want in (("", []), ("a", []), ("a\nb", [(0, 2)]), ("a\nb\n", [(0, 2), (1, 3)]), (long, [(0, 1)]), (f"a\n{long}", [(0, 2), (1, 2)]), ("w " * 39, [])):
        assert line_dedup.chunks(text) == want


def test_columns_that_clash_keep_their_values(spark):
    names = ["__id", "__th", "__cuts", "___id", "first", "after", "a1", "keeper", "th", "l1", "a.b"]
    docs = spark.createDataFrame([(k, "p\nq\nr" if k else "p\nq\ns", *(10 * k + i for i in range(len(names)))) for k in range(3)], ["doc_id", "text", *names])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "lines_removed"]
    others = [f"`{n}`" for n in ("doc_id", *names)]
    assert sorted(map(tuple, out.select(*others).collect())) == sorted(map(tuple, docs.select(*others).collect()))
    assert {r.doc_id: r.text for r in out.collect()} == {0: "p\nq\ns", 1: "r", 2: ""}


def repeated_runs(rows):
    """Brute force over runs: the lines of every run of two or more lines that some earlier place has as well."""
    places = [(k, i) for k, (_, text) in enumerate(rows) for i in range(len(text.split("\n")))]
    texts = [text.split("\n") for _, text in rows]
    gone = set()
    for n, (k, i) in enumerate(places):
        for m, j in places[:n]:
            size = 0
            while i + size < len(texts[k]) and j + size < len(texts[m]) and texts[k][i + size] == texts[m][j + size]:
                size += 1
            if size >= 2:
                gone |= {(k, i + x) for x in range(size)}
    return [(doc_id, "\n".join(x for i, x in enumerate(texts[k]) if (k, i) not in gone)) for k, (doc_id, _) in enumerate(rows)]


def test_equals_a_search_for_repeated_runs_whatever_stands_around(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for count, words in ((2, 26), (3, 18), (4, 14), (5, 11), (6, 10), (8, 7), (10, 6)):
        for _ in range(6):
            passage = [line(words) for _ in range(count)]
            passages.append("\n".join(passage))
            for _ in range(2):
                rows.append((len(rows), "\n".join([*(line(7) for _ in range(rng.randrange(5))), *passage, *(line(7) for _ in range(rng.randrange(5)))])))
    few = [line(3) for _ in range(4)]
    rows += [(len(rows) + k, "\n".join(rng.choice(few) for _ in range(rng.randint(1, 9)))) for k in range(12)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(repeated_runs(rows))
    assert all(sum(p in t for t in got.values()) == 1 and not any(x in got[2 * k + 1] for x in p.split("\n")) for k, p in enumerate(passages))


def test_one_text_keeps_a_passage_among_null_and_repeated_ids(spark):
    passage = "\n".join(lines("shared", 6))
    for doc_id in (None, 4):
        docs = spark.createDataFrame([(doc_id, f"own {k}\n{passage}\nlast {k}") for k in range(5)], "doc_id long, text string")
        got = [r.text for r in line_dedup.dedup_lines(docs).collect()]
        assert sum(passage in t for t in got) == 1
        assert sorted(len(t.split("\n")) for t in got) == [2, 2, 2, 2, 8]
