import random
import re

from xxhash import xxh64_intdigest

from shiftlens.llm import groups, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    bits = ["a", "B", "İ", "É", "word", "\u00a0", " ", "\x0b", "\n", "\x1c", "日本"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert simhash.text_fingerprint(text) == plain_fingerprint(text), repr(text)


def test_allocation_is_least():
    cost = [[3.0, 9.0, 30.0], [1.0, 2.0, 50.0], [4.0, 5.0, 6.0]]
    total, t = simhash.allocate(cost, 1)
    assert sum(t) == 1 and total == min(sum(cost[k][x] for k, x in enumerate(c) if x >= 0) for c in [(a, b, d) for a in range(-1, 3) for b in range(-1, 3) for d in range(-1, 3)] if sum(c) == 1)


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(simhash.signed(x))
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    # a crowded part: many that agree on all bits but the last sixteen
    fps |= {simhash.signed((0xABCD << 48) | rng.getrandbits(16)) for _ in range(150)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    got = {tuple(r) for r in simhash.links(df).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and near(a, b)}
    want = plain_components(sorted(fps), near)
    roots = dict(map(tuple, groups.components(simhash.links(df)).collect()))
    assert {n: roots.get(n, n) for n in fps} == want


def test_query_edge_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (9, None), (8, ""), (None, "  "), (7, "something else altogether here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, __row int").withColumnRenamed("__row", "component")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    a, c = f"{plain_fingerprint(text):016x}", f"{plain_fingerprint(rows[-1][1]):016x}"
    assert got == sorted([(5, a, 3), (3, a, 3), (3, a, 3), (9, "0" * 16, 8), (8, "0" * 16, 8), (None, "0" * 16, 8), (7, c, 7)], key=str)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [3, 7, 8]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_columns_that_clash_keep_their_values(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    names = ["__id", "__none", "__th", "__row", "___id", "component", "th", "fp", "cls", "a.b", "node"]
    docs = spark.createDataFrame([(k, text if k < 2 else f"something else altogether {k}", *(10 * k + i for i in range(len(names)))) for k in range(4)], ["doc_id", "text", *names])
    for distance in (3, None):
        kept = simhash.keep_one(docs, 3, distance)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id != 1)


def test_one_of_wholly_repeated_rows_stays_on_either_path(spark, monkeypatch):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(12))
    rows = [(k % 7 if k % 5 else None, words(k % 9), "x" if k % 2 else "y") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = {}
    for i, text, _ in rows:
        least[text] = min(least.get(text, (True, 0)), (i is None, i or 0))
    want = sorted(((None if none else i), text) for text, (none, i) in least.items())
    for bound in (300_000, 0):
        monkeypatch.setattr(groups, "BROADCAST_ROWS", bound)
        kept = simhash.keep_one(docs, 5, 3)
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == want
