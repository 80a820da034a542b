import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from shiftlens.llm import near_copies, simhash

from .test_simhash import plain_components


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(rng):
    """Texts with copies at similarities on both sides of 0.8, and a large group of them."""
    texts = [None, "", " ", "a few words", "A few words", "another few words"]
    for group, size in [*((g, 4) for g in range(25)), ("large", 60)]:
        base = [f"{group}w{rng.randrange(900)}" for _ in range(rng.randint(8, 120) if group != 7 else 700)]
        common = "this line is in most of the texts word for word".split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words + common if rng.random() < 0.7 else words))
    return texts


def test_stage_equals_brute_force_by_shingle_similarity(spark):
    texts = corpus(random.Random(7))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [plain_set(t) for t in texts]
    roots = plain_components(range(len(texts)), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    near = [(a, b) for b in range(len(texts)) for a in range(b) if 0.8 <= similarity(sets[a], sets[b]) < 1]
    assert any((simhash.text_fingerprint(texts[a]) ^ simhash.text_fingerprint(texts[b])).bit_count() > 3 for a, b in near)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(roots.values()))


def test_edge_rows(spark):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(3, text), (3, text.upper()), (None, text), (9, None), (8, ""), (None, "alone here")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs, 5, None).collect()) == ["3", "8", "None"]
    assert simhash.keep_one(docs.limit(0), 5, None).count() == 0


def bits_apart(x, y):
    return sum(((int(a) ^ int(b)) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))


def test_sketches_bound_the_difference(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        words = [rng.choice("abc") * rng.randint(1, 9) for _ in range(rng.choice([5, 90, 300, 700, 1500]))]
        other = [w if rng.random() < 0.98 else "new" for w in words] + ["tail"] * rng.randint(0, len(words) // 5)
        a, b = (near_copies.shingle_set(" ".join(w)) for w in (words, other if k % 2 else words[::-1]))
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert bits_apart(near_copies.parity(a), near_copies.parity(b)) <= differ
        x, y = near_copies.long_parity(a), near_copies.long_parity(b)
        assert len(x) in (0, len(y), 2 * len(y), len(y) // 2) or not len(y)
        if len(x) == 2 * len(y) or len(x) and len(x) == len(y):
            folded = x[: len(y)] ^ x[len(y) :] if len(x) > len(y) else x
            assert bits_apart(folded, y) <= differ
        rows.append((k, x.tolist(), y.tolist(), len(a), len(b), 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))))
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>, n int, m int, near boolean")
    got = df.select("k", "near", "n", near_copies.long_sketches_allow(*(F.col(c) for c in "xynm")).alias("may")).collect()
    assert all(r.may for r in got if r.near) and sum(r.near for r in got) > 20
    assert not any(r.may for r in got if r.k % 2 == 0 and r.n > 600) and sum(not r.may for r in got) > 20


def test_stage_searches_fingerprints_first(spark, monkeypatch):
    rng, asked, search = random.Random(9), [], simhash.links
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(f"w{rng.randrange(900)}" for _ in range(60))]
    monkeypatch.setattr(simhash, "links", lambda fps, distance=3: asked.append((sorted(r.fp for r in fps.collect()), distance)) or search(fps, distance))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert asked == [(sorted({simhash.signed(simhash.text_fingerprint(t, 5)) for t in texts}), near_copies.DISTANCE)]


def test_candidates_by_fingerprint_join_what_is_near(spark):
    rng = random.Random(10)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in fps for _ in range(3)]
    marks = spark.createDataFrame([(k, simhash.signed(f)) for k, f in enumerate(fps)], "cls long, fp long")
    pairs = [tuple(r) for r in near_copies.by_fingerprint(marks).collect()]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    assert all(a < b and near(a, b) for a, b in pairs)
    found = set(pairs)
    assert plain_components(range(len(fps)), lambda a, b: (a, b) in found) == plain_components(range(len(fps)), near)


def test_a_first_shared_shingle_starts_every_similar_pair_and_few_others(spark):
    rng = np.random.default_rng(11)
    none, rows = np.empty(0, np.int64), []
    for k in range(300):
        n, m = (int(rng.integers(1, 400)) for _ in range(2))
        m = n if k % 3 == 0 else int(n * 1.2) if k % 3 == 1 else m
        pool = rng.integers(-(2**62), 2**62, 2 * max(n, m) + 2)
        share = int(rng.integers(0, min(n, m) + 1)) if k % 2 else int(min(n, m) * 0.95)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:share], pool[n : n + m - share]]))
        near = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
        (ta, pa), (tb, pb) = near_copies.head(a, none, none), near_copies.head(b, none, none)
        both, x, y = np.intersect1d(ta, tb, return_indices=True)
        rows += [(k, bool(near), (len(a), int(pa[i])), (len(b), int(pb[j]))) for i, j in zip(x, y, strict=True)] or [(k, bool(near), (9, 9), (9, 9))]
    df = spark.createDataFrame(rows, "k int, near boolean, x struct<n: int, place: int>, y struct<n: int, place: int>")
    got = df.groupBy("k", "near").agg(F.max(near_copies.may_start("x", "y")).alias("may"), F.count(F.lit(1)).alias("shared")).collect()
    assert sum(r.near for r in got) > 60 and all(r.may for r in got if r.near)
    assert sum(not r.may for r in got if not r.near and r.shared > 1) > 5
