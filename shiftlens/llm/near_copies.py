"""The near-dedup operator's other measure, shingle similarity: SimHash first, then an exact self-join by prefix filter.

Two texts of similarity 0.8 differ in about ten of 64 SimHash bits, which the pigeonhole
can't search for beyond a small table. So the operator's search (fingerprints of the same
shingles, within ``DISTANCE`` bits) gives the first candidates, which are decided on the
sets, and the prefix filter finds all that is left.

Texts are lower-cased in A-Z and cut into the set of their five-word shingles (a shorter
text is one shingle). Two texts are near copies if their sets' Jaccard similarity is 0.8
or more; no sketch decides, so no pair is lost.

Search: equal sets are one class. Under any one order of all shingles, two sets of the
similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of each. The order
puts shingles that a sample shows to be common last, so that the shared ones are few.
The index knows a shingle by 32 bits, which can only add candidates. Candidates have to
agree in size, and in a 256-bit parity sketch: two sketches differ in no more bits than
the sets do in shingles, so that this drops no near copy either. A long text's set differs
by more shingles than such a sketch has bits, so it has a second one with as many bits as
shingles; of two lengths the longer is folded. What is left is decided on the sets, which
are made again of the texts that are left.

Nor does a shared shingle far down both prefixes make a candidate: of two sets' first
shared shingle, the larger part of either lies behind it, 4/9 of both sizes at least.
Long texts that share no more than passages of other texts mostly fail that within the
join, which so makes no row of them.

A large group of near copies would have as many pairs as the square of its size. So
each set is first compared with the nearest fingerprints and with a dozen classes (hubs)
of each of its shingles only, and what that joins is not paired again.

Defined results: null and empty texts are one class; repeated rows share a class; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import materialize, slices
from .groups import components, light

WIDTH = 5
#: Bits that fingerprints of the first candidates may differ in.
DISTANCE = 3
#: Texts that the order of shingles is estimated from, about, and the common shingles that it keeps.
SAMPLE, COMMON = 20_000, 100_000
SKETCH = 256
#: A shingle's hubs are the classes that are smallest once such bits are turned over.
HUBS = [0, *(xxh64_intdigest(b"hub", k) >> 1 for k in range(11))]
PARITY = [f"p{k}" for k in range(SKETCH // 64)]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes (int64) of a text's distinct shingles."""
    return np.unique(simhash.shingle_hashes(text, width).view(np.int64))


def parity(shingles: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """For each of so many buckets, whether an odd number of the shingles falls into it."""
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits) & 1, bitorder="little").view(np.int64)


def long_parity(shingles: np.ndarray) -> np.ndarray:
    """The same with a bucket a shingle, up to the next power of two; nothing where that is no more than the short sketch."""
    n = len(shingles)
    return parity(shingles, 1 << (n - 1).bit_length()) if n > SKETCH else np.empty(0, np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, rare ones first, of which similar sets share one; also their order in the whole set."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - (4 * n + 4) // 5 + 1]]


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, sorted, that several texts of a sample share, and in how many they are."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(cell.as_py(), width))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 3")
    rows = sorted(map(tuple, counts.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()))
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def head(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix by 32 bits a shingle, and the (first) place of each in it."""
    return np.unique(prefix(shingles, common, counts).astype(np.int32), return_index=True)


def outlines(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (a hash of the text), cls (of the shingle set), n (its size), fp, its sketch, its prefix with places and a number, a row per document."""
    common, counts = common_shingles(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [simhash.shingle_hashes(t.as_py(), width) for t in batch.column(1)]
            fps = pa.array([simhash.signed(simhash.fingerprint_of(h)) for h in hashes], pa.int64())
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            cls = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            sketch = np.array([parity(s) for s in sets], np.int64).reshape(-1, len(PARITY))
            wide = pa.array([long_parity(s) for s in sets], pa.list_(pa.int64()))
            tokens, places = zip(*(head(s, common, counts) for s in sets), strict=True)
            heads = [pa.array(tokens, pa.list_(pa.int32())), pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32()))]
            cols = [batch.column(0), batch.column(2), pa.array(cls), pa.array([len(s) for s in sets], pa.int32()), fps]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(sketch[:, k].copy()) for k in range(len(PARITY))), wide, *heads], names=["doc_id", "th", "cls", "n", "fp", *PARITY, "wide", "token", "place"])

    schema = f"doc_id long, th long, cls long, n int, fp long, {', '.join(f'{p} long' for p in PARITY)}, wide array<long>, token array<int>, place array<int>"
    rows = docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, schema)
    return rows.withColumn("row", F.monotonically_increasing_id())


def shingle_sets(docs: DataFrame, marks: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """cls and its shingles, for the classes in the pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([shingle_set(t.as_py(), width) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["cls", "shingles"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = materialize(marks.join(ends, "cls", "left_semi").select("cls", F.col("doc_id").alias("id"), "th"), "wanted")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    texts = rows.join(light(wanted).alias("w"), (rows["th"] == F.col("w.th")) & rows["doc_id"].eqNullSafe(F.col("w.id"))).select("cls", "text")
    made = texts.mapInArrow(run, "cls long, shingles array<long>")
    return materialize(made.groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")  # of wholly repeated rows one


def may_be(x: str, y: str) -> Column:
    """Whether two classes' sizes and sketches allow the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY), F.lit(0))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def may_start(x: str, y: str) -> Column:
    """Whether two classes of the similarity can have this shingle as the first that they share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 9 * F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place")) >= 4 * (n + m)


def by_fingerprint(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints the operator's search links; those of one fingerprint are paired with its least."""
    first = materialize(marks.groupBy("fp").agg(F.min("cls").alias("cls")), "prints")
    near = materialize(simhash.links(first.select("fp"), DISTANCE), "near")
    x, y = (first.select(F.col("fp").alias(end), F.col("cls").alias(f"{end}_cls")) for end in "ab")
    near = near.join(x, "a").join(y, "b").select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b"))
    same = marks.select("fp", F.col("cls").alias("b")).join(first.withColumnRenamed("cls", "a"), "fp").where("a != b").select("a", "b")
    return near.unionByName(same)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a similarity of 0.8 or more."""
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def long_sketches_allow(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Whether the long sketches of two classes allow the similarity; a class without one always does."""
    least = F.least(F.size(x), F.size(y))
    halves = lambda s: F.zip_with(F.slice(s, 1, least), F.slice(s, least + 1, least), lambda u, v: u.bitwiseXOR(v))
    fold = lambda s: F.when(F.size(s) > least, halves(s)).otherwise(s)
    bits = F.aggregate(F.zip_with(fold(x), fold(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, k: total + k)
    # similar sets' sizes are within a quarter, so one sketch is at most twice as long
    return F.when((least == 0) | (F.greatest(F.size(x), F.size(y)) > 2 * least), F.lit(True)).otherwise(9 * bits <= n + m)


def candidates(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow the similarity, written."""
    x, y = (marks.select("cls", "n", *PARITY).alias(side) for side in "xy")
    near = pairs.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).where(may_be("x", "y")).select("a", "b")
    near = materialize(near, "pairs")
    x, y = (marks.select("cls", "n", "wide").alias(side) for side in "xy")
    both = near.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls"))
    return materialize(both.where(long_sketches_allow(F.col("x.wide"), F.col("y.wide"), F.col("x.n"), F.col("y.n"))).select("a", "b"), "pairs")


def links(docs: DataFrame, found: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of near copies among the classes, enough to join all that near copies join.

    ``classes`` has the row that stands for each class; its number is the class's here.
    """
    first_rows = found.drop("cls").join(light(classes.select("row")), "row", "left_semi").withColumnRenamed("row", "cls")
    marks = materialize(first_rows.select("cls", "doc_id", "th", "n", "fp", *PARITY, "wide"), "marks")
    heads = first_rows.select(F.explode(F.arrays_zip("token", "place")).alias("at"), "cls", "n").select("at.token", "at.place", "cls", "n")
    again = heads.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("token")
    shared = materialize(heads.join(again, "token"), "shared")

    hub = lambda m: F.min(F.struct(F.col("cls").bitwiseXOR(m).alias("key"), F.lit(m).alias("mask"), "place", "n"))
    hubs = shared.groupBy("token").agg(F.array(*map(hub, HUBS)).alias("hubs"))
    ends = F.array_distinct(F.transform("hubs", lambda h: F.struct(h["key"].bitwiseXOR(h["mask"]).alias("cls"), h["place"].alias("place"), h["n"].alias("n"))))
    star = shared.join(hubs, "token").select(F.struct("cls", "place", "n").alias("x"), F.explode(ends).alias("y")).where((F.col("x.cls") != F.col("y.cls")) & may_start("x", "y"))
    star = star.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    star = materialize(star.unionByName(by_fingerprint(marks)).distinct(), "star")
    tried = candidates(star, marks)
    first = materialize(similar(tried, shingle_sets(docs, marks, tried, width)), "near")

    # what is not joined yet: tokens that several groups share
    joined = components(first)
    rooted = shared.join(joined, shared["cls"] == joined["node"], "left").select("token", "place", "cls", F.coalesce("root", "cls").alias("root"))
    rooted = materialize(rooted, "rooted")
    apart = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    at = rooted.join(apart, "token").join(marks.select("cls", "n", *PARITY), "cls")
    x, y = at.alias("x"), at.alias("y")
    other = (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
    rest = x.join(y, other & may_start("x", "y") & may_be("x", "y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    rest = candidates(rest.join(tried, ["a", "b"], "left_anti"), marks)
    return first.unionByName(materialize(similar(rest, shingle_sets(docs, marks, rest, width)), "near"))


def classify(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th (a hash of the text) and component (the number of a row), a row per document."""
    found = materialize(outlines(docs, width), "outlines")
    classes = materialize(found.groupBy("cls").agg(F.min("row").alias("row")), "classes")
    roots = components(links(docs, found, classes, width))
    of = classes.join(roots, classes["row"] == roots["node"], "left").select("cls", F.coalesce("root", "row").alias("component"))
    return found.select("doc_id", "th", "cls").join(of, "cls").select("doc_id", "th", "component")
