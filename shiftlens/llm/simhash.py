"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: texts lower-cased in A-Z, cut into words and word shingles (repeats
count); each of 64 bits is set if it is set in over half of the shingles' XXH64.

Search: distinct fingerprints only. The 64 bits are grouped, correlated bits together,
into ``m`` parts. If the parts get thresholds that sum to ``distance - m + 1``, two
fingerprints within the distance are within its threshold on some part. Candidate
counts of each part and threshold are estimated from all fingerprints, and dynamic
programming allocates the (unequal) thresholds, also choosing ``m``, at the least cost
of probes and candidates. Every fingerprint is an index row of each part and probes
the values within the part's threshold; an equi-join whose condition verifies the full
distance makes only true links, so crowded values cost comparisons, not rows, and the
engine splits skewed values by itself.

Components: links between fingerprints are contracted by alternating large-star and
small-star rounds, each written to the shared folder, until nothing changes. Documents
get their class's component by a join on the fingerprint.

Defined results: null and empty texts have fingerprint zero and link like any other;
repeated rows share a class; a null doc_id takes part but is never the smallest id
unless its component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .groups import components, keep_least

BITS = 64
#: Cost of a candidate pair against that of a probe row.
CANDIDATE_COST = 4.0
ONES = [1 << k for k in range(BITS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """The hashes (uint64) of a whole text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII spaces
    join = b" ".join
    if len(words) < width:
        hashes = [xxh64_intdigest(join(words), 42)] if words else []
    else:
        hashes = [xxh64_intdigest(join(s), 42) for s in zip(*(words[k:] for k in range(width)), strict=False)]
    return np.array(hashes, dtype="<u8")


def text_fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of so many shingles; zero without any."""
    h = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65_536):  # long texts in bounded memory
        ones += np.unpackbits(h[k : k + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed long), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(text_fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    return docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and in how many each two bits are both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(x)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "n"])

    cells = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for cell, n in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").sum("n").collect():  # 4097 rows
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of near-equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, parts))) // (m - k)
        left = sorted(free)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in left if b not in part), key=lambda b: (corr[b, part].sum(), -b)))
        parts.append(sorted(part))
        free -= set(part)
    return parts


def mask_of(part: list[int]) -> int:
    return signed(sum(ONES[b] for b in part))


def exact_pairs(fps: DataFrame, masks: list[int]) -> list[int]:
    """For each mask, how many pairs agree on all of its bits."""
    keyed = fps.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(x)) for x in masks))).alias("part", "key"))
    pairs = keyed.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"))
    found = dict(pairs.collect())  # a row for each mask
    return [int(found.get(k) or 0) for k in range(len(masks))]


def within_ratio(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated pairs within t bits on the part, for each pair that agrees on it, for t = 0 .. most."""
    ways = np.zeros(most + 1)
    ways[0] = 1
    for b in part:
        p = both[b, b] / max(n, 1)
        differ = 2 * p * (1 - p)
        odds = differ / max(1 - differ, 1e-9)
        ways[1:] = ways[1:] + odds * ways[:-1]
    return list(np.cumsum(ways))


def allocate(cost: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """The thresholds, from -1 (cost 0) up, that sum to the budget at the least cost.

    ``cost[part][t]`` is the cost of threshold t >= 0; dynamic programming over parts.
    """
    states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in states.items():
            for t in range(-1, len(part)):
                new = (total + (part[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t not in nxt or new < nxt[used + t]:
                    nxt[used + t] = new
        states = nxt
    return states[budget]


def plan_parts(fps: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed."""
    n, both = bit_counts(fps)
    grouped = [correlated_parts(n, both, m) for m in choices]
    exact = iter(exact_pairs(fps, [mask_of(p) for parts in grouped for p in parts]))
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in grouped:
        cost = []
        for part in parts:
            agree, ratio = next(exact), within_ratio(n, both, part, distance)
            cost.append([n * (1 + sum(comb(len(part), k) for k in range(t + 1))) + CANDIDATE_COST * (agree + 1) * ratio[t] for t in range(distance + 1)])
        total, thresholds = allocate(cost, distance - len(parts) + 1)
        if best is None or total < best[0]:
            best = total, [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0]
    return best[1]


def probe_rows(part: int, key: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*(F.lit(x) for x in flips)), lambda x: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(x).alias("key")))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """a < b: the pairs of distinct fingerprints within the distance, each once."""
    parts = plan_parts(fps, distance)
    index, probes = [], []
    for k, (part, t) in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(mask_of(part)))
        flips = [signed(sum(ONES[b] for b in bits)) for r in range(t + 1) for bits in combinations(part, r)]
        index.append(F.array(F.struct(F.lit(k).alias("part"), key.alias("key"))))
        probes.append(probe_rows(k, key, flips))
    if not parts:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    left = fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("at")).select("a", F.col("at.part").alias("lp"), F.col("at.key").alias("lk"))
    right = fps.select(F.col("fp").alias("b"), F.explode(F.flatten(F.array(*index))).alias("of")).select("b", F.col("of.part").alias("rp"), F.col("of.key").alias("rk"))
    close = (F.col("lp") == F.col("rp")) & (F.col("lk") == F.col("rk")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.join(right, close).select("a", "b").distinct()


def classify(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """doc_id, th (a hash of the text), fp, component (a fingerprint) and component_id, a row per document."""
    prints = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(links(classes.select("fp"), distance))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("component"))
    least = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row per document."""
    return classify(docs, width, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, distance: int | None = 3) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; the input's columns.

    Rows that share that id go by the hash of their text, and of wholly repeated rows one
    stays. Without a ``distance`` documents are linked by the similarity of their shingle
    sets, 0.8 or more, for which no distance of 64 bits that can be searched stands: the
    fingerprints are searched first and an exact search goes through the rest (see
    ``near_copies``).
    """
    from . import near_copies  # which searches fingerprints by this module

    return keep_least(docs, near_copies.classify(docs, width) if distance is None else classify(docs, width, distance))
