"""Aligning two snapshots: by a key, or by record order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shiftlens.functions.text import trim
from shiftlens.plans.refusal import Refused
from shiftlens.sources.table import Table

SAMPLES, SUGGESTIONS = 10, 3


@dataclass
class Aligned:
    """``df`` has ``ord`` (the key, or the record's number) and text columns ``o0 ..`` and ``n0 ..`` for each wanted pair."""

    df: DataFrame
    keyed: bool


def keys_of(t: Table, key: int) -> DataFrame:
    return t.df.select("row_ord", trim(F.col(f"c{key}")).alias("k"))


def check_keys(old: Table, new: Table, ko: int, kn: int) -> tuple[int, int, bool]:
    """The numbers of records and whether the keys are the same; refused at the first record with an empty or repeated key.

    One pass over each file and one aggregation on the key serve both sides.
    """

    def side(t: Table, key: int, name: str) -> DataFrame:
        mine = [F.lit(int(n == name)).alias(n) for n in ("old", "new")]
        extra = [(F.col("extra") if n == name else F.lit(False)).alias(f"{n}_extra") for n in ("old", "new")]
        return t.df.select(trim(F.col(f"c{key}")).alias("k"), *mine, *extra)

    by_key = side(old, ko, "old").unionByName(side(new, kn, "new")).groupBy("k")
    keys = by_key.agg(*(F.sum(n).alias(n) for n in ("old", "new")), *(F.max(n).alias(n) for n in ("old_extra", "new_extra")))
    whole = [f(n) for n in ("old", "new") for f in (lambda n: F.coalesce(F.sum(n), F.lit(0)), F.max, lambda n: F.max((F.col("k") == "") & (F.col(n) > 0)), lambda n: F.max(f"{n}_extra"))]
    found = keys.agg(*whole, F.count_if(F.col("old") != F.col("new"))).first()
    sides = ((old, ko, found[0:4]), (new, kn, found[4:8]))
    for t, _, (*_, extra) in sides:
        t.refuse_extra(bool(extra))
    for name, (t, key, (_, most, empty, _)) in zip(("old", "new"), sides, strict=True):
        if empty or (most or 0) > 1:
            refuse_key(t, key, name)
    return found[0], found[4], not found[8]


def first_bad_key(t: Table, key: int) -> DataFrame:
    """record (its number) and key of the first record whose key is empty or stood before; no row if there is none."""
    records, _ = numbered(t)
    keys = records.select("rec", trim(F.col(f"c{key}")).alias("key"))
    # two aggregations, each partial before its shuffle, so that a hot key is a row a task
    first = keys.groupBy("key").agg(F.min("rec").alias("first"))
    again = keys.join(first.where("key != ''"), "key").where("rec > first").groupBy("key").agg(F.min("rec").alias("rec"))
    empty = first.where("key = ''").select("key", F.col("first").alias("rec"))
    return again.unionByName(empty).orderBy("rec").limit(1).select(F.col("rec").alias("record"), "key")


def refuse_key(t: Table, key: int, side: str) -> None:
    """Refuse the first record whose key is empty or stood before."""
    bad = first_bad_key(t, key).first()
    if bad is None:
        raise RuntimeError(f"{t.name}: two evaluations gave different records")
    if bad["key"] == "":
        raise Refused("E_KEY_EMPTY", {"file": side, "record": bad["record"], "column": t.headers[key]})
    raise Refused("E_KEY_DUP", {"file": side, "record": bad["record"], "key": t.bytes_of(bad["key"])})


def key_differences(old: Table, new: Table, ko: int, kn: int) -> dict:
    """Keys on one side only: counts and the first few in byte order."""
    a, b = keys_of(old, ko).select("k"), keys_of(new, kn).select("k")
    out: dict = {}
    for name, left, right, t in (("missing", a, b, old), ("extra", b, a, new)):
        only = left.join(right, "k", "left_anti")
        out[f"{name}_in_new"] = only.count()
        out[f"{name}_samples"] = [t.bytes_of(r.k) for r in only.orderBy("k").limit(SAMPLES).collect()]
    return {k: out[k] for k in ("missing_in_new", "extra_in_new", "missing_samples", "extra_samples")}


def pairs(old: Table, new: Table, wanted: list[tuple[int, int]], on_old, on_new, a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(on_old.alias("ord"), *(F.col(f"c{i}").alias(f"o{k}") for k, (i, _) in enumerate(wanted)))
    right = b.select(on_new.alias("ord"), *(F.col(f"c{j}").alias(f"n{k}") for k, (_, j) in enumerate(wanted)))
    return left.join(right, "ord")


def by_key(old: Table, new: Table, ko: int, kn: int, wanted: list[tuple[int, int]]) -> Aligned:
    """The inner join on the trimmed key. Only the wanted columns reach the shuffle."""
    return Aligned(pairs(old, new, wanted, trim(F.col(f"c{ko}")), trim(F.col(f"c{kn}")), old.df, new.df), True)


def numbered(t: Table) -> tuple[DataFrame, int]:
    """The records with their number (from 1) in ``rec``, and how many there are.

    The table is pinned, so that a record's ``row_ord`` (its partition and its place
    there) is a value; the partitions' counts then give every number without a shuffle.
    The same pass refuses records that are too wide.
    """
    records = t.pin()
    counts = records.groupBy(F.shiftright("row_ord", 33).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("extra").alias("extra")).orderBy("block").collect()  # a row a partition of the scan
    t.refuse_extra(any(r["extra"] for r in counts))
    starts, total = [], 0
    for r in counts:
        starts.append((r["block"], total))
        total += r["n"]
    start = records.sparkSession.createDataFrame(starts, "block long, start long")
    place = F.col("row_ord").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    df = records.withColumn("block", F.shiftright("row_ord", 33)).join(F.broadcast(start), "block")
    return df.withColumn("rec", F.col("start") + place).drop("block", "start"), total


def by_order(old: Table, new: Table, wanted: list[tuple[int, int]], common: list[tuple[bytes, int, int]]) -> tuple[Aligned, int]:
    """Record i against record i; refused where the counts differ."""
    (a, n), (b, m) = numbered(old), numbered(new)
    if n != m:
        found = discover_keys(old, new, common)
        raise Refused(
            "E_ROWCOUNT",
            {"rows_old": n, "rows_new": m, "suggested_keys": [x.name for x in found][:SUGGESTIONS]},
            {"rows_old": n, "rows_new": m},
        )
    return Aligned(pairs(old, new, wanted, F.col("rec"), F.col("rec"), a, b), False), n


@dataclass
class KeyCandidate:
    name: bytes
    perfect: bool
    old: int
    new: int


def discover_keys(old: Table, new: Table, common: list[tuple[bytes, int, int]]) -> list[KeyCandidate]:
    """Common columns that are unique and never empty on both sides; those with equal value sets first.

    All columns are counted in one pass: a row for each column and value, pre-aggregated.
    """
    if not common:
        return []

    def long(t: Table, which: int, side: int) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(k).alias("col"), trim(F.col(f"c{c[which]}")).alias("v")) for k, c in enumerate(common)))
        return t.df.select(F.explode(cells).alias("x")).select("x.col", "x.v", F.lit(1 - side).alias("o"), F.lit(side).alias("n"))

    counts = long(old, 1, 0).unionByName(long(new, 2, 1)).groupBy("col", "v").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    stats = counts.groupBy("col").agg(F.max(F.greatest("o", "n")).alias("most"), F.max(F.col("v") == "").alias("empty"), F.min(F.col("o") == F.col("n")).alias("same")).collect()
    ok = {r.col: r.same for r in stats if r.most <= 1 and not r.empty}
    found = [KeyCandidate(c[0], ok[k], c[1], c[2]) for k, c in enumerate(common) if k in ok]
    return sorted(found, key=lambda x: not x.perfect)


def reordered(old: Table, new: Table, common: list[tuple[bytes, int, int]], aligned: Aligned | None = None) -> list[bytes] | None:
    """Suggested keys if a column with equal value sets stands in another order, else None.

    ``aligned`` is by record number with the common columns in their order, if there is
    such a frame. A pass over it, without a shuffle, leaves the columns that differ
    somewhere and whose values' hashes agree in total; only with such columns are
    values counted.
    """
    if aligned is None:
        (a, _), (b, _) = numbered(old), numbered(new)
        aligned = Aligned(pairs(old, new, [c[1:] for c in common], F.col("rec"), F.col("rec"), a, b), False)
    sides = [(trim(F.col(f"o{k}")), trim(F.col(f"n{k}"))) for k in range(len(common))]
    checks = [F.max(x != y) & (F.bit_xor(F.xxhash64(x).bitwiseXOR(F.xxhash64(y))) == 0) for x, y in sides]
    if not checks:
        return None
    moved = {c[0] for c, m in zip(common, aligned.df.agg(*(c.alias(f"m{k}") for k, c in enumerate(checks))).first(), strict=True) if m}
    if not moved:
        return None
    found = discover_keys(old, new, common)
    return [c.name for c in found][:SUGGESTIONS] if any(c.perfect and c.name in moved for c in found) else None
