"""Mixing sources to target weights, with DataFrame functions only.

Sources ordered by code point (null last) take the weights in turn. A share of all
words is dealt by weight, no source above ``cap`` times its own words; the excess is
dealt again by weight, which is water filling: one level, found from prefix sums over
the sources sorted by capacity per weight.

Inside a source, documents are range-sorted by a hash-random key, of the doc_id and the
text, so that rows that share an id, or have none, are spread as well. The key's leading
32 bits cut a source into as many equal ranges as its share of the rows asks for, so a
source with a third of all rows is spread over a third of the tasks. Range totals give distributed
prefix sums, and the budget is cut exactly: full epochs first, then the prefix, with
the document at the cut taken in part.

Defined results: null text has size 0 and takes 0; a null source is a source; repeated
rows count each, and of rows alike in id and text the columns in ``keep`` decide; an empty table gives an empty result; a source without words has
target 0; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, materialize, shuffle_partitions

#: Up to so many rows of (source, target) or (source, range, offset) are broadcast; a row is under 200 bytes.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Add, over all rows in the given order, the sum of each value over the rows before.

    Rows are range-partitioned; each range is summed, the ranges' totals (one row a
    range) are added up, and a window inside each range does the rest.
    """
    spark = df.sparkSession
    n = min(64, shuffle_partitions(spark))
    dealt = df.select("*", *(o.alias(f"_o{k}") for k, o in enumerate(order)), *(v.alias(f"_v_{k}") for k, v in sums.items()))
    keys = [F.col(f"_o{k}").asc_nulls_last() for k in range(len(order))]
    ranged = materialize(dealt.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), label)
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *((F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0))).alias(k) for k in sums))


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size, n_rows, target: what each source is to give."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = prefix_sums(sources, [F.col("source")], {"_rank": F.lit(1)}, "mix-rank")
    deal = F.array(*(F.lit(int(w)) for w in weights))
    ranked = ranked.select("source", "source_size", "n_rows", "_rank", F.element_at(deal, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_w"))
    ranked = ranked.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    levels = prefix_sums(ranked, [F.col("_cap") / F.col("_w"), F.col("_rank")], {"_size_before": F.col("source_size"), "_w_before": F.col("_w")}, "mix-level")
    levels = materialize(levels, "mix-targets")
    total = levels.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w")).first()
    size, weight = total["s"] or 0, total["w"] or 0
    level = (F.lit(share * size) - F.lit(float(cap)) * F.col("_size_before")) / (F.lit(weight) - F.col("_w_before"))
    fits = F.when(level <= F.col("_cap") / F.col("_w"), level)
    water = levels.agg(F.max(fits).alias("x")).first()["x"]
    filled = F.col("_cap") if water is None else F.least(F.col("_w") * F.lit(float(water)), F.col("_cap"))
    return levels.select("source", "source_size", "n_rows", filled.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    ranges_per_task: int = 4,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns in ``keep``, a row per input row."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *(F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep))
    narrow = materialize(base.select("doc_id", "source", "size", "_key"), "mix-sizes")
    targets = materialize(source_targets(narrow, weights, share, cap), "mix-sources")
    spread = ranges_per_task * shuffle_partitions(docs.sparkSession)
    n_rows = targets.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") * spread / max(1, n_rows)))
    n_sources, n_ranges = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(ranges), F.lit(0))).first()

    rename = targets.select(F.col("source").alias("_source"), "source_size", "target", ranges.alias("_ranges"))

    def attach(rows: DataFrame) -> DataFrame:
        side = F.broadcast(rename) if n_sources <= BROADCAST_ROWS else rename
        joined = rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
        return joined.withColumn("_range", F.shiftright(lead * F.col("_ranges"), 32))

    rows = attach(base if keep else narrow)
    totals = attach(narrow).groupBy("source", "_range").agg(F.sum("size").alias("_total"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_source"), F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))

    last = [F.xxhash64(*(F.col(f"_keep_{c}") for c in keep))] if keep else []
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", *last).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    side = F.broadcast(offsets) if n_ranges <= BROADCAST_ROWS else offsets
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of")))
    budget, whole = F.floor("target"), F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / whole)
    left = budget - epochs * F.col("source_size") - F.col("_offset") - F.col("_inside")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"`_keep_{c}`").alias(c) for c in keep))


ORACLE = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as k
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), r as (
  select source, source_size, 2.0::double * source_size as cap, row_number() over (order by source nulls last) - 1 as rk,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s
), p as (
  select *, coalesce(sum(source_size) over o, 0)::double as size_before, coalesce(sum(w) over o, 0)::double as w_before
  from r window o as (order by cap / w, rk rows between unbounded preceding and 1 preceding)
), l as (
  select *, (1.5::double * (select sum(source_size) from s)::double - 2.0::double * size_before) / ((select sum(w) from r)::double - w_before) as lv from p
), t as (
  select source, source_size, least(w * (select max(lv) from l where lv <= cap / w), cap) as target from l
), x as (
  select d.doc_id, d.source, d.size, t.source_size, t.target, cast(floor(t.target) as bigint) as b,
         cast(coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) as pre
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast((b // greatest(source_size, 1)) * size + least(size, greatest(0, b - (b // greatest(source_size, 1)) * source_size - pre)) as bigint) as taken
from x
"""
