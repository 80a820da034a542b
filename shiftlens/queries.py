"""Registered queries over the star-schema tables, each with the DuckDB SQL that checks it.

The "new" snapshot is a fixed perturbation of the old one, written alike in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions import text
from shiftlens.operators import align, cells, repro
from shiftlens.plans.compare import compare, split_headers
from shiftlens.plans.options import TOP
from shiftlens.plans.refusal import Refused
from shiftlens.plans.render import summary_frame, to_dict
from shiftlens.registry import ORACLES, QUERIES, load, registered
from shiftlens.sources import ledger
from shiftlens.sources.table import Table, fit_width, from_csv, from_frame

from .file_queries import write_lines

#: Numeric columns of the compared orders, in order.
NUMERIC = cells.Columns([b"totalprice", b"custkey"], [1, 2], [1, 2])


def old_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("totalprice"), F.col("o_custkey").cast("double").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )


def new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = old_orders(spark, sf_dir)
    price = F.when(F.col("k") % 1000 == 7, F.col("totalprice") + 5000).when(F.col("k") % 3 == 0, F.col("totalprice") + 1e-12).otherwise(F.col("totalprice"))
    status = F.when(F.col("k") % 500 == 3, F.lit("X")).otherwise(F.col("status"))
    return o.select("k", price.alias("totalprice"), "custkey", status.alias("status"), "priority")


def keyed(spark: SparkSession, sf_dir: str, new: DataFrame | None = None) -> tuple[Table, Table, align.Aligned]:
    a, b = from_frame(old_orders(spark, sf_dir), "old"), from_frame(new if new is not None else new_orders(spark, sf_dir), "new")
    return a, b, align.by_key(a, b, 0, 0, list(zip(NUMERIC.old, NUMERIC.new, strict=True)))


def named(df: DataFrame) -> DataFrame:
    """Changes under their columns' names."""
    names = F.array(*(F.lit(n.decode()) for n in NUMERIC.names))
    return df.select(F.col("ord").cast("long").alias("k"), F.get(names, F.col("col")).alias("column"), F.col("x").alias("old"), F.col("y").alias("new"), "delta", "contribution")


def changed(spark: SparkSession, sf_dir: str, new: DataFrame | None = None) -> DataFrame:
    _, _, both = keyed(spark, sf_dir, new)
    return cells.changes(both, NUMERIC, [0, 1], 1e-9)


BASE = """
with o as (select o_orderkey as k, o_totalprice as p, cast(o_custkey as double) as c, o_orderstatus as s from orders),
n as (select k, case when k % 1000 = 7 then p + 5000 when k % 3 = 0 then p + 1e-12 else p end as p, c, case when k % 500 = 3 then 'X' else s end as s from o),
u as (select o.k, 'totalprice' as col, 0 as ci, o.p as ov, n.p as nv from o join n on o.k = n.k
      union all select o.k, 'custkey', 1, o.c, n.c from o join n on o.k = n.k),
d as (select k, col, ci, ov, nv, nv - ov as delta, case when abs(nv - ov) <= 1e-9 then 0.0::double else abs(nv - ov) end as contribution from u),
t as (select * from d where contribution > 0 order by contribution desc, cast(k as varchar), ci limit 25)
"""


@registered(BASE + 'select k, col as "column", ov as old, nv as new, delta, contribution from t')
def diff_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest changes of a keyed comparison."""
    return named(changed(spark, sf_dir).orderBy(F.desc("contribution"), "ord", "col").limit(TOP))


@registered(BASE + "select count(*) as cells, count(*) filter (contribution > 0) as changed, round(sum(contribution), 6) as total_change, round(max(abs(delta)), 6) as max_abs_delta from d")
def diff_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, changed cells, total and largest change."""
    old, new, both = keyed(spark, sf_dir)
    t = cells.type_columns(both, old, new, NUMERIC, 1e-9)
    return spark.createDataFrame([(t.rows * len(t.numeric), t.changed, round(t.total, 6), round(t.largest, 6))], "cells long, changed long, total_change double, max_abs_delta double")


@registered(
    BASE
    + """, r as (select *, row_number() over (order by contribution desc, cast(k as varchar), ci) as rn,
        sum(contribution) over (order by contribution desc, cast(k as varchar), ci rows unbounded preceding) as cum from t),
     s as (select sum(contribution) as total from d)
     select k, col as "column", cast(rn as integer) as "rank", round(contribution / total, 9) as share, round(cum / total, 9) as cumulative_share
     from r, s where rn <= (select min(rn) from r, s where cum / total >= 0.5)"""
)
def diff_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least prefix of the largest changes that covers half of the total."""
    v = compare(spark, old_orders(spark, sf_dir).drop("status", "priority"), new_orders(spark, sf_dir).drop("status", "priority"), key="k", threshold=0.5)
    found = to_dict(v)["contributors"]
    rows = [(int(c["row_id"][3:]), c["column"][3:], rank, round(c["share"], 9), round(c["cumulative_share"], 9)) for rank, c in enumerate(found, 1)]
    return spark.createDataFrame(rows, "k long, column string, rank int, share double, cumulative_share double")


@registered(BASE + 'select k, col as "column", ov as old, nv as new, delta, contribution from d where contribution > 0')
def diff_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every changed numeric cell."""
    return named(changed(spark, sf_dir))


@registered("select 'NO_REAL_CHANGE' as outcome, 2 * count(*) as cells_checked, cast(0 as bigint) as changed from orders")
def diff_no_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perturbation within the tolerance: proved to be no real change."""
    o = old_orders(spark, sf_dir).select("k", "totalprice", "custkey")
    n = o.withColumn("totalprice", F.col("totalprice") + 1e-12)
    v = summary_frame(spark, compare(spark, o, n, key="k"))
    return v.select("outcome", F.col("numeric_cells_checked").alias("cells_checked"), F.col("numeric_cells_changed").alias("changed"))


@registered("select 'REFUSAL' as outcome, 'E_DIFFUSE' as code, round(25.0 / count(*), 9) as coverage from orders")
def diff_diffuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same change in every row: too diffuse for 25 cells."""
    o = old_orders(spark, sf_dir).select("k", "custkey")
    v = summary_frame(spark, compare(spark, o, o.withColumn("custkey", F.col("custkey") + 1), key="k"))
    return v.select("outcome", "code", F.round("top_k_coverage", 9).alias("coverage"))


@registered(
    BASE
    + """select 'REAL_CHANGE' as outcome, (select count(*) from orders) as rows_aligned, cast(2 as bigint) as numeric_columns,
    (select count(*) from d where contribution > 0) as changed, (select round(sum(contribution), 6) from d) as total_change"""
)
def compare_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison by key: its verdict and counters (any share of the total is taken as enough)."""
    o, n = old_orders(spark, sf_dir).drop("status", "priority"), new_orders(spark, sf_dir).drop("status", "priority")
    v = summary_frame(spark, compare(spark, o, n, key="k", threshold=1e-6))
    return v.select("outcome", "rows_aligned", "numeric_columns", F.col("numeric_cells_changed").alias("changed"), F.round("total_change", 6).alias("total_change"))


EVENTS = "with e as (select event_id, value, row_number() over (order by event_id) as rec from events), f as (select event_id, value + case when event_id % 100 = 5 then 10 else 0 end as value, row_number() over (order by event_id) as rec from events)"


def event_pair(spark: SparkSession, sf_dir: str) -> tuple[Table, Table]:
    e = load(spark, sf_dir, "events").select("event_id", "value")
    f = e.withColumn("value", F.col("value") + F.when(F.col("event_id") % 100 == 5, 10).otherwise(0))
    return from_frame(e, "old", "event_id"), from_frame(f, "new", "event_id")


@registered(EVENTS + " select e.rec as record, e.value as old, f.value as new from e join f on e.rec = f.rec where abs(f.value - e.value) > 1e-9")
def row_order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between records at the same place."""
    a, b = event_pair(spark, sf_dir)
    both, _ = align.by_order(a, b, [(1, 1)], [(b"event_id", 0, 0)])
    found = cells.changes(both, cells.Columns([b"value"], [1], [1]), [0], 1e-9)
    return found.select(F.col("ord").alias("record"), F.col("x").alias("old"), F.col("y").alias("new"))


@registered("select 'E_ROWCOUNT' as code, count(*) as rows_old, count(*) filter (event_id % 7 <> 0) as rows_new from events")
def row_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record order needs equal counts."""
    e = load(spark, sf_dir, "events").select("event_id", "value")
    v = summary_frame(spark, compare(spark, e, e.where("event_id % 7 != 0")))
    return v.select("code", "rows_old", "rows_new")


@registered("select min(event_id) + 1 as record, 'props' as \"column\" from (select event_id - (select min(event_id) from events) as event_id from events where event_id % 50 = 13)")
def key_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record with an empty key."""
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 13, F.lit(" \t")).otherwise(F.col("event_id").cast("string")).alias("props"))
    d = key_refusal(e, 1)
    return spark.createDataFrame([(d["record"], d["column"].decode())], "record long, column string")


def key_refusal(df: DataFrame, key: int) -> dict:
    """What the key check of a snapshot, against itself, refuses."""
    t, same = from_frame(df, "old", "event_id"), from_frame(df, "new", "event_id")
    try:
        align.check_keys(t, same, key, key)
    except Refused as r:
        return r.detail
    raise AssertionError("the keys are good")


@registered(
    "with e as (select row_number() over (order by event_id) as rec, user_id from events), r as (select *, row_number() over (partition by user_id order by rec) as nth from e) "
    "select rec as record, cast(user_id as varchar) as \"key\" from r where nth = 2 order by rec limit 1"
)
def key_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record whose key was there before."""
    d = key_refusal(load(spark, sf_dir, "events").select("event_id", "user_id"), 1)
    return spark.createDataFrame([(d["record"], d["key"].decode())], "record long, key string")


@registered(
    """with o as (select c_custkey as k from customer where c_custkey % 40 <> 1), n as (select c_custkey as k from customer where c_custkey % 60 <> 2),
    m as (select 'missing_in_new' as side, cast(k as varchar) as "key" from o where k not in (select k from n)),
    x as (select 'extra_in_new' as side, cast(k as varchar) as "key" from n where k not in (select k from o)),
    r as (select *, count(*) over (partition by side) as total, row_number() over (partition by side order by "key") as rn from (select * from m union all select * from x))
    select side, total, "key" from r where rn <= 10"""
)
def key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on one side only: counts and the first ten."""
    c = load(spark, sf_dir, "customer").select("c_custkey")
    a, b = from_frame(c.where("c_custkey % 40 != 1"), "old"), from_frame(c.where("c_custkey % 60 != 2"), "new")
    d = align.key_differences(a, b, 0, 0)
    rows = [(side, d[side], k.decode()) for side, s in (("missing_in_new", "missing_samples"), ("extra_in_new", "extra_samples")) for k in d[s]]
    return spark.createDataFrame(rows, "side string, total long, key string")


STATS = " union all ".join(
    f"select '{c}' as \"column\", {k} as place, count(*) as n, count(distinct trim(cast({c} as varchar), ' ' || chr(9))) as d, bool_or(coalesce(trim(cast({c} as varchar)), '') = '') as e from customer"
    for k, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
)


@registered(f'select "column", true as perfect from ({STATS}) where n = d and not e')
def key_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that can serve as a key of both snapshots."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    t = from_frame(c, "old")
    found = align.discover_keys(t, from_frame(c, "new"), [(n, i, i) for i, n in enumerate(t.headers)])
    return spark.createDataFrame([(k.name.decode(), k.perfect) for k in found], "column string, perfect boolean")


@registered(
    """with o as (select s_suppkey as k, s_acctbal as v, row_number() over (order by s_suppkey) as rec from supplier), n as (select k, v + case when k = 3 then 1 else 0 end as v, row_number() over (order by k desc) as rec from o)
    select case when sum(abs(n.v - o.v)) > 1e-9 and bool_or(o.k <> n.k) and (select count(distinct k) = count(*) from o) then 'E_NEED_KEY' end as code from o join n on o.rec = n.rec"""
)
def shuffle_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reordered records under a perfect key: order can't align them."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    moved = s.orderBy(F.desc("s_suppkey")).select("s_suppkey", (F.col("s_acctbal") + F.when(F.col("s_suppkey") == 3, 1).otherwise(0)).alias("s_acctbal"))
    return summary_frame(spark, compare(spark, s, moved)).select("code")


TYPING = """with e as (select event_id as k, case when event_id % 97 = 0 then 'n/a' else cast(user_id as varchar) end as a, event_type as b, case when event_id % 11 = 4 then '-' else cast(user_id as varchar) end as c from events)"""


@registered(
    TYPING
    + """, u as (select cast(k as varchar) as k, 0 as i, a as v from e union all select cast(k as varchar), 1, b from e union all select cast(k as varchar), 2, c from e),
    x as (select k, i, v as o, case when i = 2 and v = '-' then '5' else v end as n from u),
    m as (select *, upper(trim(o)) in ('','-','NA','N/A','NULL','NAN','NONE') as mo, upper(trim(n)) in ('','-','NA','N/A','NULL','NAN','NONE') as mn, try_cast(o as double) as p, try_cast(n as double) as q from x)
    select case i when 0 then 'a' when 1 then 'b' else 'c' end as "column", min(case when p is not null and q is not null then k end) as first_numeric,
      min(case when (not mo and p is null) or (not mn and q is null) then k end) as first_text,
      min(case when (mo and q is not null) or (mn and p is not null) then k end) as first_conflict from m group by i"""
)
def column_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column: the first numeric, text and number-against-missing record in key order."""
    e = load(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    o = e.select(F.col("event_id").alias("k"), F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(user).alias("a"), F.col("event_type").alias("b"), F.when(F.col("event_id") % 11 == 4, "-").otherwise(user).alias("c"))
    n = o.withColumn("c", F.when(F.col("c") == "-", "5").otherwise(F.col("c")))
    a, b = from_frame(o, "old"), from_frame(n, "new")
    columns = cells.Columns([b"a", b"b", b"c"], [1, 2, 3], [1, 2, 3])
    d = cells.long_cells(align.by_key(a, b, 0, 0, [(1, 1), (2, 2), (3, 3)]), columns)
    x, y, mo, mn = F.col("x").isNotNull(), F.col("y").isNotNull(), F.col("mo"), F.col("mn")
    firsts = d.groupBy("col").agg(
        F.min(F.when(x & y, F.col("ord"))).alias("first_numeric"), F.min(F.when(~mo & ~x | ~mn & ~y, F.col("ord"))).alias("first_text"), F.min(F.when(mo & y | mn & x, F.col("ord"))).alias("first_conflict")
    )
    return firsts.select(F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("col")).alias("column"), "first_numeric", "first_text", "first_conflict")


TOKENS = ("123", "-123", "+123", "123.45", "1e6", "-1.2E-3", "1,234", "+1,234", "1,234,567.89", "$123.45", "-$1,234.56", "$-1,234.56", "(123.45)", "($1,234.56)", "($-1,234.56)", " 7 ", ".5", "1.", "", "$", "12,34", "1,23,456", ",123", "123,", "1,234.5.6", "+$-1", "--1", "NaN", "inf", "1e400", "1d", "5-", "-", "0x1F", "1 2")
VALUES = ", ".join(f"('{t}')" for t in TOKENS)
RX = r"^(\(B\)|B)$".replace("B", r"([+-]?\$?|\$[+-])(([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?")


def inline(spark: SparkSession, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "token string")


@registered(
    f"""with t as (select token, trim(token, ' ' || chr(9)) as b from (values {VALUES}) v(token)),
    p as (select token, b, case when regexp_matches(b, '{RX}') then try_cast(regexp_replace(b, '[$,()+]', '', 'g') as double) end as x from t)
    select token, case when isinf(x) then null when b like '(%' then -abs(x) else x end as number from p"""
)
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number grammar."""
    return inline(spark, TOKENS).select("token", text.parse_numeric(F.col("token")).alias("number"))


MISSES = ("", "  ", "NA", "n/a", "Null", "nan", "none", "-", " - ", "0", "NA_", "NULLS", "--", "x")


@registered(f"select token, upper(trim(token, ' ' || chr(9))) in ('', '-', 'NA', 'N/A', 'NULL', 'NAN', 'NONE') as missing from (values {', '.join(f"('{t}')" for t in MISSES)}) v(token)")
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts mean that there is no value."""
    return inline(spark, MISSES).select("token", text.is_missing(F.col("token")).alias("missing"))


@registered("select delta, case when abs(delta) <= 0.5 then 0.0::double else abs(delta) end as contribution from (values (0.2::double), (0.5::double), (-0.5::double), (0.50001::double), (-3::double), (0::double)) v(delta)")
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes within the tolerance, its bound included, count zero."""
    df = spark.createDataFrame([(x,) for x in (0.2, 0.5, -0.5, 0.50001, -3.0, 0.0)], "delta double")
    return df.select("delta", text.contribution(F.col("delta"), 0.5).alias("contribution"))


@registered(BASE + "select o.k, 'status' as \"column\", o.s as old, n.s as new from o join n on o.k = n.k where o.s <> n.s")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fields that changed."""
    a, b = from_frame(old_orders(spark, sf_dir), "old"), from_frame(new_orders(spark, sf_dir), "new")
    found = cells.field_cells(align.by_key(a, b, 0, 0, [(3, 3), (4, 4)]), [0, 1])
    return found.select(F.col("ord").cast("long").alias("k"), F.get(F.array(F.lit("status"), F.lit("priority")), F.col("col")).alias("column"), F.col("o").alias("old"), F.col("n").alias("new"))


@registered("select 'E_AUDIT_LIMIT' as code, count(*) as numeric_columns_cells from orders")
def audit_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More changes than an exhaustive run may list."""
    o = old_orders(spark, sf_dir).select("k", "custkey")
    v = summary_frame(spark, compare(spark, o, o.withColumn("custkey", F.col("custkey") + 1), key="k", exhaustive=True, max_audit_changes=5))
    return v.select("code", F.col("numeric_cells_checked").alias("numeric_columns_cells"))


@registered("select c_custkey as k from customer where c_custkey % 5 <> 0")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of blanks only are no records."""
    blanked = F.when(F.col("c_custkey") % 5 == 0, F.lit(" \t ")).otherwise(F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit("x")))
    lines = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), blanked.alias("line"))
    t = from_csv(spark, write_lines(spark, lines, "k,v"), "old")
    return t.df.select(F.col("c0").cast("long").alias("k"))


@registered("select line, a, b from (values ('1,2', '1', '2'), ('1', '1', ''), ('1,2,', '1', '2'), ('1,2, ', '1', '2')) v(line, a, b)")
def width_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records are padded, blank extra fields ignored, other extra fields refused."""
    df = spark.createDataFrame([(x,) for x in ("1,2", "1", "1,2,", "1,2, ", "1,2,3")], "line string")
    (a, b), extra = fit_width(F.split("line", ",", -1), 2)
    return df.where(~extra).select("line", a.alias("a"), b.alias("b"))


@registered("select n_name as name, 'u8:' || n_name as plain, 'hex:' || lower(hex(encode(n_name || chr(9)))) as control from nation")
def ident_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as text or, with control characters, as hex."""
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return n.select("name", text.identifier(F.col("name")).alias("plain"), text.identifier(F.concat("name", F.lit("\t"))).alias("control"))


@registered(
    """with o as (select unnest(list(r_name)) as h, 'old' as side from region where r_regionkey <> 0), n as (select unnest(list(r_name)) as h, 'new' as side from region where r_regionkey <> 1)
    select case when o.h is null then 'new_only' when n.h is null then 'old_only' else 'shared' end as role, coalesce(o.h, n.h) as header from o full join n on o.h = n.h"""
)
def header_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers on both sides, and on one only."""
    names = [r.r_name for r in load(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # 5 rows
    old, new = (from_frame(spark.createDataFrame([], ", ".join(f"`{h}` string" for h in hs)), side) for side, hs in (("old", names[1:]), ("new", [names[0], *names[:1:-1]])))
    shared, old_only, new_only = split_headers(old.headers, new.headers)
    found = [("shared", [c[0] for c in shared]), ("old_only", old_only), ("new_only", new_only)]
    return spark.createDataFrame([(role, h.decode()) for role, hs in found for h in hs], "role string, header string")


def stand_in_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as ledger records."""
    e = load(spark, sf_dir, "events")
    outcome = F.when(F.col("event_id") % 3 == 0, "REAL_CHANGE").otherwise("NO_REAL_CHANGE")
    inputs = F.array(F.struct(F.lit("p").alias("path"), F.concat(F.lit("sha256:"), F.hex("user_id")).alias("hash"), F.lit(1).cast("long").alias("bytes")))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("tool"), outcome.alias("outcome"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), inputs.alias("inputs"), F.col("event_id").alias("ordinal"))


LEDGER = """with l as (select cast(event_id as varchar) as id, event_type as tool, case when event_id % 3 = 0 then 'REAL_CHANGE' else 'NO_REAL_CHANGE' end as outcome,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts, event_id as ordinal from events) """
TOOL = "(select min(event_type) from events)"


def first_tool(spark: SparkSession, sf_dir: str) -> str:
    return load(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]


@registered(LEDGER + f"select id, tool, outcome, ts from l where tool = {TOOL} and upper(outcome) = 'REAL_CHANGE' order by ordinal limit 20")
def ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching runs, oldest first."""
    return ledger.query(stand_in_ledger(spark, sf_dir), tool=first_tool(spark, sf_dir), outcome="real_change").select("id", "tool", "outcome", "ts")


@registered(LEDGER + f"select count(*) as n from l where tool = {TOOL} and ts >= (select strftime(min(ts) + interval 1 day, '%Y-%m-%dT%H:%M:%SZ') from events)")
def ledger_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs match."""
    since = load(spark, sf_dir, "events").select(F.date_format(F.min("ts") + F.expr("interval 1 day"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    return stand_in_ledger(spark, sf_dir).where(ledger.matches(tool=first_tool(spark, sf_dir), since=since)).agg(F.count(F.lit(1)).alias("n"))


@registered(LEDGER + "select id, tool, outcome, ts from l order by ordinal desc limit 1")
def ledger_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run."""
    return ledger.last(stand_in_ledger(spark, sf_dir)).select("id", "tool", "outcome", "ts")


@registered(
    """with g as (select 0 as p, o_orderkey as place, cast(o_orderkey as varchar) as row_id from orders where o_orderkey % 1000 = 7
      union all select 1, o_orderkey, cast(o_orderkey as varchar) from orders where o_orderkey % 250 = 7),
    r as (select *, row_number() over (partition by row_id order by p, place) as nth from g)
    select row_id, place, p as priority from r where nth = 1 order by p, place, row_id limit 64"""
)
def repro_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small set of rows that shows the outcome again."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderkey").alias("place"))
    return repro.select_rows([o.where("place % 1000 = 7"), o.where("place % 250 = 7")])
