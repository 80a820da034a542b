"""URL rules by a sort-merge range join, with DataFrame functions only.

A host's labels, reversed and each ended by a dot, form its canonical key, so that a
rule's host and all its subdomains are one interval of keys, and intervals of rules
nest. Interval starts and ends and the urls are range-sorted together. A sweep along the
order keeps the stack of active rules: a start is pushed, an end pops, so the running sum
of both is the stack's height, a start's height is its level, and level l of the stack is
the last start on it as long as the height is l or more. What a range of the sort starts
with is carried over from the ranges before it. Of the active rules, those whose path
starts the url's path fit; the longest host plus path wins.

A host with a third of all urls is dealt over many ranges, as the page is the last
sort key. There are as many levels as rule hosts nest.

Defined results: a null url, or one without ``://``, has an empty host and path and no
rule; repeated rows are each judged; equal rules with both verdicts block; an empty
table gives an empty result; with no rules every url gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import lower_ascii, materialize, shuffle_partitions

#: The rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
RULE_SCHEMA = "host string, path string, verdict string"
OWN = "array<struct<n:int,rule:string,verdict:string,path:string>>"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame, from literals in the plan."""
    rows = ", ".join("(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r) + ")" for r in rules)
    if not rows:
        return spark.sql("select cast(null as string) host, cast(null as string) path, cast(null as string) verdict where false")
    return spark.sql(f"select * from values {rows} as t(host, path, verdict)")


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(F.regexp_extract(tail, "^[^?#]*", 0), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """Each rule host's interval as a start, with the host's rules, and an end."""
    host = lower_ascii(F.col("host"))
    one = F.struct(F.length(F.concat(host, F.col("path"))).cast("int").alias("n"), F.concat(host, F.col("path")).alias("rule"), F.col("verdict"), F.col("path"))
    own = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != "")).groupBy(host_key(host).alias("hk")).agg(F.collect_set(one).alias("own"))
    k = F.encode("hk", "UTF-8")
    starts = own.select(k.alias("k"), F.lit(0).alias("kind"), F.col("own").cast(OWN).alias("own"))
    ends = own.select(F.concat(k, F.unhex(F.lit("FF"))).alias("k"), F.lit(2).alias("kind"), F.lit(None).cast(OWN).alias("own"))
    return starts.unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict, a row per page."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select(F.encode(host_key(F.col("host")), "UTF-8").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast(OWN).alias("own"), "page_id", "host", "path")
    both = urls.unionByName(rule_events(rules), allowMissingColumns=True)
    salt = F.xxhash64("page_id", "path")
    n = shuffle_partitions(pages.sparkSession)
    ranged = materialize(both.withColumn("_salt", salt).repartitionByRange(n, "k", "kind", "_salt").withColumn("_range", F.spark_partition_id()), "url-sweep")

    push = F.lit(1) - F.col("kind")  # a start 1, a url 0, an end -1
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heights = ranged.groupBy("_range").agg(F.sum(push).alias("_net")).select("_range", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_base"))
    sweep = Window.partitionBy("_range").orderBy("k", "kind", "_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    height = F.col("_base") + F.sum(push).over(sweep)

    def pushed(level: int) -> Column:
        return F.when((F.col("kind") == 0) & (F.col("_height") == level), F.col("own"))

    events = ranged.where("kind != 1").join(heights, "_range").withColumn("_height", height)
    levels = range(1, (events.agg(F.max("_height")).first()[0] or 0) + 1)
    in_range = events.groupBy("_range").agg(F.lit(1).alias("_some"), *(F.max_by(pushed(h), F.when(pushed(h).isNotNull(), F.col("k"))).alias(f"_last{h}") for h in levels))
    carried = heights.join(in_range, "_range", "left").select("_range", "_base", *(F.last(f"_last{h}", ignorenulls=True).over(earlier).alias(f"_carried{h}") for h in levels))
    swept = ranged.join(carried, "_range").withColumn("_height", height)
    swept = swept.select("*", *(F.last(pushed(h), ignorenulls=True).over(sweep).alias(f"_level{h}") for h in levels)).where("kind = 1")
    nothing = F.array().cast(OWN)
    stack = [F.when(F.col("_height") >= h, F.coalesce(f"_level{h}", f"_carried{h}", nothing)).otherwise(nothing) for h in levels]
    fitting = F.filter(F.flatten(F.array(nothing, *stack)), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


ORACLE = r"""
with u as (
  select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u
), r as (
  select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, v)
), m as (
  select h.page_id, h.host, h.path, r.rh || r.rp as rule, r.v,
         row_number() over (partition by h.page_id order by length(r.rh || r.rp) desc nulls last, r.rh || r.rp desc) as n
  from h left join r on (h.host = r.rh or ends_with(h.host, '.' || r.rh)) and starts_with(h.path, r.rp)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
"""
