"""From links to groups: connected components, and one document of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import delete, materialize, unused, write_table

#: Up to so many rows of keys are broadcast; a row is under 100 bytes.
BROADCAST_ROWS = 300_000


def components(pairs: DataFrame) -> DataFrame:
    """node and root, for every node with a link: the smallest node that it reaches."""
    spark = pairs.sparkSession
    edges, path = write_table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "links")

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = mark(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        new, new_path = write_table(small.unionByName(small_least.select("u", F.col("w").alias("v"))).where("u != v").distinct(), "links")
        new_state = mark(new)
        delete(spark, path)
        edges, path = new, new_path
        if new_state == state:
            break
        state = new_state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def light(keys: DataFrame) -> DataFrame:
    """Written rows of a few numbers, broadcast if there are few enough; a join with more shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component of ``found`` (doc_id, th, component) the row of ``docs`` that keep_one keeps.

    What meets the texts is a row for each that goes, and for each that is wholly
    repeated; only the texts of the latter are shuffled, unless those rows are many.
    """
    doc_id, none, th, n, row = unused(docs, "__id", "__none", "__th", "__n", "__row")
    key = [F.coalesce("doc_id", F.lit(0)).alias(doc_id), F.col("doc_id").isNull().alias(none), F.col("th").alias(th)]
    keyed = materialize(found.groupBy(*key, "component").agg(F.count(F.lit(1)).alias(n)), "keyed")
    best = keyed.groupBy("component").agg(F.min(F.struct(none, doc_id, th)).alias("best"))
    judged = keyed.join(best, "component").withColumn(n, F.when(F.struct(none, doc_id, th) == F.col("best"), F.col(n)).otherwise(0))
    judged = materialize(judged.where(F.col(n) != 1).select(doc_id, none, th, n), "judged")  # 0: goes; more than 1: one of them stays

    rows = docs.select("*", F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias(doc_id), docs["doc_id"].isNull().alias(none), F.xxhash64("text").alias(th))
    marked = rows.join(light(judged), [doc_id, none, th], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.where(F.col(n).isNull()).select(*columns)
    if not judged.where(F.col(n) > 1).take(1):
        return once
    same = Window.partitionBy(doc_id, none, th).orderBy(F.xxhash64(*columns))
    repeated = marked.where(F.col(n) > 1).withColumn(row, F.row_number().over(same)).where(F.col(row) == 1)
    return once.unionByName(repeated.select(*columns))
