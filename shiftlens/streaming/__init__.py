"""Streaming forms of the ledger scan and of a comparison of arriving snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftlens.plans.compare import Verdict, compare
from shiftlens.sources import ledger


def ledger_stream(spark: SparkSession, folder: str, **filters: str | None) -> DataFrame:
    """The matching records of ledger files as they arrive."""
    lines = spark.readStream.text(folder).select(F.from_json("value", ledger.SCHEMA).alias("r"))
    return lines.where("r.id is not null").select("r.*").where(ledger.matches(**filters))


def compare_stream(current: DataFrame, arriving: DataFrame, report: Callable[[int, Verdict], None], **options) -> StreamingQuery:
    """Compare each batch of arriving rows, as a whole snapshot, with the current one."""

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            report(n, compare(df.sparkSession, current, df, **options))
        finally:
            df.unpersist()

    return arriving.writeStream.foreachBatch(batch).start()
