"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from shiftlens.sources.shared import delete, materialize, new_path, scratch, shared_dir, write_table

__all__ = ["WORD", "delete", "lower_ascii", "map_rows", "materialize", "new_path", "scratch", "shared_dir", "shuffle_partitions", "slices", "table", "unused", "write_table"]

#: A word, for Java, Python and DuckDB alike: a run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the frame has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` by position, whatever the columns are called (it can't take names with dots)."""
    inner = StructType([StructField(f"_{k}", f.dataType) for k, f in enumerate(schema.fields)])
    names = inner.names

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return df.toDF(*(f"_{k}" for k in range(len(df.columns)))).mapInArrow(renamed, inner).toDF(*schema.names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, for work whose results are larger than its texts."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
