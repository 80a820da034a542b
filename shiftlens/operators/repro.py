"""Choosing a small set of rows and columns that shows an outcome again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

ROWS, MOST_ROWS = 64, 1024
COLUMNS, MOST_COLUMNS = 16, 128


def bounded(n: int | None, usual: int, most: int) -> int:
    return min(most, usual if n is None else max(0, n))


def select_rows(groups: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Rows (``row_id``, ``place``) of several groups, earlier groups first, each row once, up to the limit."""
    ranked = reduce(DataFrame.unionByName, (g.select("row_id", "place", F.lit(k).alias("priority")) for k, g in enumerate(groups)))
    once = Window.partitionBy("row_id").orderBy("priority", "place")
    kept = ranked.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    return kept.orderBy("priority", "place", "row_id").limit(bounded(limit, ROWS, MOST_ROWS))


def select_columns(key: bytes | None, groups: list[list[bytes]], limit: int | None = None) -> list[bytes]:
    """The key first, then columns of the groups in turn, each once, up to the limit."""
    return list(dict.fromkeys([*([key] if key is not None else []), *(c for g in groups for c in g)]))[: bounded(limit, COLUMNS, MOST_COLUMNS)]
