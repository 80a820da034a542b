"""Cells of aligned records: joint typing, contributions, totals, the largest changes, field changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions.text import contribution, is_missing, parse_numeric
from shiftlens.plans.options import TOP
from shiftlens.plans.refusal import Refused
from shiftlens.sources.table import Table

from .align import Aligned


@dataclass
class Columns:
    """The compared columns: name, place in the old header, and places of their cells in the aligned frame."""

    names: list[bytes]
    old: list[int]
    new: list[int]


@dataclass
class Typed:
    rows: int
    numeric: list[int]
    total: float
    largest: float
    changed: int


def long_cells(a: Aligned, columns: Columns, only: list[int] | None = None, differing: bool = False) -> DataFrame:
    """A row per cell (or per cell whose texts differ): ord, col, texts, numbers and whether each side is missing.

    Where the texts are the same the second is not parsed again.
    """
    wanted = range(len(columns.names)) if only is None else only
    # texts are spread first, so that the grammar is one expression however many columns there are
    parts = F.array(*(F.struct(F.lit(k).alias("col"), F.col(f"o{k}").alias("o"), F.col(f"n{k}").alias("n")) for k in wanted))
    if differing:
        parts = F.filter(parts, lambda c: c["o"] != c["n"])
    cells = a.df.select("ord", F.explode(parts).alias("c")).select("ord", "c.*")
    o, n, same = F.col("o"), F.col("n"), F.col("o") == F.col("n")
    cells = cells.select("*", parse_numeric(o).alias("x")).select("*", (F.col("x").isNull() & is_missing(o)).alias("mo"))
    return cells.select("*", F.when(same, F.col("x")).otherwise(parse_numeric(n)).alias("y"), F.when(same, F.col("mo")).otherwise(is_missing(n)).alias("mn"))


def first(condition: Column, *what: Column) -> Column:
    return F.min(F.when(condition, F.struct(*what)))


def type_columns(a: Aligned, old: Table, new: Table, columns: Columns, tolerance: float) -> Typed:
    """One pass that types the columns jointly and totals the numeric changes.

    A cell is numeric if both sides are numbers; text if a side is text; a conflict if
    a number meets a missing value. The first conflict in record and column order is
    refused: a number against missing where it stands, a mix of numbers and text where
    both have been seen. Counts alone tell whether there is one; only then a second pass
    finds where.
    """
    if not columns.names:
        return Typed(a.df.count(), [], 0.0, 0.0, 0)
    cells = long_cells(a, columns)
    x, y, mo, mn = F.col("x").isNotNull(), F.col("y").isNotNull(), F.col("mo"), F.col("mn")
    text_old, text_new = ~mo & ~x, ~mn & ~y
    by_old = text_old  # both text, too: the old side is named
    size = contribution(F.col("y") - F.col("x"), tolerance)
    stats = cells.groupBy("col").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(x & y).alias("n"),
        F.count_if(text_old | text_new).alias("t"),
        F.count_if(mo & y | mn & x).alias("m"),
        F.sum(size).alias("total"),
        F.max(F.abs(F.col("y") - F.col("x"))).alias("largest"),
        F.count_if(size > 0).alias("changed"),
    )
    found = {r["col"]: r for r in stats.collect()}  # a row a column
    if any(r["m"] or r["n"] and r["t"] for r in found.values()):
        where = cells.groupBy("col").agg(
            F.min(F.when(x & y, F.col("ord"))).alias("n"),
            first(text_old | text_new, F.col("ord"), F.when(by_old, F.lit("old")).otherwise(F.lit("new")).alias("side"), F.when(by_old, F.col("o")).otherwise(F.col("n")).alias("v")).alias("t"),
            first(mo & y | mn & x, F.col("ord"), F.when(mn, F.lit("old")).otherwise(F.lit("new")).alias("side"), F.when(mn, F.col("o")).otherwise(F.col("n")).alias("v")).alias("m"),
        )
        conflicts = []
        for r in where.collect():
            if r["m"]:
                conflicts.append((r["m"]["ord"], r["col"], "E_MISSINGNESS", r["m"]))
            if r["n"] is not None and r["t"]:
                conflicts.append((max(r["n"], r["t"]["ord"]), r["col"], "E_MIXED_TYPES", r["t"]))
        _, k, code, cell = min(conflicts, key=lambda c: c[:2])
        t = old if cell["side"] == "old" else new
        at = {"key": t.bytes_of(cell["ord"])} if a.keyed else {"record": cell["ord"]}
        raise Refused(code, {"file": cell["side"], "column": columns.names[k], "value": t.bytes_of(cell["v"]), **at})
    numeric = sorted(k for k, r in found.items() if r["n"])
    use = [found[k] for k in numeric]
    rows = next(iter(found.values()))["rows"] if found else 0
    return Typed(rows, numeric, sum((r["total"] or 0.0 for r in use), 0.0), max((r["largest"] or 0.0 for r in use), default=0.0), sum(r["changed"] for r in use))


def changes(a: Aligned, columns: Columns, numeric: list[int], tolerance: float) -> DataFrame:
    """The numeric cells that changed: ord, col, x, y, delta, contribution."""
    cells = long_cells(a, columns, numeric, differing=True).select("ord", "col", "x", "y", (F.col("y") - F.col("x")).alias("delta"))
    return cells.withColumn("contribution", contribution(F.col("delta"), tolerance)).where("contribution > 0")


@dataclass
class Change:
    row: bytes
    order: object
    column: bytes
    old: float
    new: float
    delta: float
    contribution: float


def listed(rows: list, columns: Columns, t: Table, keyed: bool) -> list[Change]:
    """In display order: the largest first, then by record, then by the column's bytes."""
    out = [Change(t.bytes_of(r["ord"]) if keyed else str(r["ord"]).encode(), r["ord"], columns.names[r["col"]], r["x"], r["y"], r["delta"], r["contribution"]) for r in rows]
    return sorted(out, key=lambda c: (-c.contribution, c.order, c.column))


def largest(df: DataFrame, n: int = TOP) -> list:
    """The n largest changes; ties at the cut go to the earlier record, then the earlier column."""
    return df.orderBy(F.desc("contribution"), "ord", "col").limit(n).collect()


@dataclass
class Coverage:
    kind: str  # none, diffuse or prefix
    count: int = 0
    covered: float | None = None


def coverage(contributions: list[float], total: float, threshold: float) -> Coverage:
    """The least prefix that covers the threshold of the total, if the largest changes do at all."""
    if not 0 < total < float("inf"):
        return Coverage("none")
    top = sum(contributions) / total
    if top < threshold:
        return Coverage("diffuse", len(contributions), top)
    running = 0.0
    for k, c in enumerate(contributions, 1):
        running += c
        if running / total >= threshold:
            break
    return Coverage("prefix", k, top)


@dataclass
class FieldChange:
    row: bytes
    order: object
    column: bytes
    old: bytes
    new: bytes


def field_cells(a: Aligned, only: list[int]) -> DataFrame:
    """The cells of the given columns whose texts differ: ord, col, o, n."""
    parts = F.array(*(F.struct(F.lit(k).alias("col"), F.col(f"o{k}").alias("o"), F.col(f"n{k}").alias("n")) for k in only))
    return a.df.select("ord", F.explode(F.filter(parts, lambda c: c["o"] != c["n"])).alias("c")).select("ord", "c.*")


def field_changes(rows: list, columns: Columns, old: Table, new: Table, keyed: bool) -> list[FieldChange]:
    out = [FieldChange(old.bytes_of(r["ord"]) if keyed else str(r["ord"]).encode(), r["ord"], columns.names[r["col"]], old.bytes_of(r["o"]), new.bytes_of(r["n"])) for r in rows]
    return sorted(out, key=lambda c: (c.order, c.column))
