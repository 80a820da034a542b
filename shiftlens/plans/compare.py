"""The comparison: gates in a fixed order, then a verdict or a refusal."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from shiftlens.functions.formats import parse_identifier
from shiftlens.operators import align, cells
from shiftlens.sources.dialect import Dialect, delimiter_option
from shiftlens.sources.profile import Profile, resolve
from shiftlens.sources.shared import scratch
from shiftlens.sources.table import Table, from_csv, from_frame

from .options import TOP, CompareOptions, UsageError
from .refusal import Refused

COUNTS = (
    "rows_old",
    "rows_new",
    "rows_aligned",
    "columns_old",
    "columns_new",
    "columns_common",
    "columns_old_only",
    "columns_new_only",
    "numeric_columns",
    "numeric_cells_checked",
    "numeric_cells_changed",
)
METRICS = ("total_change", "max_abs_delta", "top_k_coverage")


@dataclass
class Verdict:
    outcome: str
    options: CompareOptions
    names: dict[str, str]
    key: bytes | None = None
    profile: Profile | None = None
    dialects: dict[str, Dialect | None] = field(default_factory=lambda: {"old": None, "new": None})
    counts: dict[str, int | None] = field(default_factory=lambda: dict.fromkeys(COUNTS))
    metrics: dict[str, float | None] = field(default_factory=lambda: dict.fromkeys(METRICS))
    contributors: list[cells.Change] = field(default_factory=list)
    field_changes: list[cells.FieldChange] | None = None
    refusal: Refused | None = None

    @property
    def exit_code(self) -> int:
        return {"NO_REAL_CHANGE": 0, "REAL_CHANGE": 1, "REFUSAL": 2}[self.outcome]


Source = str | DataFrame


def split_headers(old: list[bytes], new: list[bytes]) -> tuple[list[tuple[bytes, int, int]], list[bytes], list[bytes]]:
    """Headers on both sides with their places, and those on the old and the new side only."""
    return [(n, i, new.index(n)) for i, n in enumerate(old) if n in new], [n for n in old if n not in new], [n for n in new if n not in old]


def compare(spark: SparkSession, old: Source, new: Source, options: CompareOptions | None = None, **kw: Any) -> Verdict:
    """Compare two snapshots, each a CSV path or a DataFrame.

    A malformed key identifier or delimiter option raises UsageError; everything else
    that stands in the way of a verdict is a refusal in the result.
    """
    options = replace(options or CompareOptions(), **kw)
    name = lambda s, side: s if isinstance(s, str) else side
    v = Verdict("REFUSAL", options, {"old": name(old, "old"), "new": name(new, "new")})
    try:
        with scratch(spark):
            run(spark, old, new, v)
    except Refused as r:
        v.outcome, v.refusal = "REFUSAL", r
        v.contributors, v.field_changes = [], None
        v.counts = dict.fromkeys(COUNTS) | r.counts
        v.metrics = dict.fromkeys(METRICS) | r.metrics
    return v


def load(spark: SparkSession, source: Source, side: str, forced: str | None, profile: Profile | None) -> Table:
    if isinstance(source, DataFrame):
        return from_frame(source, side)
    return from_csv(spark, source, side, forced, profile.registry.aliases if profile and profile.registry else None)


def run(spark: SparkSession, old_source: Source, new_source: Source, v: Verdict) -> None:
    o = v.options
    try:
        forced = delimiter_option(o.delimiter) if o.delimiter else None
        flag = parse_identifier(o.key) if o.key is not None else None
    except ValueError as e:
        raise UsageError(str(e)) from e
    if o.audit_fields and not o.exhaustive:
        raise Refused("E_AUDIT_FIELDS_REQUIRES_EXHAUSTIVE")
    v.profile = profile = resolve(o.profile, o.profile_id, o.profile_dir)
    if o.audit_fields and profile is None:
        raise Refused("E_AUDIT_FIELDS_REQUIRES_PROFILE")
    if flag is not None and profile and profile.key:
        raise Refused("E_KEY_CONFLICT", {"key_flag": o.key, "profile_key": list(profile.key_labels)})
    v.key = key = flag if flag is not None else profile.key[0] if profile and profile.key else None

    old = load(spark, old_source, "old", forced, profile)
    v.dialects["old"] = old.dialect
    try:
        new = load(spark, new_source, "new", forced, profile)
    except Refused:
        old.check_width()  # what is wrong with the old file comes first
        raise
    v.dialects["new"] = new.dialect

    every, old_only, new_only = split_headers(old.headers, new.headers)
    scoped = set(profile.include) if profile and profile.include is not None else None
    inside = lambda n: n != key and (scoped is None or n in scoped)
    common = [c for c in every if inside(c[0])]
    columns = cells.Columns([c[0] for c in common], [c[1] for c in common], [c[2] for c in common])
    wanted = [(c[1], c[2]) for c in common]
    counts: dict[str, int | None] = {
        "columns_old": sum(map(inside, old.headers)),
        "columns_new": sum(map(inside, new.headers)),
        "columns_common": len(common),
        "columns_old_only": sum(map(inside, old_only)),
        "columns_new_only": sum(map(inside, new_only)),
    }

    if key is not None:
        ko, kn = old.column_of(key), new.column_of(key)
        if ko is None or kn is None:
            old.check_width()
            new.check_width()
            raise Refused("E_NO_KEY", {"key_column": key})
        n_old, n_new, same = align.check_keys(old, new, ko, kn)
        if not same:
            raise Refused("E_KEY_MISMATCH", align.key_differences(old, new, ko, kn))
        aligned = align.by_key(old, new, ko, kn, wanted)
    else:
        try:
            aligned, n_old = align.by_order(old, new, wanted, every)
            n_new = n_old
        except Refused as r:
            r.counts |= counts
            raise

    # both passes below read the joined cells; kept where there is room, else computed again
    aligned.df = aligned.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        decide(old, new, aligned, columns, every, counts | {"rows_old": n_old, "rows_new": n_new, "rows_aligned": n_old}, v)
    finally:
        aligned.df.unpersist()


def decide(old: Table, new: Table, aligned: align.Aligned, columns: cells.Columns, every: list, counts: dict, v: Verdict) -> None:
    o = v.options
    typed = cells.type_columns(aligned, old, new, columns, o.tolerance)
    if typed.rows != counts["rows_aligned"]:
        raise RuntimeError(f"{typed.rows} records aligned of {counts['rows_aligned']}: two evaluations of an input gave different records")
    counts |= {"numeric_columns": len(typed.numeric), "numeric_cells_checked": counts["rows_aligned"] * len(typed.numeric), "numeric_cells_changed": typed.changed}
    if not typed.numeric and not o.audit_fields:
        raise Refused("E_NO_NUMERIC", {}, counts)

    changed = cells.changes(aligned, columns, typed.numeric, o.tolerance) if typed.changed else None
    top = cells.listed(cells.largest(changed), columns, old, aligned.keyed) if typed.changed else []
    found = cells.coverage([c.contribution for c in top], typed.total, o.threshold)
    metrics = {"total_change": typed.total, "max_abs_delta": typed.largest, "top_k_coverage": found.covered}

    if not aligned.keyed and typed.total > 0:
        keys = align.reordered(old, new, every, aligned if len(every) == len(columns.names) else None)
        if keys is not None:
            raise Refused("E_NEED_KEY", {"suggested_keys": keys}, {k: c for k, c in counts.items() if not k.startswith("numeric_cells")})

    if typed.total == float("inf"):
        # two finite numbers can differ by more than a double holds; no share of that is meaningful
        raise Refused("E_DIFFUSE", {"top_k_coverage": 0.0, "threshold": o.threshold}, counts, {"max_abs_delta": None})
    if o.exhaustive:
        other = [k for k in range(len(columns.names)) if k not in typed.numeric]
        differing = cells.field_cells(aligned, other) if o.audit_fields and other else None
        n_fields = differing.count() if differing is not None else 0
        if typed.changed + n_fields > o.max_audit_changes:
            raise Refused("E_AUDIT_LIMIT", {"changed_cells": typed.changed + n_fields, "max_audit_changes": o.max_audit_changes}, counts | {"numeric_cells_changed": None}, metrics)
        if typed.changed > len(top):  # within the limit checked above
            top = cells.listed(changed.collect(), columns, old, aligned.keyed)
        if o.audit_fields:
            v.field_changes = cells.field_changes(differing.collect() if n_fields else [], columns, old, new, aligned.keyed)
        v.contributors = top
        v.outcome = "REAL_CHANGE" if typed.changed or n_fields else "NO_REAL_CHANGE"
        metrics["top_k_coverage"] = 1.0 if typed.changed else None
    elif found.kind == "none":
        v.outcome = "NO_REAL_CHANGE"
    elif found.kind == "diffuse":
        raise Refused("E_DIFFUSE", {"top_k_coverage": found.covered, "threshold": o.threshold}, counts, metrics)
    else:
        v.outcome, v.contributors = "REAL_CHANGE", top[: found.count]
    v.counts = dict.fromkeys(COUNTS) | counts
    v.metrics = metrics


__all__ = ["TOP", "CompareOptions", "Verdict", "compare"]
