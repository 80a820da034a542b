"""A verdict as JSON, as text, and as a one-row DataFrame."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions import formats as f

from .compare import COUNTS, METRICS, Verdict
from .options import TOP
from .refusal import PROGRAM

VERSION = f"{PROGRAM}.v1"


def to_dict(v: Verdict) -> dict[str, Any]:
    """The fields of the JSON form, in their order."""
    o, total, running, contributors = v.options, v.metrics.get("total_change") or 0.0, 0.0, []
    for c in v.contributors:
        share = c.contribution / total if total else 0.0
        running += share
        values = {"old": c.old, "new": c.new, "delta": c.delta, "contribution": c.contribution} if o.explicit else {}
        contributors.append({"row_id": f.ident_json(c.row), "column": f.ident_json(c.column), **values, "share": share, "cumulative_share": running})
    out: dict[str, Any] = {"version": VERSION, "outcome": v.outcome}
    if o.exhaustive:
        out["mode"] = "exhaustive_numeric"
    p = v.profile
    out |= {
        "profile_id": p.profile_id if p else None,
        "profile_sha256": p.sha256 if p else None,
        "files": dict(v.names),
        "alignment": {"mode": "row_order" if v.key is None else "key", "key_column": None if v.key is None else f.ident_json(v.key)},
        "dialect": {s: d.to_json() if d else None for s, d in v.dialects.items()},
        "threshold": o.threshold,
        "tolerance": o.tolerance,
        "counts": {k: v.counts.get(k) for k in COUNTS},
        "metrics": dict(v.metrics),
        "limits": {"max_contributors": o.max_audit_changes if o.exhaustive else TOP},
    }
    if p and p.registry:
        out["column_registry"] = {"reference": p.registry.reference, "hash": p.registry.hash}
    if o.exhaustive and v.outcome != "REFUSAL":
        out["audit"] = {"numeric_changes_emitted": len(contributors), "field_changes_emitted": len(v.field_changes or []), "truncated": False}
    out["contributors"] = contributors
    if v.field_changes is not None:
        values = lambda c: {"old": f.ident_json(c.old), "new": f.ident_json(c.new)} if o.explicit else {}
        out["field_changes"] = [{"row_id": f.ident_json(c.row), "column": f.ident_json(c.column), **values(c)} for c in v.field_changes]
    r = v.refusal
    out["refusal"] = {"code": r.code, "message": r.reason, "detail": r.detail_json()} if r else None
    return out


def to_json(v: Verdict) -> str:
    return json.dumps(to_dict(v), ensure_ascii=False, allow_nan=False)


#: The JSON form's fields: name, type (``?`` may be null), and whether the field is always there.
FIELDS = (
    ("version", "string", True),
    ("outcome", ("REAL_CHANGE", "NO_REAL_CHANGE", "REFUSAL"), True),
    ("mode", ("exhaustive_numeric",), False),
    ("profile_id", "string?", True),
    ("profile_sha256", "string?", True),
    ("files", {"old": "string", "new": "string"}, True),
    ("alignment", {"mode": ("key", "row_order"), "key_column": "string?"}, True),
    ("dialect", {"old": "object?", "new": "object?"}, True),
    ("threshold", "number", True),
    ("tolerance", "number", True),
    ("counts", dict.fromkeys(COUNTS, "integer?"), True),
    ("metrics", dict.fromkeys(METRICS, "number?"), True),
    ("limits", {"max_contributors": "integer"}, True),
    ("column_registry", {"reference": "string", "hash": "string"}, False),
    ("audit", {"numeric_changes_emitted": "integer", "field_changes_emitted": "integer", "truncated": "boolean"}, False),
    ("contributors", [({"row_id": "string", "column": "string", "share": "number", "cumulative_share": "number"}, dict.fromkeys(("old", "new", "delta", "contribution"), "number"))], True),
    ("field_changes", [({"row_id": "string", "column": "string"}, {"old": "string", "new": "string"})], False),
    ("refusal", "object?", True),
)


def json_schema() -> dict[str, Any]:
    """A JSON Schema of what ``to_json`` gives, from the table of its fields."""

    def of(kind: Any) -> dict[str, Any]:
        if isinstance(kind, str):
            return {"type": [kind[:-1], "null"] if kind.endswith("?") else kind}
        if isinstance(kind, tuple):
            return {"type": "string", "enum": list(kind)}
        if isinstance(kind, dict):
            return {"type": "object", "properties": {k: of(v) for k, v in kind.items()}, "required": list(kind)}
        always, explicit = kind[0]
        item = of(always)
        return {"type": "array", "items": item | {"properties": item["properties"] | {k: of(v) for k, v in explicit.items()}}}

    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "title": VERSION,
        "type": "object",
        "properties": {name: of(kind) for name, kind, _ in FIELDS},
        "required": [name for name, _, always in FIELDS if always],
    }


def summary_frame(spark: SparkSession, v: Verdict) -> DataFrame:
    """One row: the outcome, the counters and the metrics."""
    cells = [F.lit(v.outcome).alias("outcome"), F.lit(v.refusal.code if v.refusal else None).cast("string").alias("code")]
    cells += [F.lit(v.counts.get(k)).cast("long").alias(k) for k in COUNTS]
    cells += [F.lit(x).cast("double").alias(k) for k, x in v.metrics.items()]
    return spark.range(1).select(*cells)


def settings(v: Verdict) -> str:
    return f"Settings: threshold={f.percent(v.options.threshold)} tolerance={f.shortest(v.options.tolerance)}"


def dialect_lines(v: Verdict) -> list[str]:
    if not (v.dialects["old"] and v.dialects["new"]):
        return []
    say = lambda d: f'delimiter={f.byte_name(ord(d.delimiter))} quote=" escape={chr(92) if d.backslash else "none"}'
    return [f"Dialect({s}): {say(v.dialects[s])}" for s in ("old", "new")]


def to_text(v: Verdict) -> str:
    names = {s: os.path.basename(n) or n for s, n in v.names.items()}
    c, n = v.counts, f.with_commas
    lines = [f"Compared: {names['old']} -> {names['new']}", "Alignment: " + ("row-order (no key)" if v.key is None else f"key={f.ident_human(v.key)}")]
    if v.profile and v.profile.profile_id:
        lines.append(f"Profile: {v.profile.profile_id}" + (f" ({v.profile.sha256})" if v.profile.sha256 else ""))
    if v.refusal:
        r = v.refusal
        lines += [*dialect_lines(v), settings(v), "", "Cannot produce a verdict.", f"Reason ({r.code}): {r.reason}.", f"Example: {r.example(names)}", f"Next: {r.next_step(v.names['old'], v.names['new'])}"]
        return "\n".join([f"{PROGRAM.upper()} ERROR ({r.code})", "", *lines]) + "\n"
    lines += [
        f"Columns: common={n(c['columns_common'])} old_only={n(c['columns_old_only'])} new_only={n(c['columns_new_only'])}",
        f"Checked: {n(c['rows_aligned'])} rows, {n(c['numeric_columns'])} numeric columns ({n(c['numeric_cells_checked'])} cells)",
        *dialect_lines(v),
        "Ranked by: size of the change, not scaled",
        settings(v),
        "",
    ]
    label = lambda x: f"{f.ident_human(x.row)}.{f.ident_human(x.column)}"
    numbered = lambda x, k: f"{k}. {label(x)}  {f.signed(x.delta)}" + (f"  ({f.value(x.old)} -> {f.value(x.new)})" if v.options.explicit else "") if v.options.explicit else f"{k}. {label(x)}"
    tolerance = f.shortest(v.options.tolerance)
    if v.outcome == "NO_REAL_CHANGE":
        lines += [f"Largest change: {f.shortest(v.metrics['max_abs_delta'] or 0.0)} (<= tolerance {tolerance}).", "No number in a common column changed by more than that."]
    elif v.options.exhaustive:
        lines += [f"{n(len(v.contributors))} numeric changes:", "", *(numbered(x, k) for k, x in enumerate(v.contributors, 1))]
        if v.field_changes is not None:
            show = lambda x: f"  ({f.ident_human(x.old)} -> {f.ident_human(x.new)})" if v.options.explicit else ""
            lines += ["", f"{n(len(v.field_changes))} field changes:", "", *(f"{k}. {label(x)}{show(x)}" for k, x in enumerate(v.field_changes, 1))]
    else:
        total = v.metrics["total_change"]
        shown = sum(x.contribution for x in v.contributors) / total
        few = len(v.contributors)
        lines += [f"{f.percent(shown)} of the change is in {few} {'cell' if few == 1 else 'cells'} (asked for: {f.percent(v.options.threshold)}):", ""]
        lines += [numbered(x, k) for k, x in enumerate(v.contributors, 1)]
        lines += ["", "All other numbers stayed within the tolerance or add the remaining share."]
    return "\n".join([PROGRAM.upper(), "", v.outcome.replace("_", " "), "", *lines]) + "\n"
