"""The command line: compare two CSV files, query the ledger, diagnose."""

from __future__ import annotations

import argparse
import json
import os
import sys

from shiftlens import doctor
from shiftlens.plans import render
from shiftlens.plans.options import CompareOptions, UsageError
from shiftlens.plans.refusal import PROGRAM
from shiftlens.plans.render import VERSION
from shiftlens.sources import paths

def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(PROGRAM, description="Explain the numeric change between two snapshots.")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--key")
    p.add_argument("--threshold", type=float, default=0.95)
    p.add_argument("--tolerance", type=float, default=1e-9)
    p.add_argument("--delimiter")
    p.add_argument("--profile")
    p.add_argument("--profile-id")
    p.add_argument("--exhaustive", action="store_true")
    p.add_argument("--audit-fields", action="store_true")
    p.add_argument("--max-audit-changes", type=int, default=10_000)
    p.add_argument("--explicit", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--capsule-dir")
    p.add_argument("--ledger")
    p.add_argument("--no-ledger", action="store_true")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(PROGRAM).config("spark.ui.enabled", "false").getOrCreate()


def ledger_command(args: list[str]) -> int:
    from shiftlens.sources import ledger

    p = argparse.ArgumentParser(f"{PROGRAM} ledger")
    p.add_argument("what", choices=("query", "last", "count"))
    p.add_argument("--path")
    for name in ("tool", "since", "until", "outcome", "input-hash"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int, default=ledger.DEFAULT_LIMIT)
    p.add_argument("--json", action="store_true")
    a = p.parse_args(args)
    df = ledger.scan(session(), a.path or paths.ledger_path())
    filters = {"tool": a.tool, "since": a.since, "until": a.until, "outcome": a.outcome, "input_hash": a.input_hash}
    if a.what == "count":
        n = ledger.count(df, **filters)
        print(json.dumps({"count": n}) if a.json else n)
        return 0
    rows = (ledger.last(df) if a.what == "last" else ledger.query(df, a.limit, **filters)).drop("ordinal").collect()
    if a.json:
        print(json.dumps([r.asDict(recursive=True) for r in rows]))
    else:
        print("\n".join(ledger.table_lines(rows)))
    return 1 if a.what == "last" and not rows else 0


def doctor_command(args: list[str]) -> int:
    """Read-only diagnostics; exit 1 if something is found, 2 if it can't be done."""
    what = args[0] if args else "health"
    if "--fix" in args:
        print(f"{PROGRAM}: diagnostics change nothing; `doctor report` says what to do", file=sys.stderr)
        return 2
    if what == "docs":
        print(doctor.guide(), end="")
        return 0
    try:
        out = {"health": doctor.health, "capabilities": doctor.capabilities, "report": doctor.report, "triage": lambda: doctor.triage(*args[1:2])}[what]()
    except (KeyError, TypeError, ValueError):
        print(f"{PROGRAM}: doctor health | capabilities | report | docs | triage CODE", file=sys.stderr)
        return 2
    print(json.dumps(out, indent=1))
    return int(what in ("health", "report") and not out["ok"])


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["ledger"]:
        return ledger_command(argv[1:])
    if argv[:1] == ["doctor"]:
        return doctor_command(argv[1:])
    for flag, show in (("--describe", doctor.capabilities), ("--schema", render.json_schema)):  # before the arguments are looked at
        if flag in argv:
            print(json.dumps(show(), indent=1))
            return 0
    a = parser().parse_args(argv)
    from shiftlens.plans import capsule, compare
    from shiftlens.sources import ledger

    try:
        options = CompareOptions(a.key, a.threshold, a.tolerance, a.delimiter, a.profile, a.profile_id, None, a.exhaustive, a.audit_fields, a.max_audit_changes, a.explicit)
        v = compare.compare(session(), a.old, a.new, options)
    except UsageError as e:
        print(f"{PROGRAM}: {e}", file=sys.stderr)
        return 2
    output = render.to_json(v) + "\n" if a.json else render.to_text(v)
    print(output, end="", file=sys.stderr if v.outcome == "REFUSAL" and not a.json else sys.stdout)
    if a.capsule_dir:
        capsule.write_capsule(v, output, a.capsule_dir)
    if not a.no_ledger:
        inputs = []
        for path in (a.old, a.new):
            if os.path.isfile(path):
                found, size = ledger.file_digest(path)
                inputs.append({"path": path, "hash": found, "bytes": size})
        params = {k: x for k, x in vars(a).items() if k in ("key", "threshold", "tolerance", "delimiter", "exhaustive", "audit_fields") and x is not None}
        try:
            ledger.append(a.ledger or paths.ledger_path(), ledger.make_record(PROGRAM, VERSION, inputs, params, v.outcome, v.exit_code, output))
        except OSError as e:
            print(f"{PROGRAM}: ledger not written: {e}", file=sys.stderr)
    return v.exit_code
