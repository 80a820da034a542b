"""Read-only diagnostics: health, capabilities, and help with refusals."""

from __future__ import annotations

import importlib.util
import shutil
from typing import Any

from shiftlens.plans.refusal import PROGRAM, REASONS

HINTS = {
    "E_MIXED_TYPES": "leave the column out with a profile, or clean its values",
    "E_MISSINGNESS": "fill in the missing side, or leave the column out with a profile",
    "E_NEED_KEY": "rerun with one of the suggested keys",
    "E_DIFFUSE": "lower the threshold, or list every change with --exhaustive",
    "E_DIALECT": "force the delimiter with --delimiter",
    "E_AUDIT_LIMIT": "raise --max-audit-changes to the reported count",
}


COMMANDS = {
    "OLD NEW [--key K] [--json]": "compare two CSV files",
    "ledger query | last | count": "what was run before",
    "doctor health | capabilities | report | docs | triage CODE": "diagnostics, which change nothing",
    "--describe, --schema, --version": "the refusals and commands, the JSON form, the version",
}


def health() -> dict[str, Any]:
    found = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas")}
    found["java"] = shutil.which("java") is not None
    return {"program": PROGRAM, "ok": all(found.values()), "checks": found}


def capabilities() -> dict[str, Any]:
    return {
        "program": PROGRAM,
        "inputs": ["csv", "dataframe"],
        "outcomes": {"NO_REAL_CHANGE": 0, "REAL_CHANGE": 1, "REFUSAL": 2},
        "refusals": dict(REASONS),
        "commands": list(COMMANDS),
    }


def report() -> dict[str, Any]:
    """Health, each finding with what to do, and what the program can do."""
    found = health()
    missing = [m for m, there in found["checks"].items() if not there]
    return found | {"findings": [{"missing": m, "next": f"install {m} where the driver runs"} for m in missing], "capabilities": capabilities()}


def guide() -> str:
    """How to use the program, and what its exit codes and refusals mean."""
    lines = [f"# {PROGRAM}", "", "Commands:", *(f"  {PROGRAM} {c}: {what}" for c, what in COMMANDS.items()), "", "Exit codes:"]
    lines += [f"  {n}: {o.replace('_', ' ').lower()}" for o, n in capabilities()["outcomes"].items()]
    lines += ["", "Refusals:", *(f"  {c}: {why}; {HINTS.get(c, 'see its next step')}" for c, why in REASONS.items())]
    return "\n".join(lines) + "\n"


def triage(code: str) -> dict[str, str]:
    """What a refusal means and what usually resolves it."""
    if code not in REASONS:
        raise ValueError(f"unknown refusal code {code!r}")
    return {"code": code, "reason": REASONS[code], "fix": HINTS.get(code, "follow the refusal's next step")}
