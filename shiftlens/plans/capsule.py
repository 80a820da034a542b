"""Replay capsules: a folder with inputs, output, settings and a script that runs the comparison again."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from shiftlens.functions.formats import ident_json, shell_quote
from shiftlens.sources.ledger import file_digest
from shiftlens.sources.profile import render_profile

from .compare import Verdict
from .refusal import PROGRAM


def replay_command(v: Verdict, old: str, new: str, profile: str | None) -> str:
    o = v.options
    args = ["python", "-m", PROGRAM, old, new, "--threshold", repr(o.threshold), "--tolerance", repr(o.tolerance)]
    if o.key is not None:
        args += ["--key", o.key]
    if o.delimiter:
        args += ["--delimiter", o.delimiter]
    if profile:
        args += ["--profile", profile]
    if o.exhaustive:
        args += ["--exhaustive", "--max-audit-changes", str(o.max_audit_changes)]
    if o.audit_fields:
        args.append("--audit-fields")
    return " ".join(map(shell_quote, args))


def write_capsule(v: Verdict, output: str, folder: str) -> str | None:
    """Write the capsule of a comparison of two local files; None where a file can't be read or written."""
    try:
        digests = [file_digest(v.names[s])[0] for s in ("old", "new")]
        stamp = hashlib.sha256("\0".join([*digests, output, repr(v.options)]).encode()).hexdigest()
        root = Path(folder) / f"capsule-{stamp[:16]}"
        root.mkdir(parents=True, exist_ok=True)
        for s in ("old", "new"):
            shutil.copyfile(v.names[s], root / f"{s}.csv")
        (root / "output.txt").write_text(output)
        profile = None
        if v.profile:
            local = None
            if v.profile.registry:
                local = "registries/column_registry"
                shutil.rmtree(root / local, ignore_errors=True)
                (root / local).mkdir(parents=True)
                for name, b in v.profile.registry.files:
                    (root / local / name).write_bytes(b)
            (root / "profile.yaml").write_text(render_profile(v.profile, local))
            profile = "profile.yaml"
        command = replay_command(v, "old.csv", "new.csv", profile)
        (root / "replay.sh").write_text(f'#!/bin/sh\nset -u\ncd "$(dirname "$0")"\n{command}\n')
        os.chmod(root / "replay.sh", 0o755)
        files = {str(p.relative_to(root)): file_digest(str(p))[0].removeprefix("sha256:") for p in sorted(root.rglob("*")) if p.is_file() and p.name != "manifest.json"}
        manifest = {"outcome": v.outcome, "key": None if v.key is None else ident_json(v.key), "replay": command, "sha256": files}
        (root / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True) + "\n")
        return str(root)
    except OSError:
        return None
