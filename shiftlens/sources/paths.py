"""Where the program keeps its ledger and profiles: an environment variable, else a folder in the user's home."""

from __future__ import annotations

import os
import shutil
import sys
from pathlib import Path

LEDGER, PROFILES, HOME = "SHIFTLENS_LEDGER", "SHIFTLENS_PROFILES", "SHIFTLENS_HOME"
#: Places under the user's home that other programs of this kind use; what stands there is taken over once.
OLDER = (".local/share/shiftlens", ".config/shiftlens")


def home() -> Path:
    return Path(os.environ.get(HOME) or Path.home() / ".shiftlens")


def settled(name: str) -> Path:
    """A file or folder of the home folder. If it isn't there but in an older place, it is copied, for its owner alone."""
    target = home() / name
    for older in OLDER:
        source = Path.home() / older / name
        if target.exists() or not source.exists():
            continue
        try:
            target.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
            if source.is_dir():
                shutil.copytree(source, target)
            else:
                shutil.copyfile(source, target)
            for p in (target, *(target.rglob("*") if target.is_dir() else ())):
                p.chmod(0o700 if p.is_dir() else 0o600)
            print(f"copied {source} to {target}; the old one is no longer read", file=sys.stderr)
        except OSError as e:
            print(f"{source} could not be copied to {target}: {e}", file=sys.stderr)
    return target


def ledger_path() -> str:
    return os.environ.get(LEDGER) or str(settled("ledger.jsonl"))


def profile_folder() -> Path:
    return Path(os.environ[PROFILES]) if os.environ.get(PROFILES) else settled("profiles")
