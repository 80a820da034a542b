"""The comparison and the driver contract stand without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
IMPORT = """
import __spark_entry__ as e
assert "diff_topk" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""


def copy_without(folder, *gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py", "shiftlens", "tests"):
        if not (ROOT / name).exists():
            continue
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, folder / name, ignore=shutil.ignore_patterns("__pycache__"))
        else:
            shutil.copy(ROOT / name, folder)
    for name in gone:
        if (folder / name).is_dir():
            shutil.rmtree(folder / name)
        elif (folder / name).exists():
            (folder / name).unlink()


@pytest.mark.parametrize("gone", [("shiftlens/llm", "tests/llm"), ("shiftlens/llm", "tests/llm", "corpus_pipeline.py")], ids=["folders", "folders and pipeline"])
def test_entry_with_the_folders_deleted(tmp_path, gone):
    copy_without(tmp_path, *gone)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", IMPORT], cwd=tmp_path, check=True, env=env)
    # the other tests are collected there without an error, and those that need no tables of their own pass
    quick = ["tests/test_text_and_formats.py", "tests/test_dialect.py"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "--collect-only", "tests"], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *quick], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "shiftlens").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"shiftlens\.llm|import llm|from \.+llm", p.read_text()), p
