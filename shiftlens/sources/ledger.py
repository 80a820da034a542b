"""The run ledger: an append-only file of JSON lines, and queries on it."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = (
    "id string, tool string, version string, binary_hash string, inputs array<struct<path:string,hash:string,bytes:bigint>>, "
    "params map<string,string>, outcome string, exit_code int, output_hash string, ts string"
)
DEFAULT_LIMIT = 20


def canonical(record: dict[str, Any]) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def file_digest(path: str) -> tuple[str, int]:
    """The digest and size of a local file, read a block at a time."""
    with open(path, "rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
        return f"sha256:{found}", f.tell()


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def make_record(tool: str, version: str, inputs: list[dict], params: dict, outcome: str, exit_code: int, output: str, ts: str | None = None) -> dict:
    """A record whose id is the digest of its canonical form with an empty id."""
    record = {
        "id": "",
        "tool": tool,
        "version": version,
        "binary_hash": digest(version.encode()),
        "inputs": inputs,
        "params": {k: str(v) for k, v in params.items()},
        "outcome": outcome,
        "exit_code": exit_code,
        "output_hash": digest(output.encode()),
        "ts": ts or now(),
    }
    return record | {"id": digest(canonical(record).encode())}


def append(path: str, record: dict) -> None:
    """One line, flushed to disk; earlier lines are never touched."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write(canonical(record) + "\n")
        out.flush()
        os.fsync(out.fileno())


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The records with their place in ``ordinal``; malformed lines are skipped, a missing file is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA + ", ordinal long")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    return lines.where("r.id is not null and r.tool is not null and r.outcome is not null").select("r.*", "ordinal")


def matches(tool: str | None = None, since: str | None = None, until: str | None = None, outcome: str | None = None, input_hash: str | None = None) -> Column:
    """The ledger filter; timestamps compare as text."""
    keep = F.lit(True)
    if tool is not None:
        keep &= F.col("tool") == tool
    if since is not None:
        keep &= F.col("ts") >= since
    if until is not None:
        keep &= F.col("ts") <= until
    if outcome is not None:
        keep &= F.upper("outcome") == outcome.upper()
    if input_hash is not None:
        keep &= F.exists("inputs", lambda i: F.contains(i["hash"], F.lit(input_hash)))
    return keep


def query(ledger: DataFrame, limit: int = DEFAULT_LIMIT, **filters: str | None) -> DataFrame:
    """The first matching records, oldest first."""
    return ledger.where(matches(**filters)).orderBy("ordinal").limit(limit)


def count(ledger: DataFrame, **filters: str | None) -> int:
    """All matching records, whatever the limit."""
    return ledger.where(matches(**filters)).count()


def last(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("ordinal")).limit(1)


def table_lines(rows: list) -> list[str]:
    """A line a record: time, tool, outcome, short id, inputs."""
    return [f"{r.ts}  {r.tool}  {r.outcome}  {short(r.id)}  {' -> '.join(os.path.basename(i.path) for i in r.inputs or [])}" for r in rows]


def short(record_id: str) -> str:
    kind, _, rest = record_id.partition(":")
    return f"{kind}:{rest[:4]}" if rest else record_id[:4]
