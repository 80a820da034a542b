"""Tables and files in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Of each thread: the paths made inside its ``scratch`` blocks, the innermost last.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set as the checkpoint folder.

    Where the session names none, a temporary one serves a local master only (it goes
    with the process); executors of a cluster would not see it, so there it is refused.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="shiftlens-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(made)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if blocks := getattr(_OPEN, "blocks", []):
        blocks[-1].append(path)
    return path


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` once into the shared folder and read it back; also the path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the paths made inside; whoever reads them must be done by then."""
    _OPEN.blocks = [*getattr(_OPEN, "blocks", []), []]
    try:
        yield
    finally:
        for path in _OPEN.blocks.pop():
            delete(spark, path)
