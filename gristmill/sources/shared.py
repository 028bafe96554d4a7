"""The folder that driver and executors share: where tables go that must outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Below the shared folder, where tables of the running scratch() go.
SCOPE: ContextVar[str] = ContextVar("SCOPE", default="")


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local session that has none (tests) gets a temporary folder; on a cluster that would be a different one on each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gristmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/{SCOPE.get()}{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write in here are deleted at the end. Results read them, so write results inside."""
    scope = f"scratch-{uuid.uuid4().hex[:12]}/"
    before = SCOPE.set(scope)
    try:
        yield
    finally:
        SCOPE.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_base(spark)}/{scope}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
