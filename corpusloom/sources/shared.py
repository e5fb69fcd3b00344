"""The folder that the driver and all executors see, and what is written there on the way to a result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders and tables that this driver wrote for results that are read lazily; whoever has the result may remove them.
written: list[str] = []
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def note(what: str) -> None:
    """Keeps in mind a folder or table that was written."""
    written.append(what)
    if (own := _noted.get()) is not None:
        own.append(what)


@contextmanager
def noting() -> Iterator[list[str]]:
    """A list of what this thread writes inside, and no other one, so that it can be removed when its results have been read."""
    own: list[str] = []
    token = _noted.set(own)
    try:
        yield own
    finally:
        _noted.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where a session names none and its master is local, as in tests, a temporary folder is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("executors see no folder of this machine: name a shared one in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    note(at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, what: list[str]) -> None:
    """Deletes folders, and tables by name."""
    for x in what:
        if "/" in x:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {x}")
        if x in written:
            written.remove(x)
