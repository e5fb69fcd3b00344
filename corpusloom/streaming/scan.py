"""Scans of files as they arrive: each micro-batch is scanned by the same operator as a table, and its files' findings replace the earlier ones.

Line rules look at one line, so a scan has no state. Findings go to Parquet in a folder for each batch; the newest
batch of a path counts. Where files come with versions, keyed state remembers the last one of each path, so that one that comes late
replaces nothing. Counts by event time use a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.scan import decoded, scan

_VERSIONS = "path string, version long, content binary"


def scan_stream(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Scans all files (path, content) that are there, then ends."""

    def batch(df: DataFrame, batch_id: int) -> None:
        paths = df.select("path").distinct()
        found = paths.join(scan(df).drop("rule_ord"), "path", "left").withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newer(files: DataFrame) -> DataFrame:
    """Of a stream of path, version, content the rows that are newer than all that came before of their path, in one batch the newest."""

    def keep(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        best = None
        for rows in batches:
            row = rows.loc[[rows["version"].idxmax()]]
            if best is None or row["version"].iloc[0] > best["version"].iloc[0]:
                best = row
        version = int(best["version"].iloc[0])
        if seen is None or version > seen:
            state.update((version,))
            yield best[["path", "version", "content"]]

    return files.groupBy("path").applyInPandasWithState(keep, _VERSIONS, "version long", "append", "NoTimeout")


def rescan_stream(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """scan_stream of files with versions (path, version, content as bytes; null: the file has gone): what is late is passed over."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df = decoded(df).persist()  # read twice; the state moves on once
        found = df.select("path").join(scan(df.select("path", "content")).drop("rule_ord"), "path", "left").withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        df.unpersist()

    return newer(files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, output: str) -> DataFrame:
    """The findings of each path's newest batch."""
    rows = spark.read.parquet(output)
    newest = rows.groupBy("path").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["path", "batch_id"]).where("rule_id is not null").drop("batch", "batch_id")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, n of tumbling windows of a stream or table of events (ts, event_type)."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")
