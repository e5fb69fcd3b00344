"""Shared helpers of the operators: reading inputs, the shared folder, work in Python by batches and groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from corpusloom.sources.batches import bound_batches, give_back, in_batches
from corpusloom.sources.shared import note, noting, remove, shared_dir, stored, written

__all__ = ["ascii_lower", "bound_batches", "give_back", "in_batches", "in_groups", "note", "noting", "partitions", "read", "remove", "shared_dir", "stored", "written"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_groups(groups, run: Callable, schema) -> DataFrame:
    """applyInArrow of a grouping or of two (cogroup); what a group frees goes back to the system."""

    def one(table):
        try:
            return run(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return groups.applyInArrow(two if isinstance(groups, PandasCogroupedOps) else one, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale and the rest of the text."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
