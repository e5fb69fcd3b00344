"""Words on the lines between two lines of a file, without the lines.

Lines that hold a word are numbered once for each file; a point then has a rank, the number of such lines before it, and one lies
between two points where their ranks differ. So a pair of lines costs a comparison, however far they are apart, and no text
is joined to anything: files are read where they lie, and only numbers of lines that hold a word meet the points.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lines import found_lines, literal


def ranked(points: DataFrame, files: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """points (path, line), each once, and of each list of words: on_NAME, from_NAME, to_NAME.

    on: the line holds one of them in any case; from: so many lines up to this one do; to: so many before it do.
    """
    each = [literal(sorted({w.lower() for w in some})) for some in words.values()]
    lines = found_lines(files.select("path", F.lower("content").alias("content")), "|".join(each), each)
    lines = lines.select("path", F.col("line_number").alias("at"), *(F.array_contains("may", n).alias(f"on_{name}") for n, name in enumerate(words)))
    points = points.select("path", F.col("line").alias("at")).distinct()
    marked = lines.join(points.select("path").distinct(), "path", "left_semi").withColumn("point", F.lit(False))
    asked = points.select("path", "at", *(F.lit(False).alias(f"on_{name}") for name in words), F.lit(True).alias("point"))
    each = marked.union(asked).groupBy("path", "at").agg(*(F.bool_or(c).alias(c) for c in [*(f"on_{name}" for name in words), "point"]))
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.count_if(f"on_{name}").over(so_far).alias(f"from_{name}") for name in words]
    before = [(F.col(f"from_{name}") - F.col(f"on_{name}").cast("long")).alias(f"to_{name}") for name in words]
    return each.select("*", *counts).where("point").select("path", F.col("at").alias("line"), *(c for name in words for c in (f"on_{name}", f"from_{name}")), *before)


def both_ends(pairs: DataFrame, ranks: DataFrame, first: str, last: str) -> DataFrame:
    """pairs with the structs head and tail: what ranks says of their first and last lines."""
    rest = F.struct(*(c for c in ranks.columns if c not in ("path", "line")))
    at = lambda line, name: ranks.select("path", F.col("line").alias(line), rest.alias(name))
    return pairs.join(at(first, "head"), ["path", first]).join(at(last, "tail"), ["path", last])


def between(name: str) -> Column:
    """Whether a line strictly between head and tail holds one of the words; never where tail is no further than head."""
    return F.col("tail")[f"to_{name}"] > F.col("head")[f"from_{name}"]
