"""Call graphs of files: reachability, paths, cycles, degrees. Edges are rows (path, caller, callee).

Files are graphs of their own, so every join is on path and a name. Searches go DEPTH calls deep at most, a round for
each level. Edges that are read from many rounds should be a stored table. What lies on a cycle has no such bound: a file's edges
are gathered once, and its strongly connected components found in time that grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import components, shortest_cycles
from corpusloom.sources.batches import in_batches
from corpusloom.sources.shared import stored

_CYCLES = pa.schema([("path", pa.string()), ("name", pa.string()), ("component", pa.string()), ("names", pa.list_(pa.string()))])
# Fixed value: calls that a search follows.
DEPTH = 5


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("path", "caller", "callee").distinct()


def callees(edges: DataFrame) -> DataFrame:
    """path, name and, sorted, the different functions it calls and those that call it."""
    e = _distinct(edges)
    out = e.groupBy("path", F.col("caller").alias("name")).agg(F.sort_array(F.collect_list("callee")).alias("callees"))
    into = e.groupBy("path", F.col("callee").alias("name")).agg(F.sort_array(F.collect_list("caller")).alias("callers"))
    none = F.array().cast("array<string>")
    return out.join(into, ["path", "name"], "full").select("path", "name", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def reachable(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, source, target: what each function reaches in depth calls; itself only by way of a cycle."""
    e = _distinct(edges)
    steps = e.select("path", F.col("caller").alias("at"), F.col("callee").alias("target"))
    found = first = e.select("path", F.col("caller").alias("source"), F.col("callee").alias("target"))
    for _ in range(depth - 1):  # each round goes one call further from all that is known, so the plan grows by one join
        further = found.withColumnRenamed("target", "at").join(steps, ["path", "at"]).select("path", "source", "target")
        found = first.union(further).distinct()
    return found


def has_path(edges: DataFrame, pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """pairs (path, source, target) and connected; a function is connected with itself."""
    known = reachable(edges, depth).withColumn("found", F.lit(True))
    joined = pairs.join(known, ["path", "source", "target"], "left")
    return joined.select(*pairs.columns, ((F.col("source") == F.col("target")) | F.coalesce("found", F.lit(False))).alias("connected"))


def all_paths(edges: DataFrame, pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, source, target, names: every call path of at most depth calls; the same call twice gives the path twice.

    A function that has been left doesn't come again, but one that calls itself may stand twice in a row; a path ends where it meets its target.
    """
    steps = edges.select("path", F.col("caller").alias("at"), F.col("callee").alias("next"))
    now = pairs.select("path", "source", "target").distinct().withColumns({"at": F.col("source"), "left": F.array().cast("array<string>")})
    found = []
    for n in range(depth + 1):
        found.append(now.where("at = target").select("path", "source", "target", F.concat("left", F.array("at")).alias("names")))
        if n < depth:
            now = now.where("at != target").join(steps, ["path", "at"]).where(~F.array_contains("left", F.col("next")))
            now = now.select("path", "source", "target", F.col("next").alias("at"), F.concat("left", F.array("at")).alias("left"))
    return reduce(DataFrame.union, found)


def _on_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cycles of any length but one call: a caller of cycles() leaves out those that it finds itself."""
    for batch in batches:
        out = []
        for path, edges in zip(batch.column(0).to_pylist(), batch.column(1)):
            graph: dict[str, list[str]] = {}
            for e in edges.as_py():
                graph.setdefault(e["caller"], []).append(e["callee"])
            for part in components(graph):
                least = min(part)
                out.extend({"path": path, "name": name, "component": least, "names": None} for name in part)
                out.extend({"path": path, "name": None, "component": least, "names": names} for names in shortest_cycles(graph, part, 1))
        yield pa.RecordBatch.from_pylist(out, _CYCLES)


def _searched(edges: DataFrame) -> DataFrame:
    """Rows of _CYCLES: of each file the names on a cycle with their component, and cycles of more than DEPTH calls."""
    files = _distinct(edges).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("caller", "callee"))).alias("edges"))
    return in_batches(files, _on_cycles, "path string, name string, component string, names array<string>")


def call_components(edges: DataFrame) -> DataFrame:
    """path, name, component (its least name) of every function that calls itself, by however many calls."""
    return _searched(edges).where("name is not null").select("path", "name", "component")


def on_cycle(edges: DataFrame) -> DataFrame:
    """path, name of every function that calls itself, by however many calls."""
    return call_components(edges).select("path", "name")


def cycles(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, names, each once, from its least name: all simple cycles of at most depth calls, and of each call the shortest cycle that it is part of, however long.

    So every call on a cycle is in some row; a dense component has too many long cycles to list them all.
    """
    found = stored(_searched(edges), "cycles")
    at = lambda c: found.where("name is not null").select("path", F.col("name").alias(c), F.col("component").alias(f"of_{c}"))
    e = stored(_distinct(edges).join(at("caller"), ["path", "caller"]).join(at("callee"), ["path", "callee"]).where("of_caller = of_callee").select("path", "caller", "callee"), "inner")
    steps = e.select("path", F.col("caller").alias("at"), F.col("callee").alias("next"))
    now = e.select("path", F.array("caller").alias("names"), F.col("callee").alias("next"))
    rows = [found.where(F.size("names") > depth + 1).select("path", "names")]
    for n in range(depth):
        rows.append(now.where("next = names[0]").select("path", F.concat("names", F.array("next")).alias("names")))
        if n < depth - 1:
            on = now.where((F.col("next") > F.col("names")[0]) & ~F.array_contains("names", F.col("next")))
            on = on.select("path", F.concat("names", F.array("next")).alias("names"), F.col("next").alias("at"))
            now = on.join(steps, ["path", "at"]).select("path", "names", "next")
    return reduce(DataFrame.union, rows)


def degrees(edges: DataFrame) -> DataFrame:
    """path, total_nodes, total_edges, isolated_nodes, max_callers, max_callees; equal calls count each."""
    ends = edges.select("path", F.col("caller").alias("name"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("path", F.col("callee"), F.lit(0), F.lit(1)))
    by_name = ends.groupBy("path", "name").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return by_name.groupBy("path").agg(
        F.count("*").alias("total_nodes"),
        F.sum("out").alias("total_edges"),
        F.count_if((F.col("out") == 0) & (F.col("into") == 0)).alias("isolated_nodes"),
        F.max("into").alias("max_callers"),
        F.max("out").alias("max_callees"),
    )
