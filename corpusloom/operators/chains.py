"""Attack chains: taint paths that fit a definition's kinds and words.

The definitions are a projection, as the rules are: one pass over the paths. What they ask of a path's two lines and of those
between comes as flags and ranks of lines, so no text goes with a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.flows import CHAINS
from corpusloom.functions.text import contains_any
from corpusloom.operators.between import between, both_ends, ranked
from corpusloom.operators.callgraph import reachable

# A chain with one path, what a second one adds, what a call path adds, and how many paths a summary shows.
ONE_PATH, MORE_PATHS, CALLED, SHOWN = 0.6, 0.15, 0.15, 3


def chain_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The columns of paths, chain_ord, chain_name, severity: a row for each chain that a path fits; paths are read twice."""
    words, cases = {}, []
    for n, (name, severity, kinds, source_words, inner_words, sink_kinds, sink_words) in enumerate(CHAINS):
        ok = F.col("sink_kind").isin(sink_kinds)
        ok = ok & F.col("source_kind").isin(kinds) if kinds else ok
        for what, some, fits in (("first", source_words, lambda c: F.col("head")[f"on_{c}"]), ("inner", inner_words, between), ("last", sink_words, lambda c: F.col("tail")[f"on_{c}"])):
            if some:
                words[f"{what}_{n}"] = some
                ok = ok & fits(f"{what}_{n}")
        cases.append(F.when(ok, F.struct(F.lit(n).alias("chain_ord"), F.lit(name).alias("chain_name"), F.lit(severity).alias("severity"))))
    points = paths.select("path", F.col("source_line").alias("line")).union(paths.select("path", "sink_line"))
    rows = both_ends(paths, ranked(points, files, words), "source_line", "sink_line")
    return rows.select(*paths.columns, F.explode(F.array_compact(F.array(*cases))).alias("c")).select(*paths.columns, "c.*")


def confidence(n_paths: Column, best: Column, called: Column | None = None) -> Column:
    more = F.when(n_paths >= 2, MORE_PATHS).otherwise(0.0) + F.when(F.lit(False) if called is None else called, CALLED).otherwise(0.0)
    return F.least(F.lit(1.0), (F.lit(ONE_PATH) + more + best) / 2)


def called_chains(edges: DataFrame) -> DataFrame:
    """path, chain_name: chains of which a function with a source word in its name or in a call of its reaches one with a sink word, by the edges of its file."""
    rows = edges.select("path", "caller", F.lower("callee").alias("callee")).distinct()
    low = lambda words: [w.lower() for w in words]
    steps = []
    for name, _, _, source_words, _, _, sink_words in CHAINS:
        if source_words and sink_words:
            of = rows.where(contains_any(F.col("callee"), low(source_words)))
            sources = of.select("path", F.col("caller").alias("source")).union(of.select("path", "callee")).distinct()
            sinks = rows.where(contains_any(F.col("callee"), low(sink_words))).select("path", F.col("callee").alias("target")).distinct()
            steps.append(reachable(rows).join(sources, ["path", "source"]).join(sinks, ["path", "target"]).select("path", F.lit(name).alias("chain_name")))
    none = rows.where(F.lit(False)).select("path", F.lit("").alias("chain_name"))
    return reduce(DataFrame.union, steps, none).distinct()


def chains(paths: DataFrame, files: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """path, chain_name, severity, n_paths, confidence, summary of each chain of a file; called (path, chain_name) raises the confidence of some."""
    found = chain_paths(paths, files)
    order = Window.partitionBy("path", "chain_name").orderBy("source_line", "sink_line", "source_var", "sink_name")
    ranked = found.withColumn("at", F.row_number().over(order))
    shown = F.when(F.col("at") <= SHOWN, F.struct("at", F.format_string("line %d -> line %d", "source_line", "sink_line").alias("text")))
    grouped = ranked.groupBy("path", "chain_name", "severity").agg(F.count("*").alias("n_paths"), F.max("confidence").alias("best"), F.sort_array(F.collect_list(shown)).alias("shown"))
    if called is None:
        out = grouped.withColumn("confidence", confidence(F.col("n_paths"), F.col("best")))
    else:
        joined = grouped.join(called.select("path", "chain_name", F.lit(True).alias("called")).distinct(), ["path", "chain_name"], "left")
        out = joined.withColumn("confidence", confidence(F.col("n_paths"), F.col("best"), F.coalesce("called", F.lit(False)))).drop("called")
    head = F.format_string("[%s] %s (%d%%)", F.upper("severity"), F.col("chain_name"), F.floor(F.round(F.col("confidence") * 100, 6)).cast("int"))
    summary = F.concat_ws("\n", head, F.transform("shown", lambda x: x["text"]))
    return out.select("path", "chain_name", "severity", "n_paths", "confidence", summary.alias("summary"))
