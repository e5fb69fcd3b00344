"""The deep analysis put together: facts, taint, chains, and what a report needs."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import deep_language
from corpusloom.operators.chains import chains
from corpusloom.operators.facts import call_edges, errors, symbols, syntax_facts
from corpusloom.operators.scan import with_languages
from corpusloom.operators.taint import syntax_paths, text_paths
from corpusloom.sources.shared import stored


@dataclass
class Deep:
    symbols: DataFrame
    call_edges: DataFrame
    errors: DataFrame
    taint_paths: DataFrame
    chains: DataFrame


def analyse(files: DataFrame, by_text: bool = True, syntax: Collection[str] = ("python",)) -> Deep:
    """files has path and content. Some languages are analysed by syntax (of PARSERS, Python unless told otherwise), other known ones by text (or not at all)."""
    files = with_languages(files)
    facts = stored(syntax_facts(files, syntax), "facts")  # read by five tables
    paths = syntax_paths(facts, files)
    if by_text:
        paths = paths.union(text_paths(files.where(~F.col("deep_language").isin(*syntax, "dockerfile"))))
    paths = stored(paths, "paths")
    return Deep(symbols(facts), call_edges(facts), errors(facts), paths, chains(paths, files))


def deep_summary(files: DataFrame, deep: Deep) -> DataFrame:
    """path, language, symbols_count, call_edges, taint_paths, attack_chains, errors of each file that has a path, a chain or an error."""
    counts = [F.count_if(F.col("what") == name).alias(name) for name in ("symbols_count", "call_edges", "taint_paths", "attack_chains", "errors")]
    return _together(deep).groupBy("path").agg(*counts).where(_REPORTED).select("path", deep_language(F.col("path")).alias("language"), "symbols_count", "call_edges", "taint_paths", "attack_chains", "errors")


_REPORTED = "taint_paths > 0 or attack_chains > 0 or errors > 0"


def _together(deep: Deep) -> DataFrame:
    """path, what, and a path, chain or error of each row of the tables, so that one grouping has them all."""
    path = F.struct("source_line", "sink_line", "source_var", "source_kind", "sink_name", "sink_kind", F.round("confidence", 6).alias("confidence"))
    chain = F.struct("chain_name", "severity", F.round("confidence", 6).alias("confidence"), "summary")
    parts = {"symbols_count": (deep.symbols, {}), "call_edges": (deep.call_edges, {}), "taint_paths": (deep.taint_paths, {"a_path": path}), "attack_chains": (deep.chains, {"a_chain": chain}), "errors": (deep.errors, {"an_error": F.col("message")})}
    rows = [df.select("path", F.lit(what).alias("what"), *(c.alias(name) for name, c in own.items())) for what, (df, own) in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def deep_rows(files: DataFrame, deep: Deep) -> DataFrame:
    """The columns of deep_summary, with the file's paths, chains and errors themselves as arrays in order."""
    every = {"taint_paths": "a_path", "attack_chains": "a_chain", "errors": "an_error"}
    counts = [F.count_if(F.col("what") == name).alias(name) for name in ("symbols_count", "call_edges")]
    rows = _together(deep).groupBy("path").agg(*counts, *(F.sort_array(F.collect_list(c)).alias(name) for name, c in every.items()))
    rows = rows.where(" or ".join(f"size({name}) > 0" for name in every))
    return rows.select("path", deep_language(F.col("path")).alias("language"), "symbols_count", "call_edges", *every)


def deep_totals(summary: DataFrame) -> DataFrame:
    """One row over the files of deep_summary: reported files, taint paths, chains, errors."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("taint_paths", "attack_chains", "errors"))
    return summary.agg(F.count("*").alias("reported_files"), *sums)


def deep_exit_code(deep: Deep) -> DataFrame:
    """One row: 2 with chains, 1 with taint paths, else 0."""
    rows = deep.chains.select(F.lit(2).alias("code")).union(deep.taint_paths.select(F.lit(1)))
    return rows.agg(F.coalesce(F.max("code"), F.lit(0)).alias("exit_code"))
