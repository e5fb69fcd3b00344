"""One query for each operator, over the files that the tables give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rules import built_in
from corpusloom.functions.text import taint_language
from corpusloom.operators import callgraph, chains, facts, reports, risk, tablefunctions, taint
from corpusloom.operators.lines import distinct_lines, with_entropy
from corpusloom.operators.scan import explode_lines, file_lines, find, may_find, rules_table, scan, severity_rank, with_languages
from corpusloom.plans import deep
from corpusloom.sources.corpus import code_files, text_files
from corpusloom.sources.shared import stored
from corpusloom.streaming.scan import event_counts

Query = Callable[[SparkSession, str], DataFrame]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(code_files(spark, sf_dir))


def _rule(rule_id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [r for r in built_in() if r.id == rule_id]
        lines = may_find(with_languages(code_files(spark, sf_dir)).select("path", "language", "content"), rules)
        return find(lines, rules).select("path", "line_number", "matched_line", "context_note")

    return query


def _plain(df: DataFrame) -> DataFrame:
    return df.select("rule_id", "severity", "category", "path", "line_number", "matched_line", "context_note")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_languages(code_files(spark, sf_dir)).select("path", "language", "deep_language", taint_language(F.col("deep_language")).alias("taint_language"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(text_files(spark, sf_dir))


def lines_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_lines(text_files(spark, sf_dir))


def rules_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    return counts.orderBy(severity_rank(F.col("severity")), "rule_id")


def line_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the different lines of all texts, without their line ends."""
    return with_entropy(distinct_lines(text_files(spark, sf_dir))).select("text", F.round("entropy", 6).alias("entropy"))


def file_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.risk_of_files(code_files(spark, sf_dir))
    return found.select("path", "total_score", "poisoning_score", "security_score", "findings_count", F.array_join("flags", "|").alias("flags"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.project_risk(risk.risk_of_files(code_files(spark, sf_dir)))


def project_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of every file: the project's list, with its repetitions."""
    return risk.risk_of_files(code_files(spark, sf_dir)).select("path", F.explode("flags").alias("flag"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, each with what it finds in the files."""
    counts = _findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"))
    rules = rules_table(spark).select("rule_id", "rule_ord", "severity", "category", F.array_join("languages", ",").alias("languages"))
    return rules.join(counts, "rule_id", "left").fillna(0, ["n_findings", "n_files"])


def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 files with the largest scores."""
    return risk.risk_of_files(code_files(spark, sf_dir)).select("path", "total_score").orderBy(F.desc("total_score"), "path").limit(20)


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = with_languages(code_files(spark, sf_dir))
    return facts.python_facts(files), files


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_languages(code_files(spark, sf_dir)).where("deep_language is not null and deep_language != 'dockerfile'")


def _stored_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts that a query reads more than once: files are parsed once."""
    found, files = _facts(spark, sf_dir)
    return stored(found, "facts"), files


def _of_facts(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_facts(spark, sf_dir)[0])


def _edges(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(stored(facts.call_edges(_facts(spark, sf_dir)[0]), "edges"))


def _of_stored_facts(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_stored_facts(spark, sf_dir)[0])


def _pairs(edges: DataFrame) -> DataFrame:
    """Each file's first caller with each of its callees: what the SQL of calls_has_path and calls_all_paths asks; all pairs are in calls_connected and calls_paths_of_all."""
    first = edges.groupBy("path").agg(F.min("caller").alias("source"))
    return edges.select("path", F.col("callee").alias("target")).distinct().join(first, "path").select("path", "source", "target")


def _all_pairs(edges: DataFrame) -> DataFrame:
    """Each function with each that it reaches, both ways round, so that unconnected pairs occur too."""
    known = callgraph.reachable(edges)
    pairs = known.union(known.select("path", F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return stored(pairs, "pairs")  # read once for each level of a search


def _all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every language that has a parser."""
    return facts.syntax_facts(with_languages(code_files(spark, sf_dir)))


def _of_all_facts(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_all_facts(spark, sf_dir))


def all_syntax_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.syntax_paths(stored(_all_facts(spark, sf_dir), "facts"), code_files(spark, sf_dir))


def all_syntax_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of all languages by syntax alone."""
    return deep.analyse(code_files(spark, sf_dir), syntax=list(facts.PARSERS)).chains


def calls_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of all languages, by the parsers as a table function."""
    tablefunctions.register(spark)
    files = with_languages(code_files(spark, sf_dir)).select("path", "deep_language", "content")
    return spark.sql("SELECT path, caller, f.name AS callee, line FROM {files}, LATERAL syntax_facts(deep_language, content) f WHERE fact = 'call' AND caller IS NOT NULL", files=files)


def syntax_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.syntax_paths(*_stored_facts(spark, sf_dir))


def text_chain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _text_files(spark, sf_dir)
    found = chains.chain_paths(stored(taint.text_paths(files), "paths"), files)
    return found.select("path", "chain_name", "severity", "source_line", "sink_line", "source_kind", "sink_kind", "source_var")


def text_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _text_files(spark, sf_dir)
    found = chains.chains(stored(taint.text_paths(files), "paths"), files)
    return found.select("path", "chain_name", "severity", "n_paths", F.round("confidence", 6).alias("confidence"), "summary")


def all_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep.analyse(code_files(spark, sf_dir)).chains


def deep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return deep.deep_summary(files, deep.analyse(files))


def deep_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return deep.deep_rows(files, deep.analyse(files)).select("path", F.to_json(F.struct("*")).alias("json"))


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return reports.totals(files, scan(files))


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES: dict[str, Query] = {
    "rules_by_severity": rules_by_severity,
    "languages": languages,
    "lines": lines,
    "lines_per_file": lines_per_file,
    "line_entropy": line_entropy,
    **{f"rule_{r.id.lower().replace('-', '_')}": _rule(r.id) for r in built_in()},
    "findings_code": lambda s, d: _plain(_findings(s, d)),
    "findings_text": lambda s, d: _plain(scan(text_files(s, d))),
    "rules_catalogue": catalogue,
    "severity_floor_high": lambda s, d: _plain(scan(code_files(s, d), severity="high")),
    "category_poisoning": lambda s, d: _plain(scan(code_files(s, d), category="poisoning")),
    "severity_counts": lambda s, d: reports.severity_counts(_findings(s, d)),
    "category_counts": lambda s, d: reports.category_counts(_findings(s, d)),
    "quiet_line": lambda s, d: reports.quiet(_findings(s, d)),
    "exit_code": lambda s, d: risk.exit_code(_findings(s, d)),
    "diagnostics": lambda s, d: reports.diagnostics(_findings(s, d)).select("path", "line", "column", "end_column", "level", "code", "message"),
    "json_report": lambda s, d: reports.json_rows(_findings(s, d)),
    "file_risk": file_risks,
    "project_risk": project,
    "project_flags": project_flags,
    "scan_totals": scan_totals,
    "tree_listing": lambda s, d: reports.tree_rows(_findings(s, d)).select("category", "severity", "path", "line_number", "rule_id"),
    "top_risky_files": top_files,
    "syntax_functions": _of_facts(lambda f: facts.symbols(f).drop("params")),
    "syntax_calls": _of_facts(facts.call_edges),
    "syntax_imports": _of_facts(facts.imports),
    "syntax_errors": _of_facts(lambda f: facts.errors(f).select("path")),
    "syntax_all_functions": _of_all_facts(lambda f: facts.symbols(f).select("path", "name", "kind", "line_start", "line_end", F.array_join("params", ",").alias("params"))),
    "syntax_all_calls": _of_all_facts(facts.call_edges),
    "syntax_calls_by_sql": calls_by_sql,
    "syntax_all_imports": _of_all_facts(facts.imports),
    "taint_syntax_all_sources": _of_all_facts(taint.syntax_sources),
    "taint_syntax_all_paths": all_syntax_paths,
    "chains_by_syntax": all_syntax_chains,
    "taint_text_sources": lambda s, d: taint.text_sources(_text_files(s, d)),
    "taint_text_tainted": lambda s, d: taint.text_tainted(_text_files(s, d)),
    "taint_text_paths": lambda s, d: taint.text_paths(_text_files(s, d)),
    "taint_syntax_sources": _of_facts(taint.syntax_sources),
    "taint_syntax_tainted": _of_stored_facts(taint.syntax_tainted),
    "taint_syntax_paths": syntax_paths,
    "chain_text_paths": text_chain_paths,
    "chain_text": text_chains,
    "chains_all": all_chains,
    "deep_summary": deep_report,
    "deep_totals": lambda s, d: deep.deep_totals(deep_report(s, d)),
    "deep_json": deep_json,
    "deep_exit_code": lambda s, d: deep.deep_exit_code(deep.analyse(code_files(s, d))),
    "calls_neighbours": _edges(lambda e: callgraph.callees(e).select("path", "name", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))),
    "calls_reachable": _edges(callgraph.reachable),
    "calls_has_path": _edges(lambda e: callgraph.has_path(e, _pairs(e))),
    "calls_all_paths": _edges(lambda e: callgraph.all_paths(e, _pairs(e)).select("path", "source", "target", F.array_join("names", ">").alias("names"))),
    "calls_connected": _edges(lambda e: callgraph.has_path(e, _all_pairs(e))),
    "calls_paths_of_all": _edges(lambda e: callgraph.all_paths(e, _all_pairs(e)).select("path", "source", "target", F.array_join("names", ">").alias("names"))),
    "calls_on_cycle": _edges(callgraph.on_cycle),
    "calls_cycles": _edges(lambda e: callgraph.cycles(e).select("path", F.array_join("names", ">").alias("names"))),
    "calls_components": _edges(callgraph.call_components),
    "calls_degrees": _edges(callgraph.degrees),
    "events_by_hour": events_by_hour,
}
