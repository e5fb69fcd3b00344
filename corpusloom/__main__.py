"""python -m corpusloom PATH [--json | --quiet | --out FOLDER] [--syntax] [--severity S] [--category C] [--deep] | --version: scans a source tree; --deep heeds neither severity nor category."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable

from pyspark.sql import Row, SparkSession

from corpusloom import __version__
from corpusloom.functions.rules import SEVERITIES
from corpusloom.operators.facts import PARSERS
from corpusloom.operators.reports import FIELDS, full_report, quiet, report_lines
from corpusloom.operators.risk import exit_code
from corpusloom.operators.scan import decoded
from corpusloom.plans.deep import analyse, deep_exit_code, deep_rows, deep_summary, deep_totals
from corpusloom.sources.shared import noting, remove
from corpusloom.sources.tree import read_tree


def _print_json(head: dict, name: str, rows: Iterable[dict], ensure_ascii: bool = True) -> None:
    """head with the rows as its last field, printed row by row."""
    print(json.dumps(head, ensure_ascii=ensure_ascii)[:-1], end=f', "{name}": [')
    for n, row in enumerate(rows):
        print(", " * (n > 0) + json.dumps(row, ensure_ascii=ensure_ascii), end="")
    print("]}")


def deep_lines(rows: Iterable[Row]) -> Iterable[str]:
    """Lines for people: of each file with paths or chains its numbers, chains and paths; of one with errors alone these."""
    for r in rows:
        yield f"{r.path} ({r.language}): {r.symbols_count} functions, {r.call_edges} calls, {len(r.taint_paths)} paths, {len(r.attack_chains)} chains, {len(r.errors)} errors"
        for c in r.attack_chains:
            yield from (f"  {line}" for line in c.summary.split("\n"))
        for p in r.taint_paths:
            yield f"  line {p.source_line} {p.source_var} ({p.source_kind}) -> line {p.sink_line} {p.sink_name} ({p.sink_kind}), {p.confidence:.0%}"
        yield from (f"  error: {e}" for e in r.errors)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("path")
    p.add_argument("--version", action="version", version=f"corpusloom {__version__}")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--out", metavar="FOLDER", help="write JSON lines there, by tasks, instead of printing")
    p.add_argument("--syntax", action="store_true", help="with --deep: all languages that have a parser by syntax, not Python alone")
    p.add_argument("--severity", choices=list(SEVERITIES))
    p.add_argument("--category", choices=["poisoning", "security"])
    p.add_argument("--deep", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    with noting() as own:
        try:
            return run(a, spark)
        finally:
            remove(spark, own)  # listings, facts and paths that this run stored


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    """The exit code; prints or writes what is asked for."""
    files = decoded(read_tree(spark, a.path, "deep" if a.deep else "scan")).select("path", "content")
    if a.deep:
        deep = analyse(files, syntax=list(PARSERS) if a.syntax else ["python"])
        total = deep_totals(deep_summary(files, deep)).first()
        if a.quiet:
            print(f"{total.taint_paths} taint paths, {total.attack_chains} attack chains, {total.errors} errors in {total.reported_files} files")
            return deep_exit_code(deep).first()[0]
        if a.out:
            deep_rows(files, deep).write.json(a.out)
            print(f"{total.reported_files} files in {a.out}")
            return deep_exit_code(deep).first()[0]
        rows = deep_rows(files, deep).orderBy("path").toLocalIterator()
        if a.json:
            _print_json({"scan_path": a.path, "files_analyzed": files.count(), **total.asDict()}, "files", (r.asDict(recursive=True) for r in rows))
        else:
            for line in deep_lines(rows):
                print(line)
            print(f"{total.taint_paths} paths, {total.attack_chains} chains, {total.errors} errors in {total.reported_files} files")
        return deep_exit_code(deep).first()[0]
    findings, summary = full_report(files, a.severity, a.category)
    if a.out:  # written by tasks and committed as a whole; a folder that is there is an error
        findings.select(FIELDS).write.json(a.out)
        print(f"{summary['findings_count']} findings in {a.out}")
    elif a.json:
        rows = (r.asDict() for r in findings.orderBy("path", "rule_ord", "line_number").select(FIELDS).toLocalIterator())
        _print_json({"scan_path": a.path, "files_scanned": summary["files_scanned"], "findings_count": summary["findings_count"]}, "findings", rows, ensure_ascii=False)
    elif a.quiet:
        print(quiet(findings).first()[0])
    else:
        for line in report_lines(files, findings):
            print(line)
    return exit_code(findings).first()[0]


if __name__ == "__main__":
    sys.exit(main())
