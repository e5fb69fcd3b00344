"""Reports: findings as diagnostics, counts, JSON rows and text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rules import SEVERITIES
from corpusloom.operators.risk import code, exit_code, file_risk, project_risk
from corpusloom.operators.scan import file_lines, scan, severity_rank
from corpusloom.sources.shared import stored

# The level of a diagnostic by severity.
LEVELS = {"critical": "Error", "high": "Error", "medium": "Warning", "low": "Information"}
FIELDS = ["rule_id", "rule_name", "severity", "category", "path", "line_number", "matched_line", "description", "recommendation", "context_note"]


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"))


def quiet(findings: DataFrame) -> DataFrame:
    """One row with one line: the number of findings, and of each severity that occurs."""
    counts = findings.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    parts = [F.when(F.col(s) > 0, F.concat_ws(" ", F.lit(s), F.col(s))) for s in SEVERITIES]
    return counts.select(F.concat_ws(", ", F.concat_ws(" ", F.col("total"), F.lit("findings")), *parts).alias("line"))


def json_rows(findings: DataFrame) -> DataFrame:
    """path, line_number, rule_id and the whole finding as JSON."""
    return findings.select("path", "line_number", "rule_id", F.to_json(F.struct(*FIELDS)).alias("json"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """path, line (from 0), column 0 to 200, level, code, message."""
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("severity")), F.lit("Information"))
    note = F.when(F.col("context_note") != F.col("description"), F.col("context_note"))
    message = F.concat_ws("\n", F.concat(F.lit("["), F.col("rule_id"), F.lit("] "), F.col("rule_name")), "description", note, "recommendation")
    return findings.select("path", (F.col("line_number") - 1).alias("line"), F.lit(0).alias("column"), F.lit(200).alias("end_column"), level.alias("level"), F.col("rule_id").alias("code"), message.alias("message"))


def totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files_scanned (those without findings too), findings_count, files_with_findings, exit_code."""
    of_file = findings.groupBy("path").agg(F.count("*").alias("n"), F.max(code(F.col("severity"))).alias("code"))  # findings are made once
    some = of_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings_count"), F.count("*").alias("files_with_findings"), F.coalesce(F.max("code"), F.lit(0)).alias("exit_code"))
    return files.agg(F.count("*").alias("files_scanned")).join(some)  # two single rows


def tree_rows(findings: DataFrame) -> DataFrame:
    """The findings by category and in it by severity, path, line and rule; they are stored, as a sort reads what it sorts twice."""
    return stored(findings, "findings").orderBy("category", severity_rank(F.col("severity")), "path", "line_number", "rule_ord")


_NUMBERS = {"files_scanned", "findings_count", "exit_code", "overall_score", "poisoning_score", "security_score", "risk_level"}


def summary(files: DataFrame, findings: DataFrame) -> dict:
    """What the terminal shows above the findings; a few numbers, gathered on the driver."""
    risk = project_risk(file_risk(findings, file_lines(files))).first().asDict()
    return {"files_scanned": files.count(), "findings_count": findings.count(), "exit_code": exit_code(findings).first()[0], **risk}


def report_lines(files: DataFrame, findings: DataFrame) -> Iterator[str]:
    """Lines for people: the summary, a bar of the score, and all findings, the gravest first; the driver holds a part of them at a time."""
    s = summary(files, findings)
    bar = "#" * min(40, int(s["overall_score"] / 150 * 40))
    yield f"{s['files_scanned']} files, {s['findings_count']} findings, risk {s['risk_level']} ({s['overall_score']})"
    yield f"[{bar:<40}] poisoning {s['poisoning_score']}, security {s['security_score']}"
    flags = [f"{name.replace('_', ' ')}: {n}" for name, n in s.items() if n and name not in _NUMBERS]
    if flags:
        yield "alerts: " + ", ".join(flags)
    group, advice = None, {}
    for n, r in enumerate(findings.orderBy(severity_rank(F.col("severity")), "path", "line_number", "rule_ord").toLocalIterator(), 1):
        if r.severity != group:
            group = r.severity
            yield f"== {group} =="
        advice.setdefault(r.rule_id, r.recommendation)  # one for each rule
        yield f"{n:>5} {r.severity:<8} {r.rule_id} {r.path}:{r.line_number}  {r.matched_line[:100]}  ({r.context_note})"
    if advice:
        yield "== what to do =="
        yield from (f"{rule}: {text}" for rule, text in sorted(advice.items()))


def render(files: DataFrame, findings: DataFrame) -> str:
    """The lines as one text, for small reports."""
    return "\n".join(report_lines(files, findings))


def full_report(files: DataFrame, severity: str | None = None, category: str | None = None) -> tuple[DataFrame, dict]:
    """The findings and their summary."""
    findings = scan(files, severity=severity, category=category)
    return findings, summary(files, findings)
