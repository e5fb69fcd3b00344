"""Scores, alerts and levels of findings, for each file and for the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rules import RISK_LEVELS, SEVERITIES
from corpusloom.operators.scan import line_count, scan

# Two poisoning rules that together raise an alert.
COMBINATIONS = [
    ("remote control", "POI-001", "POI-002"),
    ("hidden remote control", "POI-001", "POI-004"),
    ("data theft", "POI-003", "POI-001"),
    ("resident threat", "POI-006", "POI-002"),
    ("supply chain", "POI-005", "POI-002"),
]
TAIL = "tail anomaly"


def weight(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair)), severity), F.lit(1))


def level(score: Column) -> Column:
    out = F.lit(RISK_LEVELS[0][1])
    for least, name in RISK_LEVELS:
        out = F.when(score >= least, name).otherwise(out)
    return out


def tail_from(n_lines: Column) -> Column:
    """The line where the last quarter begins."""
    return F.greatest(F.lit(1), n_lines - F.expr("n_lines div 4"))


def risk_of_files(files: DataFrame) -> DataFrame:
    """file_risk of files (path, content), read once: findings carry the number of their file's lines along."""
    counted = files.withColumn("n_lines", line_count(F.col("content")))
    return file_risk(scan(counted, carry=["n_lines"]))


def file_risk(findings: DataFrame, file_lines: DataFrame | None = None) -> DataFrame:
    """path, total_score, poisoning_score, security_score, findings_count, flags; files without findings have no row.

    n_lines comes with the findings, or from file_lines (path, n_lines).
    """
    if file_lines is not None:
        findings = findings.join(file_lines, "path", "left")
    w, poisoning = weight(F.col("severity")), F.col("category") == "poisoning"
    has = lambda rule: F.coalesce(F.bool_or(poisoning & (F.col("rule_id") == rule)), F.lit(False))
    grave = F.col("severity").isin("critical", "high") & (F.col("n_lines") > 0) & (F.col("line_number") >= tail_from(F.col("n_lines")))
    flags = [F.when(has(a) & has(b), F.lit(name)) for name, a, b in COMBINATIONS] + [F.when(F.count_if(grave) >= 2, F.lit(TAIL))]
    return (
        findings.groupBy("path")
        .agg(
            F.sum(w).cast("long").alias("total_score"),
            F.sum(F.when(poisoning, w).otherwise(0)).cast("long").alias("poisoning_score"),
            F.sum(F.when(~poisoning, w).otherwise(0)).cast("long").alias("security_score"),
            F.count("*").alias("findings_count"),
            F.array_compact(F.array(*flags)).alias("flags"),
        )
    )


def project_risk(files: DataFrame) -> DataFrame:
    """One row: overall_score, poisoning_score, security_score, risk_level and how often each flag was raised."""
    sums = files.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("poisoning_score", "security_score")), *(F.count_if(F.array_contains("flags", n)).alias(n.replace(" ", "_")) for n in [*(c[0] for c in COMBINATIONS), TAIL]))
    overall = F.col("poisoning_score") + F.col("security_score")
    return sums.select(overall.alias("overall_score"), level(overall).alias("risk_level"), "*")


def code(severity: Column) -> Column:
    """What a finding makes of the exit code: 2 if it is critical, 1 if high, else 0."""
    return F.when(severity == "critical", 2).when(severity == "high", 1).otherwise(0)


def exit_code(findings: DataFrame) -> DataFrame:
    """One row: 2 if any finding is critical, 1 if any is high, else 0."""
    return findings.agg(F.coalesce(F.max(code(F.col("severity"))), F.lit(0)).alias("exit_code"))
