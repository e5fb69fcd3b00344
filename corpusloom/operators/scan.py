"""The line scan: files to lines, lines to findings.

Rules are no join: they become one projection. Tasks split and search texts in Arrow batches by wider forms of the patterns, which let few
lines through, and only for those each rule's own patterns and check are evaluated. A line is one finding of a rule at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.prefilter import may_match, wider, widest
from corpusloom.functions.rules import SEVERITIES, Rule, built_in
from corpusloom.functions.text import any_of, deep_language, scan_language, search, shown
from corpusloom.operators.lines import found_lines


def decoded(files: DataFrame) -> DataFrame:
    """content as text: bytes that are no UTF-8 go, lines end in \\n alone; an unreadable file has none."""
    text = F.translate(F.expr("make_valid_utf8(cast(content as string))"), "�", "")
    return files.withColumn("content", F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n"))


def with_languages(files: DataFrame) -> DataFrame:
    return files.withColumns({"language": scan_language(F.col("path")), "deep_language": deep_language(F.col("path"))})


def lines_of(content: Column) -> Column:
    """The lines, each with its \\n; nothing after the last one."""
    return F.filter(F.split(content, "(?<=\n)"), lambda x: x != "")


def explode_lines(files: DataFrame) -> DataFrame:
    """The other columns of files, line_number (from 1) and line."""
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(lines_of(F.col("content"))).alias("at", "line")).select(*rest, (F.col("at") + 1).alias("line_number"), "line")


def may_find(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """explode_lines of the few lines that a rule may find, with may: the numbers of those rules."""
    rules = _usable(rules)
    some = widest(p for r in rules for p in r.patterns)
    return found_lines(files, some, [wider(r.patterns) for r in rules])


def _extension_in(path: Column, extensions: Sequence[str]) -> Column:
    ends = "|".join(e.lower().lstrip(".").replace(".", r"\.") for e in extensions)
    return F.rlike(F.lower(path), F.lit(rf"\.(?:{ends})\z"))


def _applies(rule: Rule) -> Column:
    ok = F.lit(True) if "all" in rule.languages else F.col("language").isin(rule.languages)
    if rule.extensions:
        ok = ok & _extension_in(F.col("path"), rule.extensions)
    for p in rule.exclude_patterns:
        ok = ok & ~F.rlike("path", F.lit(p))
    return ok


def _usable(rules: Sequence[Rule] | None) -> list[Rule]:
    """Those with patterns; at least one, which may find nothing."""
    return [r for r in (built_in() if rules is None else rules) if r.patterns] or [Rule("none", "", "low", "security", [], ["(?!)"])]


def _gate(rules: Sequence[Rule]) -> Column:
    """Texts meet only the rules for all languages."""
    some = sorted({x for r in rules for x in r.languages} - {"all"})
    gate = may_match(F.col("line"), [p for r in rules if "all" in r.languages for p in r.patterns])
    if some:
        gate = F.when(F.col("language").isin(some), may_match(F.col("line"), [p for r in rules for p in r.patterns])).otherwise(gate)
    return gate


def find(lines: DataFrame, rules: Sequence[Rule] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """path, line_number, rule_ord, rule_id, matched_line, context_note and carry of each finding; lines has path, language, line_number, line, carry and, where may_find made it, may."""
    rules, known = _usable(rules), "may" in lines.columns
    line, path = F.col("line"), F.col("path")
    cases = []
    for n, r in enumerate(rules):
        note = r.context(line, path) if r.context else F.lit("")
        fits = _applies(r) & search(line, any_of(r.patterns), True)
        hit = F.when(F.array_contains("may", n) & fits if known else fits, note)
        cases.append(F.struct(F.lit(n).alias("rule_ord"), F.lit(r.id).alias("rule_id"), hit.alias("context_note")))
    hits = lines if known else lines.where(_gate(rules))
    hits = hits.select("path", "line_number", "line", *carry, F.explode(F.filter(F.array(*cases), lambda x: x["context_note"].isNotNull())).alias("hit"))
    return hits.select("path", "line_number", "hit.rule_ord", "hit.rule_id", shown(line).alias("matched_line"), "hit.context_note", *carry)


def rules_table(spark, rules: Sequence[Rule] | None = None) -> DataFrame:
    """What holds for all findings of a rule; a row for each rule."""
    rows = [(r.id, n, r.name, r.severity, r.category, list(r.languages), r.description, r.recommendation) for n, r in enumerate(built_in() if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_id string, rule_ord int, rule_name string, severity string, category string, languages array<string>, description string, recommendation string")


def severity_rank(severity: Column) -> Column:
    """0 is the gravest; an unknown one is 9."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for n, s in enumerate(SEVERITIES) for x in (s, n))), severity), F.lit(9))


def scan(files: DataFrame, rules: Sequence[Rule] | None = None, severity: str | None = None, category: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """All columns of a finding; severity is the least grave one to report. files has path, content and what findings carry along."""
    found = find(may_find(with_languages(files).select("path", "language", *carry, "content"), rules), rules, carry)
    # as many rows as there are rules are broadcast
    out = found.join(F.broadcast(rules_table(files.sparkSession, rules).drop("rule_ord", "languages")), "rule_id")
    if severity:
        out = out.where(severity_rank(F.col("severity")) <= list(SEVERITIES).index(severity))
    if category:
        out = out.where(F.col("category") == category)
    columns = ["rule_id", "rule_name", "severity", "category", "path", "line_number", "matched_line", "description", "recommendation", "context_note", "rule_ord"]
    return out.select(*columns, *carry)


def line_count(content: Column) -> Column:
    """Lines of a text, counted without splitting it."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (breaks + ((content != "") & ~F.endswith(content, F.lit("\n"))).cast("int")).cast("int")


def file_lines(files: DataFrame) -> DataFrame:
    """path, n_lines."""
    return files.select("path", line_count(F.col("content")).alias("n_lines"))


def excluded(path: Column, folders: Sequence[str], names: Sequence[str], endings: Sequence[str], length: Column | None = None, most: int = 0) -> Column:
    """The exclusions of the scan as a predicate, for files that are rows of a table."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, folders))) | F.element_at(parts, -1).isin(*names)
    out = reduce(lambda a, e: a | F.endswith(F.lower(F.element_at(parts, -1)), F.lit(e)), endings, out)
    return out if length is None else out | (length > most) | length.isNull()
