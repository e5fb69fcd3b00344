"""Taint: from untrusted data to where it does harm.

Text mode needs no joins: a file's lines become one array of what matters on them, in one pass over its text, and the rounds of
propagation run over that array, file by file, in a task; nothing is shuffled. Syntax mode works on the fact tables, all joined by
path; a file's assignments are gathered once and go through the same rounds. The rounds leave the JVM in batches, and so stand where they are
written: no optimizer repeats them inside another expression.

Variables belong to a file, not to a function; nothing clears a taint; a sink may stand above its source; at most
ROUNDS assignments are followed. Each path has its source, its sink and a confidence, lower if a line between holds a
sanitizer's name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.flows import DIRECT_USES, INLINE, PLAIN, ROUNDS, SANITISED, SANITIZERS, SINKS, SOURCES
from corpusloom.functions.text import contains_any, let, taint_language
from corpusloom.operators.between import between, both_ends, ranked
from corpusloom.operators.scan import lines_of
from corpusloom.operators.spread import spread
from corpusloom.sources.batches import in_batches
from corpusloom.sources.shared import stored

FLOWS = "path string, pending array<struct<var: string, kind: string, line: int, safe: int>>, tainted array<string>, sinks array<struct<kind: string, line: int, safe: int>>"
_PLACE = [("kind", pa.string()), ("line", pa.int32()), ("safe", pa.int32())]
_FLOWS = pa.schema([("path", pa.string()), ("pending", pa.list_(pa.struct([("var", pa.string()), *_PLACE]))), ("tainted", pa.list_(pa.string())), ("sinks", pa.list_(pa.struct(_PLACE)))])
TAINTED = "path string, name string, kind string, line int, source_var string"
_TAINTED = pa.schema([("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("source_var", pa.string())])
COLUMNS = ["path", "source_var", "source_kind", "source_line", "sink_name", "sink_kind", "sink_line", "confidence"]


def patterns(spark: SparkSession) -> DataFrame:
    """taint_language and its sources and sinks, in order: arrays of (ord, pattern, kind)."""
    kind = "array<struct<ord: int, pattern: string, kind: string>>"
    rows = [(lang, [(n, *x) for n, x in enumerate(SOURCES[lang])], [(n, *x) for n, x in enumerate(SINKS[lang])]) for lang in SOURCES]
    return spark.createDataFrame(rows, f"taint_language string, sources {kind}, sinks {kind}")


# The name before the first =, :, or comma of a line, without a declaring word; no line that begins with a branch or a loop.
_ASSIGNED = r"(?Ud)\A\s*+(?!if|for|while)(?:(?:const|let|var) (?!\s*=)\s*+)?+([^\W\d]\w*+)\s*+(?:[,:][^=]*+)?+="


def assigned(line: Column) -> Column:
    """The name that a line of code assigns, or null."""
    return F.nullif(F.regexp_extract(line, _ASSIGNED, 1), F.lit(""))


def words(text: Column) -> Column:
    return F.split(text, r"(?U)\W+")


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, lines in zip(batch.column(0).to_pylist(), batch.column(1)):
            lines = lines.as_py()
            safe = [x["n"] for x in lines if x["safe"]]
            pending = [{"var": x["var"], "kind": kind, "line": x["n"], "safe": bisect_right(safe, x["n"])} for x in lines for kind in x["sources"]]
            if pending:
                steps = [(x["var"], x["reads"]) for x in lines if x["var"] is not None]
                tainted = spread(dict.fromkeys(p["var"] for p in pending), steps, ROUNDS)
                hot = [x for x in lines if x["sinks"] and (x["direct"] or any(w in tainted for w in x["words"]))]
                sinks = [{"kind": kind, "line": x["n"], "safe": bisect_left(safe, x["n"])} for x in hot for kind in x["sinks"]]
                out.append({"path": path, "pending": pending, "tainted": list(tainted), "sinks": sinks})
        yield pa.RecordBatch.from_pylist(out, _FLOWS)


def text_flows(files: DataFrame) -> DataFrame:
    """path and, as arrays, pending (var, kind, line), tainted names and sinks (kind, line) of each file with a source; files has path, deep_language, content.

    safe is a rank among the lines with a sanitizer: of a source those up to its line, of a sink those before it.
    """
    files = files.select("path", "content", taint_language(F.col("deep_language")).alias("taint_language"))
    known = files.join(F.broadcast(patterns(files.sparkSession)), "taint_language")  # a row for each language
    known = known.where(F.exists("sources", lambda p: F.contains("content", p["pattern"])))
    none = F.array().cast("array<string>")

    def line(x: Column, i: Column) -> Column:
        text = F.rtrim(x, F.lit("\n"))
        fits = lambda table: F.transform(F.filter(table, lambda p: F.contains(text, p["pattern"])), lambda p: p["kind"])
        comment = F.rlike(text, F.lit(r'(?U)^\s*(?:#|""")'))
        return F.struct(
            (i + 1).alias("n"),
            F.when(F.contains(text, F.lit("=")), assigned(text)).alias("var"),
            F.when(F.contains(text, F.lit("=")), fits("sources")).otherwise(none).alias("sources"),
            F.when(comment, none).otherwise(fits("sinks")).alias("sinks"),
            let(F.lower(text), lambda low: contains_any(low, SANITIZERS)).alias("safe"),
            text.alias("text"),
        )

    def read(x: Column) -> Column:
        """What of a line goes to the rounds; words only where they are asked for."""
        named, sink = x["var"].isNotNull(), F.size(x["sinks"]) > 0
        return F.struct(
            x["n"].alias("n"),
            x["var"].alias("var"),
            F.when(named, x["sources"]).otherwise(none).alias("sources"),
            F.when(named, words(F.substr(x["text"], F.instr(x["text"], "=") + 1))).otherwise(none).alias("reads"),
            x["sinks"].alias("sinks"),
            F.when(sink, words(x["text"])).otherwise(none).alias("words"),
            (sink & contains_any(x["text"], DIRECT_USES)).alias("direct"),
            x["safe"].alias("safe"),
        )

    seen = F.filter(F.transform(lines_of(F.col("content")), line), lambda x: x["var"].isNotNull() | (F.size(x["sinks"]) > 0) | x["safe"])
    return in_batches(known.select("path", F.transform(seen, read).alias("lines")), _flows, FLOWS)


def text_sources(files: DataFrame) -> DataFrame:
    """path, source_var, source_kind, source_line of every assignment from a source."""
    return text_flows(files).select("path", F.explode("pending").alias("p")).select("path", F.col("p.var").alias("source_var"), F.col("p.kind").alias("source_kind"), F.col("p.line").alias("source_line"))


def text_tainted(files: DataFrame) -> DataFrame:
    """path, name of every tainted variable."""
    return text_flows(files).select("path", F.explode("tainted").alias("name"))


def text_paths(files: DataFrame) -> DataFrame:
    """All COLUMNS, by text alone; every sink that uses something tainted meets every source of its file."""
    rows = text_flows(files).select("path", "pending", F.explode("sinks").alias("s")).select("path", "s", F.explode("pending").alias("p"))
    return rows.select(
        "path",
        F.col("p.var").alias("source_var"),
        F.col("p.kind").alias("source_kind"),
        F.col("p.line").alias("source_line"),
        F.col("s.kind").alias("sink_name"),
        F.col("s.kind").alias("sink_kind"),
        F.col("s.line").alias("sink_line"),
        F.when(F.col("s.safe") > F.col("p.safe"), SANITISED).otherwise(PLAIN).alias("confidence"),
    )


def _first_kind(text: Column, table: dict[str, list[tuple[str, str]]], names: bool = True) -> Column:
    """By the row's language, the kind of the first pattern in a text (of a call's name without the bracket at the pattern's end); '' is in no name."""
    language, out = F.col("language"), None
    for lang, rows in table.items():
        found = None
        for pattern, kind in rows:
            hit = F.contains(text, F.lit(pattern.rstrip("(") if names else pattern))
            found = F.when(hit, kind) if found is None else found.when(hit, kind)
        out = F.when(language == lang, found) if out is None else out.when(language == lang, found)
    return out


def syntax_sources(facts: DataFrame) -> DataFrame:
    """path, name, kind, line of each variable that a source is assigned to; the last such assignment counts."""
    rows = facts.where("fact = 'assign'")
    by_call = _first_kind(F.col("value_call"), SOURCES)
    by_text = F.when(F.col("chain") != "", _first_kind(F.col("chain"), SOURCES, names=False))
    kind = F.coalesce(by_call, by_text)
    rows = rows.select("path", "seq", "name", kind.alias("kind"), F.when(by_call.isNotNull(), F.col("value_line")).otherwise(F.col("line")).alias("line")).where("kind is not null")
    return rows.groupBy("path", "name").agg(F.max_by(F.struct("kind", "line"), "seq").alias("s")).select("path", "name", "s.kind", "s.line")


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, sources, steps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            known = {s["name"]: (s["kind"], s["line"], s["name"]) for s in sources.as_py()}
            tainted = spread(known, [(s["name"], s["reads"]) for s in steps.as_py() or ()], ROUNDS)
            out.extend({"path": path, "name": name, "kind": kind, "line": line, "source_var": var} for name, (kind, line, var) in tainted.items())
        yield pa.RecordBatch.from_pylist(out, _TAINTED)


def syntax_tainted(facts: DataFrame) -> DataFrame:
    """path, name and the kind, line and variable of the source; a round takes what earlier rounds have tainted.

    A file's assignments are one array: one grouping by path, whatever the number of rounds.
    """
    names = syntax_sources(facts).groupBy("path").agg(F.collect_list(F.struct("name", "kind", "line")).alias("sources"))
    reads = facts.where("fact = 'assign_ref'").groupBy("path", "seq").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("reads"))
    steps = facts.where("fact = 'assign'").select("path", "seq", "name").join(reads, ["path", "seq"])
    steps = steps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "name", F.transform("reads", lambda r: r["name"]).alias("reads")))).alias("steps"))
    return in_batches(names.join(steps, "path", "left").select("path", "sources", "steps"), _rounds, TAINTED)


def syntax_paths(facts: DataFrame, files: DataFrame) -> DataFrame:
    """All COLUMNS, by syntax: a sink's call meets the sources of the tainted names in its arguments, or, if it has none but calls a source there, all of its file."""
    tainted = stored(syntax_tainted(facts), "tainted")  # read by three joins
    calls = facts.where("fact = 'call'").withColumn("sink_kind", _first_kind(F.col("name"), SINKS)).where("sink_kind is not null")
    calls = calls.select("path", "seq", F.col("name").alias("sink_name"), "sink_kind", F.col("line").alias("sink_line"))
    refs = facts.where("fact = 'call_ref'").groupBy("path", "seq", "name").agg(F.min("ord").alias("ord"))
    by_name = calls.join(refs, ["path", "seq"]).join(tainted, ["path", "name"])
    inline = facts.where("fact = 'call_inner'").withColumn("source", _first_kind(F.col("name"), SOURCES)).where("source is not null").select("path", "seq").distinct()
    bare = calls.join(by_name.select("path", "seq").distinct(), ["path", "seq"], "left_anti").join(inline, ["path", "seq"], "left_semi").join(tainted, "path")
    columns = ["path", "source_var", F.col("kind").alias("source_kind"), F.col("line").alias("source_line"), "sink_name", "sink_kind", "sink_line"]
    points = tainted.select("path", "line").union(calls.select("path", "sink_line"))
    ranks = ranked(points, files, {"safe": SANITIZERS})
    judged = both_ends(by_name.select(*columns), ranks, "source_line", "sink_line")
    judged = judged.withColumn("confidence", F.when(between("safe"), SANITISED).otherwise(PLAIN))
    return judged.select(COLUMNS).union(bare.select(*columns, F.lit(INLINE).alias("confidence")))
