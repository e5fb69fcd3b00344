"""URL filters by host-suffix and path-prefix expressions on short hash prefixes.

Each distinct URL is expanded into expressions: every suffix of its host with as many
labels as some rule's host, with every prefix of its path as long as some rule's path; so a long
host costs no more than its length for each such number. An expression joins the rules on the first four bytes of its SHA-256; the whole
digest then confirms the match, and the longest rule wins (of equal ones, block).

All of it is DataFrame functions. The expanded rows carry only the digest and the URL,
a URL that many pages share is judged once, and AQE may split a rule that
fits a third of all rows, because both sides of the join are plain exchanges.

Defined results: null or no ``://`` gives host and path "", no rule and the
default verdict; a host keeps its port and user; repeated rows are all returned; a rule with a null
host, path or verdict is none; columns of pages other than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.tables import ascii_lower, read

#: Up to so many rules are broadcast (under 20 MB); more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: The rules of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_DIGEST_PREFIX = 8  # hex digits


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def rules_table(spark: SparkSession, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per rule text with its digest; a rule given as both is a block."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    df = df.where("host is not null and path is not null and verdict is not null").withColumn("host", ascii_lower("host"))
    df = df.select(F.concat("host", "path").alias("rule"), F.length("path").alias("path_len"), _labels("host").alias("labels"), F.col("verdict").alias("rule_verdict"))
    df = df.groupBy("rule", "path_len", "labels").agg(F.max("rule_verdict").alias("rule_verdict"))
    # '\n' can be in neither part of an expression's border, so host and path can't run into each other
    return df.withColumn("digest", F.sha2(F.concat_ws("\n", F.expr("left(rule, length(rule) - path_len)"), F.expr("right(rule, path_len)")), 256))


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    c, at = F.col(url), F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(c, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substr(rest, F.length(host) + 1)
    return df.withColumns({"host": ascii_lower(host), "path": F.regexp_extract(after, r"^([^?#]*)", 1)})


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages; rules: rows or a table of host, path, verdict."""
    pages = pages.select("page_id", "url")
    table = rules_table(pages.sparkSession, rules).withColumn("prefix", F.substring("digest", 1, _DIGEST_PREFIX))
    # what all rules have in common: their number and the few different lengths of hosts and paths
    n_rules, numbers, lengths = table.agg(F.count("*"), F.collect_set("labels"), F.collect_set("path_len")).first()
    if not n_rules:
        return split_url(pages).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    urls = split_url(pages.where("url is not null").select("url").distinct())
    deep = F.filter(F.array(*map(F.lit, sorted(numbers))), lambda n: n <= _labels("host"))
    suffixes = F.transform(deep, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    lengths = sorted(lengths)
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))
    expanded = urls.select("url", F.explode(expressions).alias("full")).withColumn("prefix", F.substring("full", 1, _DIGEST_PREFIX))

    side = F.broadcast(table) if n_rules <= BROADCAST_RULES else table
    found = expanded.join(side, "prefix").where(F.col("full") == F.col("digest"))
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule_verdict", "rule")).alias("best"))
    return (
        split_url(pages)
        .join(best, "url", "left")
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS n,
                CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n,
                 translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(regexp_extract(r, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""
