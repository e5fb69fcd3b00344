import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.functions.prefilter import ANYTHING, wider, widest
from corpusloom.functions.rules import Rule, built_in
from corpusloom.operators import between, facts, lines, reports
from corpusloom.operators.scan import explode_lines, find, scan, with_languages
from corpusloom.sources.batches import BATCH_BYTES

EVERY = [p for r in built_in() for p in r.patterns]
PARTS = ["requests", ".get", "(", "open", "f'", "'", '"', "eval", "`", "curl ", "| sh", "=", "password", "SELECT", "%", "\\x03", "sudo", "K", "ſ", "ı", "é", "日本", " ", "\t", "a1+/" * 13, "token", "eyJ", "rand", "+ x", "{", "<b", "AKIA" + "A1" * 9, "pip install http://", "return ", "-", "_"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice([*PARTS, "\n", "\n\n", "\r"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_wider_forms_occur_wherever_patterns_do():
    rng = random.Random(3)
    some = ["".join(rng.choices(PARTS, k=rng.randint(1, 9))) + "\n" for _ in range(4_000)]
    every = lines.matches(pa.array(some), widest(EVERY))
    for p in EVERY:
        hit = [bool(re.search(p, x, re.IGNORECASE)) for x in some]
        assert not any(h and not w for h, w in zip(hit, lines.matches(pa.array(some), wider([p])))), p
        assert not any(h and not w for h, w in zip(hit, every)), p
    assert sum(lines.matches(pa.array(["plain words of a text\n"] * 10), widest(EVERY))) == 0
    assert wider(["a(?P<x>b)(?P=x)"]) != ANYTHING and wider(["(?:(?:a{900}){900}b)"]) == ANYTHING
    assert list(lines.matches(pa.array(["KİK", "kik", "kk"]), wider(["kik"]))) == [True, True, False]


def test_found_lines_give_what_all_lines_give(spark):
    rows = [(f"f{i}.{e}", x, i) for i, (x, e) in enumerate(zip(texts(5, 1_500), ["py", "js", "sh", "txt", "rb", "php"] * 250))]
    files = with_languages(spark.createDataFrame([*rows, ("n.py", None, 0), ("e.py", "", 0), ("z.py", "\n", 0), ("l.py", "curl \n", 7)], "path string, content string, more int"))
    got = scan(files.select("path", "content", "more"), carry=["more"]).select("path", "line_number", "rule_ord", "rule_id", "matched_line", "context_note", "more")
    want = find(explode_lines(files.select("path", "language", "more", "content")), carry=["more"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 300
    own = [Rule("A", "", "low", "security", ["all"], [r"z$"]), Rule("B", "", "low", "security", ["all"], ["(?!)"])]
    assert scan(spark.createDataFrame([("a", "z\nzz\nb\nz")], "path string, content string"), own).count() == 3
    assert scan(files.select("path", "content"), []).count() == 0


def test_texts_are_searched_before_they_are_rows(spark):
    files = spark.createDataFrame([("a.py", "eval(x)\n")], "path string, content string")
    for df in (scan(files), between.ranked(spark.createDataFrame([("a.py", 1)], "path string, line int"), files, {"a": ["b"]})):
        assert plan(df).count("MapInArrow") == 1 and "(?<=" not in plan(df)


def test_reports_make_findings_once(spark):
    files = spark.createDataFrame([("a.py", "eval(input())\n"), ("b.py", "random.choice(x)\nrequests.get('http://a.b')\n"), ("c.md", "none")], "path string, content string")
    assert plan(reports.totals(files, scan(files))).count("MapInArrow") == 1
    assert reports.totals(files, scan(files)).first() == (3, scan(files).count(), 2, 2) and reports.totals(files, scan(files, [])).first() == (3, 0, 0, 0)


def test_a_listing_sorts_stored_findings(spark):
    files = spark.createDataFrame([("a.py", "eval(input())\n"), ("b.py", "random.choice(x)\nrequests.get('http://a.b')\n"), ("c.md", "none")], "path string, content string")
    listed = reports.tree_rows(scan(files))
    assert "MapInArrow" not in plan(listed) and [(r.path, r.rule_id) for r in listed.collect()] == [(r.path, r.rule_id) for r in scan(files).orderBy("category", "path", "line_number", "rule_ord").collect()]


@pytest.mark.parametrize("text", ["", "a", "abab", "\U0001f600é\U0001f600", "x" * 1000 + "y"])
def test_entropy_of_batches(text):
    want = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    assert math.isclose(lines.bits(pa.array(["q", text, "", "rr"]))[1], want, abs_tol=1e-12) and list(lines.bits(pa.array([], pa.string()))) == []
    assert list(lines.bits(pa.array(["rs", text, "rs"]).slice(2))) == [1.0]


def test_different_lines(spark):
    found = texts(8, 300)
    files = spark.createDataFrame([(x,) for x in [*found, None, "", "\n"]], "content string")
    rows = lines.with_entropy(lines.distinct_lines(files))
    assert Counter(r.text for r in rows.collect()) == Counter({line for x in [*found, "\n"] for line in (x[:-1] if x.endswith("\n") else x).split("\n") if x})
    assert "(?<=" not in plan(rows) and "aggregate" not in plan(rows).lower().replace("hashaggregate", "")


def test_parsers_get_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(64 << 20))
    files = spark.createDataFrame([(f"{i}.py", f"def f{i}():\n    g()\n" * 700 if i else "(") for i in range(30)], "path string, content string")
    found = facts.syntax_facts(with_languages(files))
    assert int(spark.conf.get(name)) <= BATCH_BYTES
    assert {r.fact: r["count"] for r in found.groupBy("fact").count().collect()} == {"function": 29 * 700, "call": 29 * 700, "error": 1}
