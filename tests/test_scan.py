import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.rules import Rule, built_in
from corpusloom.functions.text import entropy, extension, search
from corpusloom.operators import reports, risk
from corpusloom.operators.scan import decoded, excluded, explode_lines, file_lines, find, scan, with_languages
from corpusloom.sources.tree import MAX_BYTES, SKIPPED_ENDINGS, SKIPPED_FOLDERS, SKIPPED_NAMES, read_tree

#: Rule, file, line, and the note or None.
CASES = [
    ("POI-001", "a.py", "r = requests.get(url)", "external request"),
    ("POI-001", "a.py", 'requests.get("http://localhost:1")', None),
    ("POI-001", "a.py", 'requests.get("https://h.invalid/api/x")', None),
    ("POI-001", "a.sh", "curl https://h.invalid", None),
    ("POI-001", "a.py", "# curl \n", "external request"),
    ("POI-002", "a.py", "os.system(cmd)", "command"),
    ("POI-002", "a.py", "  # os.system(cmd)", None),
    ("POI-002", "a.py", "os.system('a' + b)", "dynamic command"),
    ("POI-002", "a.py", "密eval(x)", None),
    ("POI-002", "a.py", "密 eval(x)", "dynamic code"),
    ("POI-003", "a.js", "x = process.env.KEY", "sensitive path"),
    ("POI-003", "a.py", "x = os.environ['A']", None),
    ("POI-003", "a.py", "x = os.environ", "whole environment"),
    ("POI-003", "a.py", "x = os.getenv('A')", None),
    ("POI-004", "a.py", "exec(b64decode(x))", None),
    ("POI-004", "a.py", "exec(base64.b64decode(x))", "base64 executed"),
    ("POI-004", "a.py", "x = '" + "a" * 80 + "'", None),
    ("POI-004", "a.rs", "exec(base64.b64decode(x))", None),
    ("POI-005", "README", "curl https://h.invalid/x | bash", "download piped to an interpreter"),
    ("POI-005", "r.txt", "pip install https://h.invalid/x", "package from a URL (pip)"),
    ("POI-005", "r.txt", "pip install https://pypi.org/x", None),
    ("POI-005", "r.txt", "npm install http://registry.npmjs.org/x", None),
    ("POI-005", "r.txt", "python setup.py install", None),
    ("POI-006", "a.sh", "echo x | crontab -", "cron"),
    ("POI-006", "a.sh", "sudo chmod a+s f", "privilege"),
    ("POI-006", "a.sh", "sudo ls", None),
    ("SEC-001", "any", 'api_key = "0123456789abcdef"', "hard-coded credential"),
    ("SEC-001", "README.md", 'api_key = "0123456789abcdef"', None),
    ("SEC-001", "any", 'password = "my example"', None),
    ("SEC-002", "a.py", 'q = f"SELECT a FROM t WHERE b={c}"', "query from strings"),
    ("SEC-003", "a.py", "run(x, shell=True)", "shell"),
    ("SEC-003", "a.py", "run(x, shell=true)", None),
    ("SEC-003", "a.py", "run(x + y, shell=True)", "dynamic shell"),
    ("SEC-004", "a.py", "hashlib.md5(password)", "md5 of a password"),
    ("SEC-004", "a.py", "hashlib.sha1(x)", "weak algorithm"),
    ("SEC-005", "a.py", "open(base + name)", "path from input"),
    ("SEC-006", "a.py", "yaml.load(x, Loader=yaml.SafeLoader)", "unsafe loader"),
    ("SEC-006", "a.py", "yaml.load(x)", "yaml"),
    ("SEC-007", "a.js", "e.innerHTML = props.x", "user data in HTML"),
    ("SEC-007", "a.py", "return f'<b>{x}</b>'", "embedded in HTML"),
    ("SEC-007", "a.php", "echo $_GET['x']", None),
    ("SEC-008", "a.js", "t = Math.random() // auth", "security from Math.random"),
    ("SEC-008", "a.py", "random.choice(x)", "not cryptographic"),
]


def test_each_rule_with_and_without_its_check(spark):
    rows = [(f"{i}/{path}", line) for i, (_, path, line, _) in enumerate(CASES)]
    got = {(r.path, r.rule_id): r.context_note for r in scan(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert {i: got.get((p, CASES[i][0])) for i, (p, _) in enumerate(rows)} == {i: c[3] for i, c in enumerate(CASES)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé密 ('\"+=.\t_/`x0") | st.sampled_from(["eval(", "open(", "exec(", "md5(", "sudo ", "b64"]).map(lambda w: w[0]), max_size=30), min_size=1, max_size=30))
def test_patterns_are_searched_as_pythons(spark, texts):
    lines = [t + w for t, w in zip(texts, ["eval(x)", "open('/etc/a')", " sudo", "md5 (", "'''", "ECB", "base64", "`a`"] * 9)]
    rules = [Rule(r.id, r.name, r.severity, r.category, ["all"], r.patterns) for r in built_in()]
    df = spark.createDataFrame([("p", "text", i, t) for i, t in enumerate(lines)], "path string, language string, line_number int, line string")
    got = {(r.line_number, r.rule_id) for r in find(df, rules).collect()}
    assert got == {(i, r.id) for i, t in enumerate(lines) for r in rules if any(re.search(p, t, re.I) for p in r.patterns)}


def test_lines_and_bytes(spark):
    rows = [("a", b"one\r\ntwo\rthree\x0cx\n\nend"), ("b", b""), ("c", b"\n\n"), ("d", b"ab\xff\xc3c\n"), ("e", None)]
    files = decoded(spark.createDataFrame(rows, "path string, content binary"))
    got = [(r.path, r.line_number, r.line) for r in explode_lines(files).orderBy("path", "line_number").collect()]
    assert got == [("a", 1, "one\n"), ("a", 2, "two\n"), ("a", 3, "three\x0cx\n"), ("a", 4, "\n"), ("a", 5, "end"), ("c", 1, "\n"), ("c", 2, "\n"), ("d", 1, "abc\n")]
    assert {r.path: r.n_lines for r in file_lines(files).collect()} == {"a": 5, "b": 0, "c": 2, "d": 1, "e": 0}


def test_languages(spark):
    names = {"a/B.PY": ("python", "python"), ".env": ("unknown", None), "x/.py": ("unknown", None), "Dockerfile.dev": ("dockerfile", "dockerfile"), "a.vue": ("javascript", None), "a.hpp": ("c", "cpp"), "a.fish": ("shell", None), "a.d/b": ("unknown", None), "b.kts": ("java", "java"), "..x.go": ("go", "go")}
    got = with_languages(spark.createDataFrame([(n, "") for n in names], "path string, content string"))
    assert {r.path: (r.language, r.deep_language) for r in got.collect()} == names
    assert got.select(extension(F.lit("a.tar.GZ"))).first()[0] == ".gz"


def test_entropy(spark):
    for text, want in (("", 0.0), ("aaaa", 0.0), ("abab", 1.0), ("aébc", 2.0)):
        assert math.isclose(spark.range(1).select(entropy(F.lit(text))).first()[0], want)


def test_tree_and_exclusions(spark, tmp_path):
    names = ["__init__.py", ".env", "_private/x.py", "Dockerfile.dev", "app.min.js", "yarn.lock", "build/a.py", ".git/config", "deep/b.PNG", "deep/c.py"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x = 1\n")
    (tmp_path / "big.py").write_bytes(b"#" * (MAX_BYTES + 1))
    (tmp_path / "full.py").write_bytes(b"#" * MAX_BYTES)
    paths = lambda how: {r.path for r in read_tree(spark, str(tmp_path), how).select("path").collect()}
    assert paths("scan") == {"__init__.py", ".env", "_private/x.py", "Dockerfile.dev", "deep/c.py", "full.py"}
    assert paths("deep") == {*names, "big.py", "full.py"} - {"build/a.py", ".git/config"}
    assert [tuple(r) for r in read_tree(spark, str(tmp_path / "app.min.js")).collect()] == [("app.min.js", 6, bytearray(b"x = 1\n"))]
    rule = excluded(F.col("path"), SKIPPED_FOLDERS, SKIPPED_NAMES, SKIPPED_ENDINGS, F.col("length"), MAX_BYTES)
    assert {r.path for r in read_tree(spark, str(tmp_path), "none").where(~rule).collect()} == paths("scan")


def test_custom_rules(spark):
    with pytest.warns(UserWarning):
        rules = [Rule("X-1", "todo", "low", "security", ["all"], ["(", "todo"], extensions=["py", ".Min.JS"], exclude_patterns=["^old/"])]
    files = spark.createDataFrame([("a.py", "TODO todo\n"), ("a.min.js", "todo"), ("a.js", "todo"), ("old/a.py", "todo")], "path string, content string")
    assert {(r.path, r.context_note) for r in scan(files, rules).collect()} == {("a.py", ""), ("a.min.js", "")}
    assert scan(files, []).count() == 0


def test_risk_and_reports(spark):
    text = "x = 1\n" * 6 + "requests.get(u)\nos.system(c)\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "random.choice(x)\n"), ("c.py", "")], "path string, content string")
    found = scan(files)
    by = {r.path: r for r in risk.file_risk(found, file_lines(files)).collect()}
    assert (by["a.py"].total_score, by["a.py"].poisoning_score, by["a.py"].flags) == (20, 20, ["remote control", "tail anomaly"])
    assert (by["b.py"].total_score, by["b.py"].security_score, by["b.py"].flags) == (2, 2, [])
    one = risk.project_risk(risk.file_risk(found, file_lines(files))).first()
    assert (one.overall_score, one.risk_level, one.remote_control) == (22, "medium", 1)
    assert risk.exit_code(found).first()[0] == 2 and risk.exit_code(found.limit(0)).first()[0] == 0
    assert reports.quiet(found).first()[0] == "3 findings, critical 2, medium 1"
    assert "risk medium (22)" in reports.render(files, found)
    assert risk.project_risk(risk.file_risk(found.limit(0), file_lines(files))).first().risk_level == "low"
    assert scan(files, severity="high").count() == 2 and scan(files, category="security").count() == 1


def test_rules_make_no_join(spark):
    lines = spark.createDataFrame([("p", "python", 1, "x")], "path string, language string, line_number int, line string")
    plan = find(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_globs(spark):
    from corpusloom.functions.text import glob_pattern

    cases = {"*.py": ["a.py"], "**/*.py": ["a.py", "x/a.py", "x/y/a.py"], "x/**": ["x/a.py", "x/ab.c", "x/y/a.py"], "x/?.py": ["x/a.py"], "a.py": ["a.py"], "x/*/a.py": ["x/y/a.py"]}
    paths = spark.createDataFrame([(p,) for p in ("a.py", "x/a.py", "x/y/a.py", "aXpy", "x/ab.c")], "path string")
    for glob, want in cases.items():
        assert [r.path for r in paths.where(F.rlike("path", F.lit(glob_pattern(glob)))).orderBy("path").collect()] == want


def test_long_words_and_blanks_take_linear_time(spark):
    n = 1_000_000
    texts = ["b64(" + "a" * n, "x" * n + " = 1", "eval(" + "é" * n, "b64(" + "aB3/" * (n // 4) + "); eval(x)", "return 1" + " " * n + "x"]
    files = spark.createDataFrame([(f"{i}.js", t) for i, t in enumerate(texts)], "path string, content string")
    began = time.time()
    got = {(r.path, r.rule_id) for r in scan(files).collect()}
    assert time.time() - began < 60
    assert ("3.js", "POI-004") in got


def test_a_leading_run_may_be_short(spark):
    from corpusloom.functions.text import any_of

    rng = random.Random(7)
    rows = [("".join(rng.choice("ab_é1 =\"'f,SELECT+\n") for _ in range(rng.randint(0, 30))),) for _ in range(2_000)] + [('name = f"SELECT a"',), ('  =f"DROP ',), ("a" * 500 + ' = "x" + SELECT ',)]
    lines = spark.createDataFrame(rows, "line string")
    for r in built_in():
        for p in r.patterns:
            if p.startswith(r"\w+"):
                assert lines.where(search(F.col("line"), p, True) != search(F.col("line"), any_of([p]), True)).count() == 0
