import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import context, rules
from corpusloom.functions.gaps import in_two_gaps, linear
from corpusloom.functions.text import INSTEAD, any_of, search

# words and marks of the rewritten patterns
PARTS = ["x03", "x0f", " ", "curl", "wget", "|", "bash", "sh", "python", "pip", "install", "http://", "https://", "pypi.org", "npm", "npmjs.com", "go", "get", "github.com", "docker", "run", "Set-ItemProperty", "Registry", "chmod", "+s", "a", " = ", '"', "'", "+", "SELECT", "DROP", ".format", "(", ")", "%", "eyJ", ".", "-", 'f"', "f'", "*", ",", "return", "response", "<b", "<", ">", "{", "reg add", "chown root", "yaml.load", "Loader=yaml.SafeLoader", "é", "\t", "_"]

MATCHES = ['a = "b, c" + d SELECT', "x='y'+z drop_ DROP\n", 'q = f"a, SELECT', ".format(a) b SELECT", "'%s UPDATE", '" % (a) DELETE', "eyJa.eyJb.c", "x03 x0f", "yaml.load(a)", "response f'<b>{"]


def lines_of(pattern, n):
    """Lines of a pattern's own words, in any order and in its own."""
    rng = random.Random(pattern)
    plain = pattern.replace("\\", "")
    words = [p for p in PARTS if p.strip() and p.strip() in plain]
    short = [p for p in PARTS if len(p.strip()) < 3]
    ordered = sorted(words, key=lambda w: plain.find(w.strip()))
    if "<[a-zA-Z]" in plain:
        ordered = ["return", "f'", "<b", "{"]
    if "eyJ" in plain:
        words.append("eyJa.eyJ_.a")
    out = []
    for _ in range(n):
        line = rng.choices(words + short, k=rng.randint(0, 8))
        for _ in range(rng.randint(0, 3)):
            line += [x for w in ordered if rng.random() < 0.8 for x in (w, rng.choice(["", " ", " ", rng.choice(short)]))]
        out.append("".join(line + rng.choices(words + short, k=rng.randint(0, 3))) + rng.choice(["", "\n"]))
    return out + MATCHES + [rng.choice(out).strip("\n") + m for m in MATCHES * 20]


def test_the_same_lines_match(spark):
    assert len(INSTEAD) > 20 and not any(old == new for old, new in INSTEAD.items())
    rows = [(old, line) for old in INSTEAD for line in lines_of(old, 1_500)]
    df = spark.createDataFrame(rows, "pattern string, line string").repartition(8)
    for flags in ("(?Ud)", "(?iUd)"):
        was, now = F.lit(False), F.lit(False)
        for old, new in INSTEAD.items():
            own = F.col("pattern") == old
            was, now = was | own & F.rlike("line", F.lit(flags + old)), now | own & F.rlike("line", F.lit(flags + new))
        seen = df.select("*", was.alias("was"), now.alias("now"))
        got = seen.groupBy("pattern").agg(F.count_if("was").alias("n"), F.count_if(F.col("was") != F.col("now")).alias("other"), F.count("*").alias("lines")).collect()
        assert {r.pattern for r in got} == set(INSTEAD)
        for r in got:
            assert r.other == 0 and 0 < r.n < r.lines, r


@pytest.mark.parametrize("rule", rules.built_in(), ids=lambda r: r.id)
def test_a_megabyte_of_a_patterns_beginning(spark, rule):
    """Lines made of what patterns begin with, again and again, take a second or two, checks included."""
    beginnings = ["pip install ", "curl x ", "wget ", "docker run ", "go get http://", "chmod ", "Set-ItemProperty ", ".format(", "'%a", '"%(', "a=f\"", "eyJ", "return f'<a", "yaml.load ", "x03 ", "a='b'+", "npm install https://"]
    text = [(b * (1_000_000 // len(b)) + "\n",) for b in beginnings]
    df = spark.createDataFrame(text, "line string").repartition(len(text)).withColumn("path", F.lit("a.py"))
    hit = search(F.col("line"), any_of(rule.patterns), True)
    began = time.time()
    df.select(F.when(hit, rule.context(F.col("line"), F.col("path")))).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 45


def test_forms():
    assert linear("a b") == "a b" and linear("[.*]b") == "[.*]b" and linear(r"a\.*b") == r"a\.*b"
    assert linear(r"a\s+.*b(?!.*c)") == r"\A(?>.*?a\s)(?>.*b)(?!.*c)"
    assert linear("(?:a.*b|c)") == r"(?:\A(?>.*?a).*b|c)" and linear("(?:a|b).*c") == r"\A(?>.*?(?:a|b)).*c"
    assert in_two_gaps("a[^x]*b[^x]*c") == "a(?>[^x]*?b)[^x]*c"
    for old in INSTEAD:
        re.compile(old)
    assert context.RETURNED_HTML in INSTEAD and rules.SEC_007[0] not in INSTEAD
