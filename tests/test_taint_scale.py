import random
import time

import pytest

from corpusloom.functions.flows import PLAIN, SANITISED
from corpusloom.operators import between, chains, taint
from corpusloom.operators.scan import with_languages
from corpusloom.operators.spread import spread
from corpusloom.sources.shared import stored


def plainly(known, steps, rounds):
    known = dict(known)
    for _ in range(rounds):
        new = {}
        for name, reads in steps:
            first = next((r for r in reads if r in known), None)
            if name not in known and name not in new and first is not None:
                new[name] = known[first]
        if not new:
            break
        known |= new
    return known


@pytest.mark.parametrize("seed", range(40))
def test_spread_is_that_of_all_with_all(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(rng.choice([5, 12, 40]))]
    steps = [(rng.choice(names), rng.choices(names, k=rng.randint(0, 4))) for _ in range(rng.randint(0, 80))]
    known = {n: n for n in rng.sample(names, rng.randint(0, 3))}
    for rounds in (1, 3, 5):
        got = spread(known, steps, rounds)
        assert got == plainly(known, steps, rounds) and list(got)[: len(known)] == list(known)


def test_spread_costs_its_length():
    n = 200_000
    steps = [(f"b{i % 7}_{i}", [f"a{i % 5}", "x", "x"]) for i in range(n)]
    began = time.process_time()
    assert len(spread({f"a{i}": i for i in range(5)}, steps, 5)) == n + 5
    assert time.process_time() - began < 5


def took(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def files_of(spark, **texts):
    return with_languages(spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "path string, content string"))


def test_a_text_is_split_once_and_its_rounds_run_once(spark):
    plan = taint.text_paths(files_of(spark, a_js="x = req.query.a;\neval(x)\n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("(?<=") == 1 and plan.count("pattern)") < 12


def test_many_assignments_and_paths_of_one_file(spark):
    chain = "a0 = req.query.x;\n" + "".join(f"a{i % 9 + 1}_{i} = a0 + b{i};\n" for i in range(100_000)) + "eval(a5_4)\n"
    took(taint.text_paths(files_of(spark, w_js="x = req.query.a;\neval(x)\n")))
    assert took(taint.text_paths(files_of(spark, a_js=chain))) < 20
    grid = "".join(f"s{i} = req.query.x;\n" for i in range(400)) + "escape(1)\n" + "".join(f"eval(s{i})\n" for i in range(400))
    paths = stored(taint.text_paths(files_of(spark, a_js=grid)), "paths")
    assert paths.count() == 160_000 and paths.where(f"confidence = {SANITISED}").count() == 160_000
    assert took(chains.chains(paths, files_of(spark, a_js=grid))) < 20


LINES = ["x = 1", " const y=2", "let z : T = 3", "var a, b = 1", "const , b = 1", "const = 1", "let let c = 1", "if d = 1", "iffy = 1", "e == 2", "f.g = 1", "1h = 2", "= 3", "no", "# i = 1", "j = 1", "ük = 1", "const\tk = 1", "l, m: n = 1", "o: p, q = 1", "var  r=s", "let =", "t= u=v", ""]


def test_assigned_names(spark):
    """The name as splitting and stripping, step by step, would find it."""

    def want(line):
        s = line.strip()
        if "=" not in s or s.startswith(("if", "for", "while")):
            return None
        left = s.split("=", 1)[0].strip()
        for word in ("const ", "let ", "var "):
            if left.startswith(word):
                left = left[len(word) :].strip()
                break
        first = left.split(",")[0].strip().split(":")[0].strip()
        return first if first.isidentifier() else None

    rng = random.Random(2)
    parts = ["const ", "let ", "var ", "a", "_b1", "=", " = ", ",", ":", " ", "\t", "1", "if", "for ", ".", "é", "(", "=="]
    lines = LINES + ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(3_000)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", taint.assigned(taint.F.col("line")).alias("name")).collect()
    assert [(r.line, r["name"]) for r in got if r["name"] != want(r.line)] == []


def test_ranks_against_lines(spark):
    rng = random.Random(4)
    words = {"a": ["alpha", "Beta"], "b": ["gamma"]}
    text = {f"f{i}.py": [rng.choice(["alpha", "xBETA", "gamma", "none", ""]) for _ in range(40)] for i in range(3)}
    files = spark.createDataFrame([(p, "\n".join(lines) + "\n") for p, lines in text.items()], "path string, content string")
    pairs = [(p, rng.randint(1, 40), rng.randint(1, 40)) for p in text for _ in range(60)]
    df = spark.createDataFrame(pairs, "path string, s int, k int")
    points = df.selectExpr("path", "s as line").union(df.selectExpr("path", "k"))
    got = between.both_ends(df, between.ranked(points, files, words), "s", "k")
    rows = {(r.path, r.s, r.k): (r.a, r.b, r["head"].on_a, r["tail"].on_b) for r in got.select("*", between.between("a").alias("a"), between.between("b").alias("b")).collect()}
    has = lambda p, n, some: any(w.lower() in text[p][n - 1].lower() for w in words[some])
    assert rows == {(p, s, k): (*(any(has(p, n, x) for n in range(s + 1, k)) for x in "ab"), has(p, s, "a"), has(p, k, "b")) for p, s, k in pairs}
    assert PLAIN > SANITISED
