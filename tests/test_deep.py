import itertools
import random

from corpusloom.__main__ import main
from corpusloom.operators import callgraph, chains, facts, taint
from corpusloom.operators.scan import with_languages
from corpusloom.plans.deep import analyse, deep_exit_code, deep_summary
from corpusloom.streaming.scan import latest, scan_stream


def table(spark, **texts):
    return with_languages(spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "path string, content string"))


def test_facts(spark):
    text = "import os, sys\nfrom .a import b\n@dec(1)\ndef f(x, y=g()):\n    def h():\n        k(*x, z=len(y))\n    return h()\nclass C:\n    def m(self):\n        self.n(f'{x}')\nprint(1)\n"
    f = facts.python_facts(table(spark, a_py=text, b_py="def (", c_js="f()", d_py=""))
    assert [(r.name, r.line_start, r.line_end, r.params) for r in facts.symbols(f).orderBy("line_start").collect()] == [("f", 4, 7, ["x", "y"]), ("h", 5, 6, []), ("m", 9, 10, ["self"])]
    assert sorted((r.caller, r.callee, r.line) for r in facts.call_edges(f).collect()) == [("f", "h", 7), ("h", "k", 6), ("h", "len", 6), ("m", "self.n", 10)]
    assert sorted(r.name for r in facts.imports(f).collect()) == ["a.b", "os", "sys"]
    assert [r.path for r in facts.errors(f).collect()] == ["b.py"]


HOPS = "a = input()\n" + "".join(f"{y} = {x}\n" for x, y in itertools.pairwise("abcdefgh"))


SYNTAX_TAINT = [
    ("c = input()\nos.system(c)\n", [("c", "stdin", 1, "os.system", "command_exec", 2, 0.85)]),
    ("c = input()\nd = [c]\neval(d)\n", [("c", "stdin", 1, "eval", "code_exec", 3, 0.85)]),
    (HOPS + "eval(f)\n", [("a", "stdin", 1, "eval", "code_exec", 9, 0.85)]),
    (HOPS + "eval(g)\n", []),
    ("c: str = input()\neval(c)\n", []),
    ("(c, d) = input()\neval(c)\n", []),
    ("c = input()\nd = c.strip()\neval(d)\n", []),
    ("c = input()\nd = c.attr\neval(d)\n", [("c", "stdin", 1, "eval", "code_exec", 3, 0.85)]),
    ("c = input()\nisinstance(c, str)\neval(c)\n", [("c", "stdin", 1, "eval", "code_exec", 3, 0.3)]),
    ("c = input()\neval(input())\n", [("c", "stdin", 1, "eval", "code_exec", 2, 0.6)]),
    ("eval(input())\n", []),
    ("eval(c)\nc = input()\n", [("c", "stdin", 2, "eval", "code_exec", 1, 0.85)]),
    ("c = input()\nc = requests.get(u)\neval(c)\n", [("c", "network_recv", 2, "eval", "code_exec", 3, 0.85)]),
    ("c = 1\neval(c)\n", []),
]


def test_syntax_taint(spark):
    files = table(spark, **{f"f{i}_py": text for i, (text, _) in enumerate(SYNTAX_TAINT)})
    found = {}
    for r in taint.syntax_paths(facts.python_facts(files), files).orderBy("source_line", "sink_line").collect():
        found.setdefault(r.path, []).append((r.source_var, r.source_kind, r.source_line, r.sink_name, r.sink_kind, r.sink_line, r.confidence))
    for i, (text, want) in enumerate(SYNTAX_TAINT):
        assert found.get(f"f{i}.py", []) == want, text


def test_text_taint(spark):
    js = "const cmd = req.query.c;\nif (cmd == 1) x = cmd;\nlet line = cmd;\n// skip\nexec(line);\n"
    go = "data := os.Getenv(\"A\")\n# data = os.Args\nisdigit(data)\nexec.Command(data)\n"
    got = taint.text_paths(table(spark, a_js=js, b_go=go, c_py="x = 1\n"))
    rows = sorted((r.path, r.source_var, r.source_kind, r.source_line, r.sink_kind, r.sink_line, r.confidence) for r in got.collect())
    assert rows == [("a.js", "cmd", "http_param", 1, "command_exec", 5, 0.85), ("b.go", "data", "env_read", 1, "command_exec", 4, 0.3)]
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()


def test_chains_and_summary(spark, capsys, tmp_path):
    text = "import requests\ndef run():\n    page = requests.get(u)\n    code = base64.decode(page)\n    exec(page)\n"
    send = 'secret = os.getenv("TOKEN")\ntoken = os.getenv("TOKEN_2")\nrequests.post(u, data=[secret, token])\n'
    files = table(spark, a_py=text, b_py=send, c_py="def (", d_py="x = 1\n").select("path", "content")
    deep = analyse(files, by_text=False)
    got = {(r.path, r.chain_name): (r.n_paths, round(r.confidence, 6), r.summary) for r in deep.chains.collect()}
    assert got == {
        ("a.py", "Download & Execute"): (1, 0.725, "[CRITICAL] Download & Execute (72%)\nline 3 -> line 5"),
        ("a.py", "Dynamic Code Injection"): (1, 0.725, "[CRITICAL] Dynamic Code Injection (72%)\nline 3 -> line 5"),
        ("b.py", "Credential Theft & Exfil"): (2, 0.8, "[CRITICAL] Credential Theft & Exfil (80%)\nline 1 -> line 3\nline 2 -> line 3"),
    }
    assert sorted((r.path, r.taint_paths, r.attack_chains, r.errors) for r in deep_summary(files, deep).collect()) == [("a.py", 1, 2, 0), ("b.py", 2, 1, 0), ("c.py", 0, 0, 1)]
    assert deep_exit_code(deep).first()[0] == 2
    (tmp_path / "a.py").write_text(text)
    assert main([str(tmp_path), "--deep"], spark) == 2 and "2 chains" in capsys.readouterr().out
    assert main([str(tmp_path), "--quiet"], spark) == 2 and "findings" in capsys.readouterr().out
    assert main([str(tmp_path), "--json", "--category", "security"], spark) == 0


def test_a_call_path_raises_the_confidence(spark):
    text = "import requests\ndef run():\n    page = requests.get(u)\n    code = base64.decode(page)\n    exec(page)\n"
    files = table(spark, a_py=text, b_py=text)
    paths = taint.syntax_paths(facts.python_facts(files), files)
    called = spark.createDataFrame([("a.py", "Download & Execute"), ("a.py", "Download & Execute"), ("b.py", "none")], "path string, chain_name string")
    got = {(r.path, r.chain_name): (r.n_paths, round(r.confidence, 6)) for r in chains.chains(paths, files, called).collect()}
    assert got["a.py", "Download & Execute"] == (1, 0.8) and got["b.py", "Download & Execute"] == (1, 0.725)


def test_call_graph_against_searches(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", rng.choice("abcdefg"), rng.choice("abcdefg"), 1) for g in range(6) for _ in range(9)] + [("chain", x, y, 1) for x, y in itertools.pairwise("abcdefgh")]
    edges = spark.createDataFrame(rows, "path string, caller string, callee string, line int")

    def walks(path, source, n):
        at = [[source]]
        for _ in range(n):
            yield from at
            at = [[*w, c] for w in at for p, a, c, _ in rows if p == path and a == w[-1] and c not in w[:-1]]
        yield from at

    paths = sorted({r[0] for r in rows})
    names = "abcdefgh"
    reach = set()
    for p, s in itertools.product(paths, names):
        level = {s}
        for _ in range(5):
            level = {c for q, a, c, _ in rows if q == p and a in level}
            reach |= {(p, s, c) for c in level}
    assert {tuple(r) for r in callgraph.reachable(edges).select("path", "source", "target").collect()} == reach
    assert {tuple(r) for r in callgraph.on_cycle(edges).collect()} == {(p, s) for p, s, t in reach if s == t}
    pairs = spark.createDataFrame([(p, "a", t) for p in paths for t in "bdg"], "path string, source string, target string")
    got = sorted((r.path, r.target, r.names) for r in callgraph.all_paths(edges, pairs).collect())
    assert got == sorted((p, t, w) for p in paths for t in "bdg" for w in walks(p, "a", 5) if w[-1] == t and t not in w[:-1])
    assert {(r.path, r.target): r.connected for r in callgraph.has_path(edges, pairs).collect()} == {(p, t): (p, "a", t) in reach for p in paths for t in "bdg"}
    for r in callgraph.cycles(edges).collect():
        assert r.names[0] == r.names[-1] == min(r.names) and len(set(r.names)) == len(r.names) - 1
    chain = {r.path: r for r in callgraph.degrees(edges).collect()}["chain"]
    assert (chain.total_nodes, chain.total_edges, chain.isolated_nodes, chain.max_callers, chain.max_callees) == (8, 7, 0, 1, 1)


def test_stream_replaces_a_paths_findings(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    write = lambda rows: spark.createDataFrame(rows, "path string, content string").write.mode("append").parquet(source)
    run = lambda: scan_stream(spark.readStream.schema("path string, content string").parquet(source), out, mark).awaitTermination()
    write([("a.py", "eval(x)\n"), ("b.py", "eval(x)\n")])
    run()
    write([("a.py", "x = 1\n"), ("c.py", "exec(x)\n")])
    run()
    assert {(r.path, r.rule_id) for r in latest(spark, out).collect()} == {("b.py", "POI-002"), ("c.py", "POI-002")}
