import random

from corpusloom.operators import callgraph
from corpusloom.operators.components import components
from corpusloom.plans import queries
from corpusloom.plans.queries import QUERIES


def test_paths_of_all_functions_and_unconnected_pairs(spark, monkeypatch):
    calls = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame([("f", *e, 1) for e in calls] + [("g", "a", "z", 1)], "path string, caller string, callee string, line int")
    monkeypatch.setattr(queries, "_facts", lambda spark, sf_dir: (edges, None))
    monkeypatch.setattr(queries.facts, "call_edges", lambda facts: facts)
    got = {(r.path, r.source + r.target): r.connected for r in QUERIES["calls_connected"](spark, "").collect()}
    f = {"ab": True, "ac": True, "ad": True, "bc": True, "bd": True, "cd": True, "xy": True, "yx": True, "xx": True, "yy": True}
    f |= {"ba": False, "ca": False, "da": False, "cb": False, "db": False, "dc": False}
    assert got == {("f", k): v for k, v in f.items()} | {("g", "az"): True, ("g", "za"): False}
    paths = sorted((r.path, r.names) for r in QUERIES["calls_paths_of_all"](spark, "").collect())
    assert paths == sorted([("f", n) for n in ("a>b", "a>b>c", "a>b>c>d", "b>c", "b>c>d", "c>d", "x>y", "y>x", "x", "y")] + [("g", "a>z")])


def shortest_and_short(calls, depth=5):
    """All simple cycles of at most depth calls and, of each call, the first of the shortest ones, by walking."""
    graph = {}
    for a, b in set(calls):
        graph.setdefault(a, []).append(b)
    found = []
    walks = [[a] for a in graph]
    while walks:
        walks, now = [], walks
        for w in now:
            for c in graph.get(w[-1], ()):
                if c == w[0]:
                    found.append(w)
                elif c not in w:
                    walks.append([*w, c])
    few = {}
    for w in sorted(found, key=lambda w: (len(w), w)):
        few.setdefault((w[0], w[1] if len(w) > 1 else w[0]), w)
    out = set()
    for w in [*(w for w in found if len(w) <= depth), *few.values()]:
        k = w.index(min(w))
        out.add((*w[k:], *w[: k + 1]))
    return out, {x for w in found for x in w}


def test_cycles_of_any_length(spark):
    rng = random.Random(8)
    graphs = {f"g{g}": [(rng.choice("abcdefghi"), rng.choice("abcdefghi")) for _ in range(rng.randint(4, 13))] for g in range(12)}
    ring = lambda n: [(f"f{i:03}", f"f{(i + 1) % n:03}") for i in range(n)]
    graphs |= {"seven": ring(7), "fifty": ring(50) + [("f010", "x"), ("y", "f020")], "none": [("a", "b"), ("b", "c")], "self": [("a", "a"), ("a", "b")]}
    edges = spark.createDataFrame([(p, a, b, 1) for p, calls in graphs.items() for a, b in calls], "path string, caller string, callee string, line int")
    got, on = {}, {}
    for r in callgraph.cycles(edges).collect():
        assert tuple(r.names) not in got.setdefault(r.path, set())
        got[r.path].add(tuple(r.names))
    for r in callgraph.on_cycle(edges).collect():
        on.setdefault(r.path, set()).add(r.name)
    for path, calls in graphs.items():
        cycles, names = shortest_and_short(calls)
        assert got.get(path, set()) == cycles and on.get(path, set()) == names
    assert len(on["fifty"]) == 50 and {len(c) for c in got["fifty"]} == {51} and {len(c) for c in got["seven"]} == {8}
    parts = {(r.path, r.name): r.component for r in callgraph.call_components(edges).collect()}
    assert parts["fifty", "f049"] == "f000" and ("none", "a") not in parts


def test_components_of_a_long_chain_and_a_large_ring():
    n = 50_000
    graph = {str(i): [str(i + 1)] for i in range(n)}
    assert components(graph) == []
    [part] = components(graph | {str(n): ["0"]})
    assert len(part) == n + 1
