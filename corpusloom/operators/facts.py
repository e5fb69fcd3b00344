"""Syntax facts of files: functions, calls, assignments, imports and errors as rows.

Parsing is the only step that leaves the JVM: one mapInArrow from files to rows of one table, which all
later steps filter and join. PARSERS names the languages; Python has a syntax tree, those of grammars.GRAMMARS are read by their brackets,
the shell by its words. A file that doesn't parse gives one error row and nothing else, whatever stopped it.

In Python's syntax tree only statements' bodies and these expressions are entered: a call's arguments (not what is called), a name,
an attribute's object, a subscript's base, and the fields of everything else. Sequence numbers follow that
order from the top down.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Collection, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.grammars import GRAMMARS
from corpusloom.functions.text import taint_language
from corpusloom.operators.brackets import bracket_facts, shell_facts
from corpusloom.sources.batches import in_batches

#: fact: function, call, call_ref, call_inner, assign, assign_ref, import, error.
FACT = "fact string, seq int, ord int, name string, caller string, line int, line_end int, params array<string>, value_call string, value_line int, chain string"
SCHEMA = f"path string, language string, {FACT}"
_ARROW = pa.schema(
    [("path", pa.string()), ("language", pa.string()), ("fact", pa.string()), ("seq", pa.int32()), ("ord", pa.int32()), ("name", pa.string()), ("caller", pa.string()), ("line", pa.int32()), ("line_end", pa.int32())]
    + [("params", pa.list_(pa.string())), ("value_call", pa.string()), ("value_line", pa.int32()), ("chain", pa.string())]
)


def name_of(node: ast.AST) -> str:
    """The dotted name of an expression; '' if it has none. Chains may be of any length."""
    parts: list[str] = []
    while True:
        match node:
            case ast.Attribute():
                parts.append(node.attr)
                node = node.value
            case ast.Subscript():
                node = node.value
            case ast.Call():
                node = node.func
            case _:
                first = node.id if isinstance(node, ast.Name) else repr(node.value) if isinstance(node, ast.Constant) else ""
                return ".".join([first, *reversed(parts)])


def inner(node: ast.AST) -> list[ast.AST]:
    """What is entered below a node."""
    match node:
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            return list(node.body)
        case ast.Call():
            return [*node.args, *(k.value for k in node.keywords)]
        case ast.Assign() | ast.Attribute() | ast.Subscript():
            return [node.value]
        case ast.AnnAssign():
            return [node.value] if node.value else []
        case ast.BinOp():
            return [node.left, node.right]
        case ast.Dict():
            return [x for pair in zip(node.keys, node.values) for x in pair if x]
        case ast.Name() | ast.Constant() | ast.Import() | ast.ImportFrom():
            return []
    return list(ast.iter_child_nodes(node))


def below(node: ast.AST, caller: str | None = None) -> Iterator[tuple[ast.AST, str | None]]:
    """The node and all that is entered below it, from the top down, each with the function around it."""
    stack = [(node, caller)]
    while stack:
        at, caller = stack.pop()
        yield at, caller
        inside = at.name if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef)) else caller
        stack.extend((x, inside) for x in reversed(inner(at)))


def _chain(node: ast.AST) -> str:
    """Names below a node, joined by dots; one that repeats the last is left out."""
    out: list[str] = []
    for x, _ in below(node):
        name = x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else ""
        if name and (not out or out[-1] != name):
            out.append(name)
    return ".".join(out)


def facts_of(content: str) -> Iterator[dict]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(content)
    for seq, (node, caller) in enumerate(below(tree)):
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                yield {"fact": "function", "seq": seq, "name": node.name, "line": node.lineno, "line_end": node.end_lineno, "params": [a.arg for a in node.args.args]}
            case ast.Call():
                yield {"fact": "call", "seq": seq, "name": name_of(node.func), "caller": caller, "line": node.lineno}
                parts = [x for a in inner(node) for x, _ in below(a)]
                for n, x in enumerate(x for x in parts if isinstance(x, ast.Name)):
                    yield {"fact": "call_ref", "seq": seq, "ord": n, "name": x.id}
                for n, x in enumerate(x for x in parts if isinstance(x, ast.Call)):
                    yield {"fact": "call_inner", "seq": seq, "ord": n, "name": name_of(x.func)}
            case ast.Assign() if target := name_of(node.targets[0]):
                calls = [x for x, _ in below(node.value) if isinstance(x, ast.Call)]
                yield {"fact": "assign", "seq": seq, "name": target, "line": node.value.lineno, "value_call": name_of(calls[0].func) if calls else None, "value_line": calls[0].lineno if calls else None, "chain": None if isinstance(node.value, ast.Call) else _chain(node.value)}
                for n, x in enumerate(x for x, _ in below(node.value) if isinstance(x, ast.Name)):
                    yield {"fact": "assign_ref", "seq": seq, "ord": n, "name": x.id}
            case ast.Import():
                yield from ({"fact": "import", "seq": seq, "ord": n, "name": a.name} for n, a in enumerate(node.names))
            case ast.ImportFrom():
                yield from ({"fact": "import", "seq": seq, "ord": n, "name": f"{node.module or ''}.{a.name}"} for n, a in enumerate(node.names))


#: Deep language and what reads it.
PARSERS: dict[str, Callable[[str], Iterator[dict]]] = {"python": facts_of, **{x: partial(bracket_facts, language=x) for x in GRAMMARS}, "bash": shell_facts}
#: Rows that leave a task at once.
ROWS = 5_000


def rows_of(parse: Callable[[str], Iterator[dict]], content: str) -> list[dict]:
    """The facts of a text; one error row if it can't be read."""
    try:
        return list(parse(content))
    except Exception as e:
        return [{"fact": "error", "seq": 0, "name": f"{type(e).__name__}: {e}"}]


def syntax_facts(files: DataFrame, languages: Collection[str] | None = None) -> DataFrame:
    """The facts of the files of some deep languages, or of all that have a parser; files has path, deep_language and content.

    language names the sources and sinks that hold for a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, language, content, parser in zip(*(batch.column(i) for i in range(4))):  # one text at a time is Python's
                rows += ({"path": path.as_py(), "language": language.as_py(), **x} for x in rows_of(PARSERS[parser.as_py()], content.as_py() or ""))
                if len(rows) >= ROWS:
                    yield from (pa.RecordBatch.from_pylist(rows[a : a + ROWS], _ARROW) for a in range(0, len(rows), ROWS))
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    some = files.where(F.col("deep_language").isin(list(PARSERS if languages is None else languages)))
    return in_batches(some.select("path", taint_language(F.col("deep_language")).alias("language"), "content", "deep_language"), run, SCHEMA)


def python_facts(files: DataFrame) -> DataFrame:
    """The facts of the files whose deep language is python."""
    return syntax_facts(files, ["python"])


def symbols(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'function'").select("path", "name", F.lit("function").alias("kind"), F.col("line").alias("line_start"), F.col("line_end"), "params")


def call_edges(facts: DataFrame) -> DataFrame:
    """Calls inside functions; the same call twice is two edges."""
    return facts.where("fact = 'call' and caller is not null").select("path", "caller", F.col("name").alias("callee"), "line")


def imports(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'import'").select("path", "name")


def errors(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'error'").select("path", F.col("name").alias("message"))
