"""Syntax facts of languages with braces, from tokens and their brackets.

A text becomes tokens by one expression made of its language's tables; brackets are matched once, and where each expression ends is
known from the end of the text backwards. One pass then finds functions, calls, assignments, names and imports, each token looked at
once, so the work grows with the text. Brackets that don't match are passed over; only too many of them inside one another are an error.

What is entered follows the syntax facts of Python: of a chain of calls the last is the call, named by what stands before the chain's first bracket,
and only its arguments are entered; a property is no name; the names and calls inside a call's arguments or an assignment's value are its.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from corpusloom.functions.grammars import AFTER_COMMAND, GRAMMARS, OPENS_BLOCK, OPENS_BLOCK_FIRST, SHELL_IMPORTS, SHELL_WORDS

OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
NAME, NUMBER, STRING, MARK = range(4)
#: Words between a function's brackets and its block, and words that an operand may begin with though they are no names.
QUALIFIERS = {"throws", "const", "noexcept", "override", "final", "where", "volatile", "requires"}
SELVES = {"this", "self", "super", "base", "crate"}
#: Brackets inside one another; names stand in all calls around them, so what deeper ones would give has no bound.
DEEPEST = 200
#: Characters of an import that are kept.
SHOWN = 80


@lru_cache(None)
def _lexer(language: str) -> re.Pattern:
    """Alternatives in order: space, comment, template mark, string, pattern, name, number, mark."""
    g = GRAMMARS[language]
    comments = [re.escape(c) + r"[^\n]*" for c in g.line_comments] + [rf"{re.escape(a)}(?s:.*?)(?:{re.escape(z)}|\Z)" for a, z in g.block_comments]
    strings = [rf"{q}(?:[^{q}\\\n]|\\(?s:.))*+(?:{q}|(?=\n)|\Z)" for q in g.quotes] + [rf"{q}[^{q}]*+(?:{q}|\Z)" for q in g.raw_quotes]
    if language == "rust":  # a quote is a character or a lifetime
        strings.append(r"'(?:\\[^'\n]*|[^'\\\n])'")
    name = rf"(?:[^\W\d]|[{re.escape(g.name_marks)}])[\w{re.escape(g.name_marks.replace('#', '').replace('@', ''))}]*+"
    marks = r"===|!==|\*\*=|<<=|>>=|>>>|\?\.|\?->|=>|->|::|:=|[-+*/%&|^]=|[=!<>]=|&&|\|\||\?\?|\+\+|--|\.\.\.|[^\s\w]"
    parts = [("space", r"\s+"), ("comment", "|".join(comments)), ("template", re.escape(g.template) or "(?!)"), ("string", "|".join(strings)), ("name", name), ("number", r"\d[\w.]*+"), ("mark", marks)]
    return re.compile("|".join(f"(?P<{n}>{p})" for n, p in parts))


_PATTERN = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_TEXT = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))++")


class Tokens:
    """kind, text, start and line of each token; close of each opening bracket; which names are entered."""

    def __init__(self, text: str, language: str):
        self.g, self.source = GRAMMARS[language], text
        self.kind: list[int] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.line: list[int] = []
        self.breaks: list[bool] = []  # a new line stands before it
        self._read(text, _lexer(language))
        self._match()
        self._ends()
        self._bodies()

    def _add(self, kind: int, text: str, start: int) -> None:
        last = self.start[-1] if self.start else 0
        line = (self.line[-1] if self.line else 1) + self.source.count("\n", last, start)
        self.breaks.append(bool(self.line) and line > self.line[-1] + self.text[-1].count("\n"))
        self.kind.append(kind)
        self.text.append(text)
        self.start.append(start)
        self.line.append(line)

    def _read(self, text: str, lexer: re.Pattern) -> None:
        at, depth, templates = 0, 0, []  # templates: the depths of braces at which one goes on
        until = len(text)
        if self.g.inside and self.g.inside[0] in text:
            at = text.index(self.g.inside[0])
        while at < until:
            if self.g.inside and text.startswith(self.g.inside[1], at):
                at = text.find(self.g.inside[0], at)
                if at < 0:
                    break
            if self.g.inside and text.startswith(self.g.inside[0], at):
                at = re.compile(r"<\?(?:php|=)?").match(text, at).end()
                continue
            m = lexer.match(text, at)
            if m is None:  # an unended quote's rest, or a control character
                at += 1
                continue
            kind, word = m.lastgroup, m[0]
            if kind == "mark" and word == "/" and self.g.patterns and self._operand_wanted() and (p := _PATTERN.match(text, at)):
                kind, word, m = "string", p[0], p
            end = m.end()
            if kind == "template":
                end, inside = self._template(text, at, end)
                if inside:
                    templates.append(depth)
            elif kind == "mark" and word == "{":
                depth += 1
                self._add(MARK, word, at)
            elif kind == "mark" and word == "}" and templates and templates[-1] == depth:
                self._add(MARK, ")", at)  # the code of a template is an argument of it
                end, inside = self._template(text, at, end)
                if not inside:
                    templates.pop()
            elif kind == "mark":
                depth -= word == "}"
                self._add(MARK, word, at)
            elif kind in ("string", "name", "number"):
                self._add({"string": STRING, "name": NAME, "number": NUMBER}[kind], word, at)
            at = end

    def _template(self, text: str, at: int, end: int) -> tuple[int, bool]:
        """Reads a template on from end; True if code follows."""
        m = _TEXT.match(text, end)
        end = m.end() if m else end
        inside = text.startswith("${", end)
        self._add(STRING, text[at : end if inside else end + 1], at)
        if inside:
            self._add(MARK, "(", end)
        return end + 1 + inside, inside

    def _operand_wanted(self) -> bool:
        if not self.text:
            return True
        return self.kind[-1] == MARK and self.text[-1] not in (")", "]", "}") or self.text[-1] in ("return", "typeof", "case", "in", "of")

    def _match(self) -> None:
        self.close = [-1] * len(self.text)
        open_: list[int] = []
        for i, t in enumerate(self.text):
            if self.kind[i] != MARK:
                continue
            if t in OPENS:
                open_.append(i)
                if len(open_) > DEEPEST:
                    raise ValueError("too many nested brackets")
            elif t in CLOSES and any(self.text[j] == CLOSES[t] for j in open_[-3:]):
                while self.text[open_[-1]] != CLOSES[t]:
                    self.close[open_.pop()] = i
                self.close[open_.pop()] = i
        for j in open_:
            self.close[j] = len(self.text)

    def over(self, i: int) -> int:
        """The token after this one, or after its brackets."""
        return self.close[i] + 1 if self.kind[i] == MARK and self.close[i] > i else i + 1

    def mark(self, i: int, *texts: str) -> bool:
        return i < len(self.text) and self.text[i] in texts and self.kind[i] == MARK

    def word(self, i: int) -> bool:
        return i < len(self.text) and self.kind[i] == NAME and self.text[i] not in self.g.words

    def _stops(self, i: int) -> bool:
        if self.kind[i] == MARK and self.text[i] in (";", ",", ")", "]", "}"):
            return True
        if self.kind[i] == NAME and self.text[i] in self.g.ends:
            return True
        if not self.g.lines or not self.breaks[i] or i == 0:
            return False
        before = self.kind[i - 1] != MARK or self.text[i - 1] in (")", "]", "}", "++", "--")
        return before and not (self.kind[i] == MARK and self.text[i] in self.g.continues)

    def _ends(self) -> None:
        n = len(self.text)
        self._end = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            self._end[i] = i if self._stops(i) else self._end[min(self.over(i), n)]

    def _bodies(self) -> None:
        """From each token on, the brace of the body that a declaration's head may end in, or -1."""
        n, g = len(self.text), self.g
        self._body = [-1] * (n + 1)
        for i in range(n - 1, -1, -1):
            if self.mark(i, "{") and not (i and g.functions and self.text[i - 1] in ("interface", "struct", ":", "<", "|")):
                self._body[i] = i
            elif not self.mark(i, ";", "=", ")", "]", "}"):
                self._body[i] = self._body[min(self.over(i), n)]

    def body(self, i: int) -> int:
        return self._body[min(i, len(self.text))]

    def end(self, i: int) -> int:
        """Where the expression that begins at a token ends."""
        return self._end[min(self.over(i), len(self.text))] if i < len(self.text) else i

    def slice(self, a: int, z: int) -> str:
        return self.source[self.start[a] : self.start[z - 1] + len(self.text[z - 1])] if a < z else ""


class Reader:
    """Finds what a file declares, calls and assigns."""

    def __init__(self, text: str, language: str):
        self.t, self.g = Tokens(text, language), GRAMMARS[language]
        self.functions: list[tuple[int, str, list[str], int]] = []  # token, name, parameters, last token
        self.names: list[int] = []
        self.calls: list[tuple[int, str, str | None, int, int]] = []  # token, name, caller, arguments from, to
        self.assigned: list[tuple[int, str, int, int]] = []  # token, name, value from, to
        self.imports: list[tuple[int, str]] = []
        self._walk()

    def _statement(self, i: int) -> bool:
        return i == 0 or self.t.mark(i - 1, ";", "{", "}") or self.t.breaks[i]

    def _parameters(self, i: int) -> list[str]:
        """Of each entry in brackets its name: the last word where types stand before names, else the first, or the one with a $."""
        t, g, out, j, z = self.t, self.g, [], i + 1, self.t.close[i]
        while j < z:
            found, depth, typed = [], 0, g.plain_functions and not g.arrows
            value = False
            while j < z and not (depth <= 0 and t.mark(j, ",")):
                depth += t.mark(j, "<") - t.mark(j, ">") - 2 * t.mark(j, ">>")
                typed, value = typed and not t.mark(j, ":"), value or t.mark(j, "=")
                if depth <= 0 and not value and t.word(j):
                    found.append(t.text[j])
                j = t.over(j)
            found = [w for w in found if w[0] == "$"] or found if "$" in g.name_marks and not g.arrows else found
            out += [found[-1 if typed else 0]] if found else []
            j += 1
        return out

    def _generic(self, i: int) -> int:
        """The token after a list in <> that begins here, if there is one."""
        t, depth, j = self.t, 0, i
        if not t.mark(i, "<"):
            return i
        while j < len(t.text) and j < i + 40:
            depth += t.mark(j, "<") - t.mark(j, ">") - 2 * t.mark(j, ">>") - 3 * t.mark(j, ">>>")
            if depth <= 0:
                return j + 1
            if t.mark(j, ";", "{", ")"):
                return i
            j = t.over(j)
        return i

    def _declared(self, i: int) -> tuple[str, int, int, int] | None:
        """A function that begins at a token: its name, the bracket of its parameters (or -1), its body from, to."""
        t, g = self.t, self.g
        if t.kind[i] == NAME and t.text[i] in g.functions:
            j = i + 1
            while t.mark(j, "*", "&"):
                j += 1
            if g.lists and t.mark(j, "(") and t.word(t.over(j)):
                j = t.over(j)
            name = t.text[j] if j < len(t.text) and t.kind[j] == NAME else None
            p = self._generic(j + 1 if name else j)
            if not t.mark(p, "(") or name is None and not g.arrows:
                return None
            after = t.over(p)
            body = t.body(after)
            if body < 0:
                end = t.end(after) if t.mark(after, "=") else after  # an expression, or a declaration alone
                return name or "anonymous", p, after, end
            return name or "anonymous", p, body, t.over(body)
        if g.arrows and t.mark(i, "=>"):
            body = i + 1
            return "anonymous", -1, body, t.over(body) if t.mark(body, "{") else t.end(body)
        if g.plain_functions and t.word(i) and not (i and (t.text[i - 1] in g.links or t.text[i - 1] in ("new", "return", "=", "=>", "else", "throw", "await", "."))):
            j = i
            while t.text[j : j + 2][1:] == ["::"] and j + 2 < len(t.text):
                j += 2
            p = self._generic(j + 1 + (g.arrows and t.mark(j + 1, "?")))
            if not t.mark(p, "("):
                return None
            after = t.over(p)
            if g.arrows:  # methods: a block follows, or a type and a block
                if not (i == 0 or t.mark(i - 1, "{", "}", ";", ",", "*") or t.breaks[i] or t.kind[i - 1] == NAME):
                    return None
                body = after if t.mark(after, "{") and not t.breaks[after] else t.body(after) if t.mark(after, ":") else -1
                # an arrow or an entry with a condition is no method
                return (t.text[i], p, body, t.over(body)) if body > 0 and not any(t.mark(k, "?", "=>") for k in range(after, body)) else None
            typed = i and (t.kind[i - 1] == NAME and t.text[i - 1] not in (g.words - {"void", "public", "private", "protected", "static", "final", "const", "internal", "virtual", "async"}) or t.mark(i - 1, ">", "]", "*", "&", "{", "}", ";", "~", ")"))
            if not typed and i:
                return None
            body = t.body(after) if t.mark(after, "{", ":", "->") or after < len(t.text) and t.text[after] in QUALIFIERS else -1
            return (t.slice(i, j + 1), p, body, t.over(body)) if body > 0 else None
        return None

    def _chain(self, i: int) -> tuple[int, int, int]:
        """An operand that begins at a name: the bracket of its last call (or -1), the end of the name before its first, and the token after it."""
        t, j, first, last = self.t, i + 1, -1, -1
        while j < len(t.text):
            if t.mark(j, *self.g.links) and j + 1 < len(t.text):
                j += 1
                if t.kind[j] == NAME:
                    j += 1
                elif not t.mark(j, "(", "[", "<"):
                    break
            elif t.mark(j, "(") and not (self.g.lines and t.breaks[j]):
                first, last, j = first if first >= 0 else j, j, t.over(j)
            elif t.mark(j, "[") and not (self.g.lines and t.breaks[j]):
                j = t.over(j)
            elif t.mark(j, "<") and (k := self._generic(j)) > j and t.mark(k, "("):
                first, j = first if first >= 0 else j, k
            else:
                break
        return last, first, j

    def _command(self, i: int, after: int) -> int:
        """Where the arguments end that follow an operand without brackets; -1 if there are none."""
        return -1

    def _value(self, i: int) -> int:
        """The token of an assignment's value, if an operand that ends before a token is assigned to; else -1."""
        t = self.t
        if t.mark(i, *self.g.assigns):
            return i + 1
        if t.mark(i, ":") and self.g.declares:  # a type stands between
            j = i + 1
            while j < len(t.text) and j < i + 60 and not t.mark(j, *self.g.assigns, ";", ",", ")", "]", "}", "{", "=>"):
                j = t.over(j)
            if t.mark(j, "="):
                return j + 1
        return -1

    def _walk(self) -> None:
        t, g = self.t, self.g
        i, n = 0, len(t.text)
        around: list[tuple[int, str | None]] = [(n + 1, None)]  # the bodies that a token stands in
        declared = -1
        while i < n:
            while i >= around[-1][0]:
                around.pop()
            if t.kind[i] == NAME and t.text[i] in g.imports and self._statement(i) and not (g.arrows and t.mark(i + 1, "(", ".")):
                z = i + 1
                while z < n and not t.mark(z, ";") and not ((g.lines or t.text[i][0] == "#") and t.breaks[z]):
                    z = t.over(z)
                self.imports.append((i, " ".join(t.slice(i, z).split())[:SHOWN]))
                i = z
                continue
            if t.kind[i] == NAME and t.text[i][0] == "#":  # the preprocessor's
                i += 1
                while i < n and not t.breaks[i]:
                    i += 1
                continue
            if t.kind[i] == NAME and t.text[i] in g.declares:
                declared = i
            if found := self._declared(i):
                name, p, body, end = found
                self.functions.append((i, name, self._parameters(p) if p > 0 else [], min(end, n) - 1))
                around.append((end, name))
                i = body
                if t.mark(i, "{", "="):
                    i += 1
                continue
            if t.kind[i] != NAME or t.text[i] in g.words and t.text[i] not in SELVES or i and t.text[i - 1] in g.links:
                i += 1
                continue
            if self.g.ends and i and t.mark(i - 1, ":") and t.start[i - 1] + 1 == t.start[i]:  # a symbol
                i += 1
                continue
            if t.mark(i + 1, ":") and i and t.mark(i - 1, "{", ",") and (g.arrows or not g.declares):  # a key
                i += 1
                continue
            last, first, after = self._chain(i)
            value = self._value(after) if last < 0 or t.over(last) < after else -1
            typed = t.mark(after, ":")
            if value >= 0 and (not typed or declared >= 0 and i - declared <= 2):
                z = t.end(value)
                targets = [i]
                if g.lists:
                    j = i
                    while j >= 2 and t.mark(j - 1, ",") and t.kind[j - 2] == NAME and not t.mark(j - 3, *g.links):
                        j -= 2
                        targets.append(j)
                for k in sorted(targets):
                    self.assigned.append((k, t.slice(k, after if k == i else k + 1), value, z))
                if last < 0:
                    i = value if after == i + 1 else i + 1
                    continue
            typed = g.plain_functions and not g.arrows and i and t.kind[i - 1] == NAME and not t.breaks[i]
            if last >= 0 and typed and t.text[i - 1] not in g.words:  # a type before it: a declaration
                i += 1
                continue
            if last >= 0 and t.text[i - 1 if i else 0] != "new":
                self.calls.append((i, t.slice(i, first).split("(")[0].strip(), around[-1][1], last + 1, t.close[last]))
                i = last + 1
                continue
            if (z := self._command(i, after)) >= 0:
                self.calls.append((i, t.slice(i, after), around[-1][1], after, z))
                i = after
                continue
            if t.text[i] not in SELVES:
                self.names.append(i)
            i += 1

    def facts(self) -> Iterator[dict]:
        t = self.t
        order = [c[0] for c in self.calls]
        within = lambda where, a, z: range(bisect_left(where, a), bisect_left(where, z))
        last_line = lambda i: t.line[i] + t.text[i].count("\n")
        for at, name, params, end in self.functions:
            yield {"fact": "function", "seq": at, "name": name, "line": t.line[at], "line_end": last_line(end), "params": params}
        for at, name, caller, a, z in self.calls:
            yield {"fact": "call", "seq": at, "name": name, "caller": caller, "line": t.line[at]}
            yield from ({"fact": "call_ref", "seq": at, "ord": n, "name": t.text[self.names[k]]} for n, k in enumerate(within(self.names, a, z)))
            yield from ({"fact": "call_inner", "seq": at, "ord": n, "name": self.calls[k][1]} for n, k in enumerate(within(order, a, z)))
        for at, name, a, z in self.assigned:
            if a >= len(t.text):
                continue
            first = next((self.calls[k] for k in within(order, a, z)), None)
            # the value is a call, a string, or an expression whose text counts
            plain = first is not None and first[0] == a and first[4] + 1 >= min(z, len(t.text)) or z == a + 1 and t.kind[a] == STRING
            yield {"fact": "assign", "seq": at, "name": name, "line": t.line[a], "value_call": first and first[1], "value_line": first and t.line[first[0]], "chain": None if plain else t.slice(a, z)}
            yield from ({"fact": "assign_ref", "seq": at, "ord": n, "name": t.text[self.names[k]]} for n, k in enumerate(within(self.names, a, z)))
        yield from ({"fact": "import", "seq": at, "ord": 0, "name": name} for at, name in self.imports)


class RubyReader(Reader):
    """Blocks that words open and close, and commands without brackets."""

    def _walk(self) -> None:
        t = self.t
        self.block_end: dict[int, int] = {}
        open_: list[int] = []
        for i, word in enumerate(t.text):
            if t.kind[i] != NAME or i and t.text[i - 1] in self.g.links:
                continue
            if word in OPENS_BLOCK and not (word == "do" and open_ and t.text[open_[-1]] in ("while", "until", "for") and t.line[open_[-1]] == t.line[i]):
                open_.append(i)
            elif word in OPENS_BLOCK_FIRST and (self._statement(i) or t.text[i - 1] in ("=", "then", "else", "do")):
                open_.append(i)
            elif word == "end" and open_:
                self.block_end[open_.pop()] = i + 1
        self.block_end.update(dict.fromkeys(open_, len(t.text)))
        n = len(t.text)
        self.command_end = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            stops = t.breaks[i] and not t.mark(i - 1, ",") or t.mark(i, ";", ")", "]", "}") or t.kind[i] == NAME and t.text[i] in AFTER_COMMAND
            self.command_end[i] = i if stops else self.command_end[min(t.over(i), n)]
        self.busy = 0
        super()._walk()

    def _declared(self, i: int):
        t = self.t
        if t.text[i] != "def" or t.kind[i] != NAME:
            return None
        j = i + 1
        while t.mark(j + 1, ".") and j + 2 < len(t.text):
            j += 2
        name = t.text[j] if j < len(t.text) else ""
        j += 1
        if t.mark(j, "?", "!") and t.start[j] == t.start[j - 1] + len(name):
            name, j = name + t.text[j], j + 1
        p = j if t.mark(j, "(") else -1
        return name, p, t.over(j) if p >= 0 else j, self.block_end.get(i, len(t.text))

    def _parameters(self, i: int) -> list[str]:
        t, z = self.t, self.t.close[i]
        return [t.text[j] for j in range(i + 1, z) if t.word(j) and not t.mark(j - 1, "=", ":", ".")]

    def _command(self, i: int, after: int) -> int:
        t = self.t
        if i < self.busy or after >= len(t.text) or t.breaks[after] or t.kind[after] == MARK or t.text[after] in self.g.words or t.text[i] in SELVES:
            return -1
        self.busy = self.command_end[after]  # an argument is no command
        return self.busy


_SHELL = re.compile(
    r"""(?P<space>[ \t\r]+|\\\n)|(?P<comment>(?<![^\s;&|()])\#[^\n]*)|(?P<end>\$\(|[;&|(){}`\n]|[<>]+&?)"""
    r"""|(?P<word>(?:'[^']*(?:'|\Z)|"(?:\\(?s:.)|[^"\\])*+(?:"|\Z)|\\(?s:.)|\$\{[^}]*(?:\}|\Z)|\$(?!\()|[^\s;&|(){}<>`"'$\\])+)"""
)
_SET, _READ = re.compile(r"([A-Za-z_]\w*)\+?="), re.compile(r"\$\{?(\w+)")


def shell_facts(content: str) -> Iterator[dict]:
    """A statement's first word is the command, unless it assigns; names are read with $; a body ends with its brace."""
    words = [(m.lastgroup, m[0], m.start()) for m in _SHELL.finditer(content) if m.lastgroup not in ("space", "comment")]
    line, last = 1, 0
    bodies: list[tuple[str, int, int] | None] = []  # of each open brace the function that it belongs to: name, token, line
    command, named, assigned, substituted = None, None, None, None
    for n, (kind, text, start) in enumerate(words):
        line, last = line + content.count("\n", last, start), start
        around = next((b[0] for b in reversed(bodies) if b), None)
        reads = [] if text[0] == "'" else _READ.findall(text)
        if kind == "end":
            if text == "{":
                bodies.append(named)
                named = None
            elif text == "}" and bodies:
                if done := bodies.pop():
                    yield {"fact": "function", "seq": done[1], "name": done[0], "line": done[2], "line_end": line, "params": []}
            elif text == "(" and command and words[n + 1 : n + 2] and words[n + 1][1] == ")":
                named = (command[1], command[0], line)
            substituted = assigned if text == "$(" else None if text == "\n" else substituted
            command = None
            continue
        if command is None and named is None and (m := _SET.match(text)):
            value = text[m.end() :]
            until = words[n + 1] if n + 1 < len(words) else ("", "", 0)
            inner = words[n + 2][1] if until[1] == "$(" and until[2] == start + len(text) and n + 2 < len(words) else None
            assigned = (n, iter(range(1 << 30)))
            chain = value.strip("\"'") or (f"$({inner} " if inner else "")
            yield {"fact": "assign", "seq": n, "name": m[1], "line": line, "value_call": inner, "value_line": line if inner else None, "chain": chain}
            yield from ({"fact": "assign_ref", "seq": n, "ord": next(assigned[1]), "name": r} for r in reads)
        elif command is None:
            if text in SHELL_WORDS:
                if text == "function" and n + 1 < len(words):
                    named = (words[n + 1][1], n + 1, line)
                continue
            command = (n, text, iter(range(1 << 30)))
            if named and named[1] == n:
                continue
            if text in SHELL_IMPORTS and n + 1 < len(words):
                yield {"fact": "import", "seq": n, "ord": 0, "name": f"{text} {words[n + 1][1]}"[:SHOWN]}
            elif words[n + 1 : n + 2] and words[n + 1][1] == "(" and words[n + 2 : n + 3] and words[n + 2][1] == ")":
                continue
            yield {"fact": "call", "seq": n, "name": text, "caller": around, "line": line}
        else:
            yield from ({"fact": "call_ref", "seq": command[0], "ord": next(command[2]), "name": r} for r in reads)
            if substituted:
                yield from ({"fact": "assign_ref", "seq": substituted[0], "ord": next(substituted[1]), "name": r} for r in reads)
    for done in filter(None, bodies):
        yield {"fact": "function", "seq": done[1], "name": done[0], "line": done[2], "line_end": line, "params": []}


def bracket_facts(content: str, language: str) -> Iterator[dict]:
    return (RubyReader if language == "ruby" else Reader)(content, language).facts()
