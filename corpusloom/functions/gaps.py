"""The same patterns in a form whose search takes time that grows with the line.

``a.*b`` is tried at every a, and looks through the rest of the line each time: a line made of many a costs its length squared. Where a b
follows a later a it follows the first one too, so it is enough to find the first a, and then the last b; an atomic group keeps
the search from coming back for another. Likewise, of matches that must not be followed by something only the last one counts.

The rewriting holds for patterns whose heads don't stand inside one another, as all built-in ones; patterns of others stay as they are.
"""

from __future__ import annotations

import re

_PIECE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[:!=]|.", re.DOTALL)
_SHORTER = [(r"\s+", r"\s"), (r"\w+", r"\w"), (r"\s*", "")]


def pieces(pattern: str) -> list[str]:
    """Escapes, classes, opening brackets and characters."""
    return _PIECE.findall(pattern)


def split(pattern: str, mark: str) -> list[str]:
    """At a mark of one or two pieces that stands in no bracket."""
    out, depth, parts = [""], 0, pieces(pattern)
    i = 0
    while i < len(parts):
        depth += parts[i][0] == "("
        depth -= parts[i] == ")"
        if not depth and "".join(parts[i : i + len(mark)]) == mark and parts[i] == mark[0]:
            out.append("")
            i += len(mark)
            continue
        out[-1] += parts[i]
        i += 1
    return out


def _closes(pattern: str) -> int:
    """The piece that closes the bracket that a pattern begins with."""
    depth = 0
    for i, p in enumerate(pieces(pattern)):
        depth += (p[0] == "(") - (p == ")")
        if not depth:
            return i
    return -1


def _shortest(head: str) -> str:
    """A head that ends as soon as it can: what follows takes the rest."""
    for long, short in _SHORTER:
        if head.endswith(long):
            return head[: -len(long)] + short
    return head


def linear(pattern: str) -> str:
    """A pattern of heads, gaps and a tail, or alternatives of such ones, for lines without a line break but at their end."""
    body = pattern[3:-1] if pattern.startswith("(?:") and _closes(pattern) == len(pieces(pattern)) - 1 else pattern
    if len(alternatives := split(body, "|")) > 1:
        return "(?:" + "|".join(map(linear, alternatives)) + ")"
    *heads, tail = split(body, ".*")
    refused = re.fullmatch(r"(.*)(\(\?!\.\*.*\))", tail)
    if not heads and not refused:
        return pattern
    if heads and heads[0].startswith(r"\w+"):
        heads[0] = r"\w" + heads[0][3:]
    first = "".join(f"(?>.*?{_shortest(h)})" for h in heads)
    return rf"\A{first}(?>.*{refused[1]}){refused[2]}" if refused else rf"\A{first}.*{tail}"


def in_run(pattern: str) -> str:
    """HEAD[class]*TAIL or HEAD[class]+TAIL, all characters of the head being of the class: the first head of a run of the class decides."""
    parts = pieces(pattern)
    at = next(i for i, p in enumerate(parts) if p[0] == "[" and len(p) > 4 and parts[i + 1 : i + 2] in (["*"], ["+"]))
    head, kind, rest = "".join(parts[:at]), parts[at], "".join(parts[at + 1 :])
    head = r"\w" + head[3:] if head.startswith(r"\w+") else head
    return f"(?<!{kind})(?>{kind}*?{head}){kind}{rest}"


def in_two_gaps(pattern: str) -> str:
    """HEAD[class]*MIDDLE[class]*TAIL with one class: the first middle, then the last tail."""
    parts = pieces(pattern)
    at = next(i for i, p in enumerate(parts) if p[0] == "[" and parts[i + 1 : i + 2] == ["*"])
    again = next(i for i in range(at + 1, len(parts)) if parts[i] == parts[at])
    return "".join(parts[:at]) + f"(?>{parts[at]}*?{''.join(parts[at + 2 : again])})" + "".join(parts[again:])
