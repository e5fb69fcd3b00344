"""Words of which every match of a pattern holds one, so that most lines need no regular expression.

Searching for some plain words costs a small part of what trying a hundred patterns at each character does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import any_of, contains_any, search

#: Shorter words are in too many lines to be of use.
LEAST = 2


def _needed(items) -> frozenset[str]:
    """Of parsed items in a row, the words of which one must occur; none if there are no such words."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is re._constants.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is re._constants.SUBPATTERN:
            found.append(_needed(value[3]))
        elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[0] > 0:
            found.append(_needed(value[2]))
        elif op is re._constants.BRANCH:
            branches = [_needed(b) for b in value[1]]
            found.append(frozenset().union(*branches) if all(branches) else frozenset())
    return max(filter(None, found), key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def needed(pattern: str) -> frozenset[str]:
    """Words in lower case; empty if a match may hold none."""
    words = _needed(re._parser.parse(pattern, re.IGNORECASE))
    return words if words and min(map(len, words)) >= LEAST else frozenset()


def folded(text: Column) -> Column:
    """Letters that are one another's case in any direction become the same."""
    return F.lower(F.upper(text))


def may_match(line: Column, patterns: Iterable[str]) -> Column:
    """True on every line that one of the patterns matches (ignoring case), and on few others."""
    patterns = list(dict.fromkeys(patterns))
    words = {p: needed(p) for p in patterns}
    every = set().union(*words.values())
    least = sorted(w for w in every if not any(v != w and v in w for v in every))
    rest = [p for p in patterns if not words[p]]
    out = contains_any(folded(line), least) if least else F.lit(False)
    return out | search(line, any_of(rest), True) if rest else out


#: Any text: what stands for a part of a pattern that has no plainer form.
ANYTHING = "(?s:.*)"
#: RE2 repeats a part no more often than this.
MOST = 1000


def _fold(x: str) -> str:
    up = x.upper()
    return (up if len(up) == 1 else x).lower()[0]


@lru_cache(1)
def _folds() -> dict[str, str]:
    """The characters that are one another's case in any direction, by the folded one; most characters have no other, and none beyond these has."""
    out: dict[str, str] = {}
    for x in map(chr, range(0x20000)):
        if (low := _fold(x)) != x:
            out[low] = out.get(low, low) + x
    return out


def _one_of(characters: Iterable[str], rest: str = "") -> str:
    return "[" + "".join(f"\\x{{{ord(x):x}}}" for x in characters) + rest + "]"


def _letter(c: str) -> str:
    return _one_of({c, *_folds().get(_fold(c), "")})


@lru_cache(1000)
def _class(op, value) -> str:
    """The ASCII characters of a class, and all others."""
    pattern = re._parser.SubPattern(re._parser.parse("", re.IGNORECASE).state, [(op, list(value) if isinstance(value, tuple) else value)])
    one = re._compiler.compile(pattern, re.IGNORECASE)
    return _one_of([c for c in map(chr, range(128)) if one.fullmatch(c)], r"\x{80}-\x{10FFFF}")


def _wider(items) -> str:
    out = ""
    for op, value in items:
        if op is re._constants.LITERAL:
            out += _letter(chr(value))
        elif op in (re._constants.IN, re._constants.NOT_LITERAL):
            out += _class(op, tuple(value) if isinstance(value, list) else value)
        elif op is re._constants.ANY:
            out += "(?s:.)"
        elif op is re._constants.SUBPATTERN:
            out += f"(?:{_wider(value[3])})"
        elif op is re._constants.BRANCH:
            out += f"(?:{'|'.join(map(_wider, value[1]))})"
        elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[0] <= MOST:
            out += f"(?:{_wider(value[2])}){{{value[0]},{value[1] if value[1] <= MOST else ''}}}"
        elif op not in (re._constants.AT, re._constants.ASSERT, re._constants.ASSERT_NOT):
            out += ANYTHING
    return out


def _known(pattern: str) -> str:
    """pattern, or what matches every text if RE2 finds it too large."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return ANYTHING
    return pattern


def wider(patterns: Iterable[str]) -> str:
    """An RE2 pattern that occurs wherever one of the patterns does (ignoring case), and in few other lines: without borders and what may or may not stand around."""
    return _known("|".join(_wider(re._parser.parse(p, re.IGNORECASE)) for p in dict.fromkeys(patterns)))


def widest(patterns: Iterable[str]) -> str:
    """As wider, by plain words where there are some: one automaton that looks at each byte of a text once."""
    patterns = list(dict.fromkeys(patterns))
    words = {p: needed(p) for p in patterns}
    every = set().union(*words.values())
    least = sorted(w for w in every if not any(v != w and v in w for v in every))
    rest = [_wider(re._parser.parse(p, re.IGNORECASE)) for p in patterns if not words[p]]
    return _known("|".join(["".join(map(_letter, w)) for w in least] + rest))
