"""How taint spreads through the assignments of one file."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TypeVar

T = TypeVar("T")


def spread(known: dict[str, T], steps: Sequence[tuple[str, Sequence[str]]], rounds: int) -> dict[str, T]:
    """known and, round by round, what assignments (name, the names that they read) add to it.

    A round sees what the rounds before it know. In a round the first assignment of a name counts, and it takes what the first
    known name in it has. Only assignments that read a name of the last round are looked at, so each costs its length once.
    """
    readers: dict[str, list[int]] = {}
    for n, (_, reads) in enumerate(steps):
        for name in set(reads):
            readers.setdefault(name, []).append(n)
    known, latest = dict(known), list(known)
    for _ in range(rounds):
        new: dict[str, T] = {}
        for n in sorted({n for name in latest for n in readers.get(name, ())}):
            name, reads = steps[n]
            if name not in known and name not in new:
                new[name] = next(known[r] for r in reads if r in known)
        if not new:
            break
        known |= new
        latest = list(new)
    return known
