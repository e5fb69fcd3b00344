"""Strongly connected components and shortest cycles of one file's call graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

Graph = Mapping[str, Sequence[str]]


def components(graph: Graph) -> list[list[str]]:
    """Names that call one another, by whatever way, together; those on no cycle are left out."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    on: list[str] = []
    inside: set[str] = set()
    found = []
    for root in graph:
        if root in number:
            continue
        work = [(root, iter(graph[root]))]
        number[root] = low[root] = len(number)
        on.append(root)
        inside.add(root)
        while work:
            name, callees = work[-1]
            for c in callees:
                if c not in number:
                    number[c] = low[c] = len(number)
                    on.append(c)
                    inside.add(c)
                    work.append((c, iter(graph.get(c, ()))))
                    break
                if c in inside:
                    low[name] = min(low[name], number[c])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[name])
                if low[name] == number[name]:
                    part = [on.pop()]
                    while part[-1] != name:
                        part.append(on.pop())
                    inside.difference_update(part)
                    if len(part) > 1 or name in graph.get(name, ()):
                        found.append(part)
    return found


def shortest_cycles(graph: Graph, part: Sequence[str], least: int) -> Iterator[tuple[str, ...]]:
    """Of each call inside a component the shortest cycle that it is part of, the first in order of names; those of at least so many calls, from their least name, each once."""
    inside = set(part)
    calls = {x: sorted(c for c in graph[x] if c in inside) for x in part}
    callers: dict[str, list[str]] = {}
    for x, some in calls.items():
        for c in some:
            callers.setdefault(c, []).append(x)
    seen = set()
    for start in part:
        before: dict[str, str | None] = {start: None}
        queue, wanted = deque([start]), set(callers[start])
        while queue and wanted:
            x = queue.popleft()
            wanted.discard(x)
            for c in calls[x]:
                if c not in before:
                    before[c] = x
                    queue.append(c)
        for caller in callers[start]:
            way = []
            at: str | None = caller
            while at is not None:
                way.append(at)
                at = before[at]
            way.reverse()  # from start to caller, which calls start
            if len(way) >= least:
                k = way.index(min(way))
                cycle = (*way[k:], *way[: k + 1])
                if cycle not in seen:
                    seen.add(cycle)
                    yield cycle
