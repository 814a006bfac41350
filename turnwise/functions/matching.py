"""Matching blocks of two sequences, found with suffix automata.

The longest block that two windows share comes from the automaton of one window, over which the other
is read once; what lies before and after it is matched in the same way. That is linear in the windows
for each block, also where elements repeat without end, and no two windows of a level overlap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence
from typing import NamedTuple


class Block(NamedTuple):
    a: int
    b: int
    size: int


class Automaton:
    """All substrings of a sequence: states by the places where they end, of which the first is kept."""

    def __init__(self, items: Sequence[Hashable]):
        self.step: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for end, x in enumerate(items):
            new = self._state({}, self.length[last] + 1, end)
            at = last
            while at >= 0 and x not in self.step[at]:
                self.step[at][x] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            else:
                to = self.step[at][x]
                if self.length[to] != self.length[at] + 1:
                    shorter = self._state(dict(self.step[to]), self.length[at] + 1, self.first[to])
                    self.link[shorter] = self.link[to]
                    self.link[to] = shorter
                    while at >= 0 and self.step[at].get(x) == to:
                        self.step[at][x] = shorter
                        at = self.link[at]
                    to = shorter
                self.link[new] = to
            last = new

    def _state(self, step: dict, length: int, first: int) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.step) - 1

    def longest(self, items: Sequence[Hashable]) -> Block:
        """The longest block of ``items`` (a) and the sequence (b): of equals the first in ``items``, then in the sequence."""
        state = size = 0
        best = Block(0, 0, 0)
        for end, x in enumerate(items):
            while state and x not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.step[state]:
                state, size = self.step[state][x], size + 1
                if size > best.size:
                    best = Block(end + 1 - size, self.first[state] + 1 - size, size)
        return best


def blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[Block]:
    """Blocks of both in order: the longest one (the first of equals), and those before and after it; neighbours that touch are one."""
    found, windows = [], [(0, len(a), 0, len(b))]
    while windows:
        a1, a2, b1, b2 = windows.pop()
        left, right = a[a1:a2], b[b1:b2]
        if not left or not right or set(left).isdisjoint(right):
            continue
        if left == right:
            found.append(Block(a1, b1, a2 - a1))
            continue
        block = Automaton(right).longest(left)
        at, to = a1 + block.a, b1 + block.b
        found.append(Block(at, to, block.size))
        windows += [(a1, at, b1, to), (at + block.size, a2, to + block.size, b2)]
    out: list[Block] = []
    for block in sorted(found):
        if out and (out[-1].a + out[-1].size, out[-1].b + out[-1].size) == (block.a, block.b):
            out[-1] = out[-1]._replace(size=out[-1].size + block.size)
        else:
            out.append(block)
    return out


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Twice the matched elements over all elements; 1 if both sides are empty."""
    n = len(a) + len(b)
    return 2.0 * sum(x.size for x in blocks(a, b)) / n if n else 1.0


def contained(own: Sequence[Hashable], other: Sequence[Hashable]) -> bool:
    """Each element of ``own`` uses up one of ``other``."""
    return not Counter(own) - Counter(other)
