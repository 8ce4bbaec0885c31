"""Run-length grammars by recompression, and longest common extensions on them.

A sequence of integers is compressed level by level.  A block level replaces every stretch of equal symbols by one symbol; a pair
level deals the symbols in left and right ones and replaces every left symbol that a right one follows, with it, by one symbol.  Equal
stretches get equal symbols (names come from exact pairs, not from hashes), and whether two neighbours are joined depends on
these two alone, so two places with equal continuations are cut alike but for their edges.  An extension query climbs where
both places begin a symbol, jumps over equal symbols, and descends at the first difference: a bounded number of steps per level.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sides(symbols: np.ndarray, level: int) -> np.ndarray:
    """True for the symbols that are left ones on this level (any fixed rule is right; a mixing one halves them)."""
    x = (symbols.astype(np.uint64) + np.uint64(level + 1)) * _ODD
    x ^= x >> np.uint64(29)
    return ((x * _ODD) >> np.uint64(63)).astype(bool)


def _packed(values: np.ndarray) -> array:
    out = array("i")
    out.frombytes(values.astype(np.int32).tobytes())
    return out


class Grammar:
    """The levels of one sequence, which may be of any length; symbols of a level are compared with those of the same level only."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.size = len(sequence)
        symbols = pd.factorize(sequence)[0].astype(np.int64)
        self.symbols = [_packed(symbols)]
        self.parent: list[array] = []  # the symbol of the next level that holds this one
        self.first: list[array] = []  # its first symbol on this level
        self.block: list[bool] = []  # whether the next level is a block level
        level = 0
        while len(symbols) > 1:
            same = symbols[1:] == symbols[:-1]
            blocks = bool(same.any())
            if blocks:
                head = np.concatenate(([True], ~same))
            else:
                left = _sides(symbols, level)
                joined = left[:-1] & ~left[1:]
                level += 1
                if not joined.any():
                    continue
                head = np.concatenate(([True], ~joined))
            begin = np.flatnonzero(head)
            count = np.diff(np.append(begin, len(symbols)))
            one = symbols[begin]
            rest = count if blocks else np.where(count == 2, symbols[np.minimum(begin + 1, len(symbols) - 1)] + 1, 0)
            self.parent.append(_packed(np.cumsum(head) - 1))
            self.first.append(_packed(begin))
            self.block.append(blocks)
            symbols = pd.factorize(one * (int(rest.max()) + 1) + rest)[0].astype(np.int64)
            self.symbols.append(_packed(symbols))

    def _over(self, level: int, a: int, b: int) -> int:
        """How many symbols two places of a level with equal symbols may both be moved on without looking."""
        if level >= len(self.block) or not self.block[level]:
            return 1
        first, parent, size = self.first[level], self.parent[level], len(self.symbols[level])
        ends = [first[p + 1] if p + 1 < len(first) else size for p in (parent[a], parent[b])]
        return min(ends[0] - a, ends[1] - b)

    def extension(self, i: int, j: int) -> int:
        """How many elements from ``i`` on equal those from ``j`` on (i < j)."""
        level, a, b = 0, i, j
        top = len(self.block)
        while True:  # climb
            symbols = self.symbols[level]
            if b >= len(symbols):
                break
            if level < top:
                parent, first = self.parent[level], self.first[level]
                p, q = parent[a], parent[b]
                if first[p] == a and first[q] == b:
                    level, a, b = level + 1, p, q
                    continue
            if symbols[a] != symbols[b]:
                break
            step = self._over(level, a, b)
            a, b = a + step, b + step
        while level:  # descend
            level -= 1
            first, symbols = self.first[level], self.symbols[level]
            size = len(symbols)
            a = first[a] if a < len(first) else size
            b = first[b] if b < len(first) else size
            while b < size and symbols[a] == symbols[b]:
                step = self._over(level, a, b)
                a, b = a + step, b + step
        return b - j
