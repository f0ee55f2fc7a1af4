"""Byte-pair merging of many short words at once, one numpy round per merge."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class MergeTable:
    """Merges ``(left id, right id) -> id`` in order of rank.

    Pairs are looked up in an open-addressed table of numpy arrays.  Ids stay
    below 65,536.
    """

    def __init__(self, pairs: list[tuple[int, int]], products: list[int], bits: int = 19):
        self.bits = np.uint64(64 - bits)
        keys = np.asarray([a << 16 | b for a, b in pairs], dtype=np.uint64)
        self.product = np.asarray(products, dtype=np.int32)
        self.keys = np.full(1 << bits, 2**63, dtype=np.uint64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        self.probes, left = 0, np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at[left]] == 2**63
            slots, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[slots], self.ranks[slots] = keys[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        for _ in range(self.probes - 1):
            at = (at + 1) & (len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.ranks[at], out)
        return out

    def merge(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge the rows of a (words, symbols) matrix: [(row numbers, their final ids)].

        Each round merges the leftmost pair of lowest rank of every row.
        """
        out, rows = [], np.arange(len(symbols))
        rank = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            n = symbols.shape[1]
            if n == 1:
                out.append((rows, symbols))
                break
            j = rank.argmin(1)
            best = rank[np.arange(len(rows)), j]
            done = best == NONE
            if done.any():
                out.append((rows[done], symbols[done]))
                keep = ~done
                rows, symbols, rank, j, best = rows[keep], symbols[keep], rank[keep], j[keep], best[keep]
                if not len(rows):
                    break
            every, merged = np.arange(len(rows)), self.product[best]
            cols = np.arange(n - 1)
            symbols = np.take_along_axis(symbols, cols + (cols > j[:, None]), 1)
            symbols[every, j] = merged
            cols = np.arange(n - 2)
            rank = np.take_along_axis(rank, cols + (cols >= j[:, None]), 1)
            at = np.flatnonzero(j > 0)
            rank[at, j[at] - 1] = self.rank(symbols[at, j[at] - 1], merged[at])
            at = np.flatnonzero(j < n - 2)
            rank[at, j[at]] = self.rank(merged[at], symbols[at, j[at] + 1])
        return out
