"""Balanced parentheses of an ordered tree, with excess blocks for findclose.

A node is an opening and a closing parenthesis around its children. The excess at a place is the number of nodes
open after it. Blocks of BLOCK places keep their least excess, and a tree of minima over the blocks finds the first
block in which an excess is reached. All queries are arrays.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """bits: 1 opens, 0 closes; balanced, and any number of trees in a row."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.astype(bool)
        n = len(bits)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        #: Opens up to and including each place.
        self.ranks = np.cumsum(self.bits)
        #: Leaf pairs (an open and the close right after it) that begin up to and including each place.
        self.leaves = np.cumsum(np.append(self.bits[:-1] & ~self.bits[1:], np.zeros(min(n, 1), bool)))
        blocks = -(-n // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        #: Minima of 1, 2, 4, ... blocks, leaves first.
        self.minima = [padded.reshape(blocks, BLOCK).min(axis=1) if blocks else np.zeros(0, np.int64)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.minima.append(np.minimum(low[::2], low[1::2]))

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def _scan(self, places: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The first place from ``places`` on, in the same block, whose excess is at most the target; -1 if none."""
        found = np.full(len(places), -1)
        left = np.flatnonzero(places < len(self.bits))
        places = places.copy()
        ends = np.minimum((places // BLOCK + 1) * BLOCK, len(self.bits))
        while len(left):
            hit = self.excess[places[left]] <= targets[left]
            found[left[hit]] = places[left[hit]]
            left = left[~hit]
            places[left] += 1
            left = left[places[left] < ends[left]]
        return found

    def _first_block(self, blocks: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The first block from ``blocks`` on whose least excess is at most the target; there must be one."""
        level, node = np.zeros(len(blocks), np.int64), blocks.copy()
        # Up until a node holds the target: a right neighbour, or a parent's right neighbour, and so on.
        open_ = np.arange(len(blocks))
        while len(open_):
            for k in np.unique(level[open_]).tolist():
                own = open_[level[open_] == k]
                inside = own[node[own] < len(self.minima[k])]
                miss = inside[self.minima[k][node[inside]] > targets[inside]]
                miss = np.concatenate([miss, own[node[own] >= len(self.minima[k])]])
                # The next node to the right; a left child may as well look at its parent from now on.
                node[miss] += 1
                up = miss[(node[miss] % 2 == 0) & (k + 1 < len(self.minima))]
                node[up] //= 2
                level[up] += 1
                open_ = np.setdiff1d(open_, np.setdiff1d(own, miss), assume_unique=True)
        while True:
            low = np.flatnonzero(level > 0)
            if not len(low):
                return node
            for k in np.unique(level[low]).tolist():
                own = low[level[low] == k]
                left = node[own] * 2
                node[own] = np.where(self.minima[k - 1][left] <= targets[own], left, left + 1)
                level[own] -= 1

    def findclose(self, places: np.ndarray) -> np.ndarray:
        """The closing place of each opening place."""
        targets = self.excess[places] - 1
        found = self._scan(places + 1, targets)
        # Where the block holds no answer, the block after it is the first to look at.
        far = np.flatnonzero(found < 0)
        if len(far):
            blocks = self._first_block((places[far] + 1) // BLOCK + ((places[far] + 1) % BLOCK > 0), targets[far])
            found[far] = self._scan(blocks * BLOCK, targets[far])
        return found


def least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair of places, from minima of 1, 2, 4, ... values."""
    out = np.empty(len(first), values.dtype)
    size = last - first + 1
    width, table = 1, values
    while len(out):
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        out[own] = np.minimum(table[first[own]], table[last[own] - width + 1])
        if 2 * width > len(values):
            return out
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out
