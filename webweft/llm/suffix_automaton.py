"""Generalised suffix automata of bounded depth.

The automaton's states are the classes of substrings that end at the same positions. They are found from the tree of its
suffix links: a node is a substring of up to some number of symbols, its parent is the substring without its first
symbol, and the nodes of a chain that end equally often are one state. The tree is built a level at a time, by sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class SuffixAutomaton:
    """Of many sequences, laid end to end.

    longest, shortest: lengths of a state's substrings, which are suffixes of one another. count: positions at which
    they end. end: the last symbol's place in one of them. link: the state of the longest suffix that ends elsewhere too; -1 for none.
    """

    def __init__(self, symbols: np.ndarray, depth: np.ndarray):
        """depth: for each place how long a substring that ends there may be; it grows by one at most from a place to the next."""
        self.symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        base = int(self.symbols.max(initial=0)) + 1
        node = np.full(len(symbols), -1, np.int64)  # of the substring of this level that ends here
        parents, counts, ends, levels = [], [], [], []
        at, made = np.flatnonzero(depth >= 1), 0
        level = 1
        while len(at):
            up = node[at]
            _, first, own, n = np.unique((up + 1) * base + self.symbols[at - level + 1], return_index=True, return_inverse=True, return_counts=True)
            parents.append(up[first])
            counts.append(n)
            ends.append(at[first])
            levels.append(np.full(len(n), level))
            node = np.full(len(symbols), -1, np.int64)
            node[at] = own + made
            made += len(n)
            level += 1
            at = at[depth[at] >= level]
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        parent, count, end, length = cat(parents), cat(counts), cat(ends), cat(levels)
        # of a chain of nodes that end equally often the longest stands for the state
        alike = (parent >= 0) & (count == count[parent])
        longest = np.ones(made, bool)
        longest[parent[alike]] = False
        top = np.arange(made)
        for _ in range(level):
            top = np.where(alike[top], parent[top], top)
        state = np.cumsum(longest) - 1
        own = np.flatnonzero(longest)
        self.longest, self.shortest, self.count, self.end = length[own], length[top[own]], count[own], end[own]
        up = parent[top[own]]
        # a substring that is some state's link ends where no longer one does alone: it is the longest of its state
        self.link = np.where(up >= 0, state[up], -1)

    def substrings(self, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the last symbol, length, count) of the distinct substrings, a length at a time."""
        for n in range(least, int(self.longest.max(initial=0)) + 1):
            has = (self.shortest <= n) & (n <= self.longest)
            yield self.end[has], np.full(int(has.sum()), n), self.count[has]
