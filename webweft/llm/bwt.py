"""Burrows-Wheeler transforms of shards, and their merge by refining an interleave (Holt and McMillan 2014).

Symbols are words of STRIDE bytes, one starting at every byte, so a step back in a text goes STRIDE bytes. A shard's
transform comes of its own suffix order, by prefix doubling. A merge never sorts suffixes: it keeps an interleave, which
says from which shard the next suffix comes, begins with one shard after another, and in each round deals it out by the
symbols that the transforms have there. After a round for each of `depth` symbols, suffixes stand as their first `depth`
symbols have them. Where two neighbours are first dealt apart, they share as many symbols as there were rounds before;
blocks that are never dealt apart are the repeated intervals. A block of one shard alone needs no more rounds: that
shard's transform knows its order and its common prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a symbol.
STRIDE = 4
#: Most bytes of a shard: its ranks are 16 bits, which sort by radix.
SHARD = 65_535


@dataclass(frozen=True)
class Transform:
    order: np.ndarray  # places of the shard by their suffixes
    rank: np.ndarray  # of each place, where it stands in that order
    first: np.ndarray  # the first symbol of each suffix, in that order
    before: np.ndarray  # the transform: the symbol before each suffix; 0 where the shard begins
    back: np.ndarray  # where the suffix that starts with that symbol stands
    group: np.ndarray  # a number for each suffix, the same for neighbours whose first `depth` symbols are common


def symbols(data: np.ndarray) -> np.ndarray:
    """The symbol that starts at each byte, by value; bytes behind the end are 0."""
    padded = np.concatenate([data, np.zeros(STRIDE - 1, np.uint8)]).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for i in range(STRIDE):
        out |= padded[i : i + len(data)] << np.uint32(8 * (STRIDE - 1 - i))
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint32(16)).astype(np.uint16), x.astype(np.uint16)


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A stable order by two 16-bit keys, by radix."""
    k = np.argsort(low, kind="stable")
    return k[np.argsort(high[k], kind="stable")]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def transform(sym: np.ndarray, depth: int) -> Transform:
    """The transform of one shard, by its symbols; suffixes count by their first `depth` symbols, then by place."""
    n = len(sym)
    assert n <= SHARD and depth > 1

    def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = _order(high, low)
        number = (np.cumsum(_changes(high[order], low[order])) - 1).astype(np.uint16)
        rank = np.empty(n, np.uint16)
        rank[order] = number
        return rank, order, number

    rank, order, number = ranked(*_halves(sym))
    known = 1
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(n, np.uint16)
        later[: max(0, n - step * STRIDE)] = rank[step * STRIDE :]
        rank, order, number = ranked(rank, later)
        known += step
    at = np.empty(n, np.int32)
    at[order] = np.arange(n, dtype=np.int32)
    there = order >= STRIDE
    earlier = np.where(there, order - STRIDE, 0)
    return Transform(order, at, sym[order], np.where(there, sym[earlier], 0).astype(np.uint32), at[earlier], number)


def merge(shards: list[Transform], ends: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, block): repeated intervals that several shards share, block after block.

    ends: of each shard, the places of the last symbols of the strings of `depth` symbols that are asked for. suffix
    numbers the suffixes that start them, the shards' orders laid end to end. Shards stand in order within a block.
    """
    base = np.cumsum([0, *(len(t.order) for t in shards)])
    first, before = (np.concatenate([getattr(t, c) for t in shards]) for c in ("first", "before"))
    back = np.concatenate([t.back + b for t, b in zip(shards, base)])
    at = np.concatenate([np.sort(t.rank[e]) + b for t, b, e in zip(shards, base, ends)])
    # the interleave: which shard each suffix comes from, at first one shard after another
    shard = np.repeat(np.arange(len(shards), dtype=np.int32), [len(e) for e in ends])
    block = np.zeros(len(at), np.int64)
    for k in range(depth):
        sym = first[at] if k == 0 else before[at]
        at = at if k == 0 else back[at]
        dealt = _order(*_halves(sym))
        at, shard, block = at[dealt], shard[dealt], block[dealt]
        border = np.flatnonzero(_changes(sym[dealt], block))
        length = np.diff(np.append(border, len(at)))
        several = shard[border] != shard[border + length - 1]
        keep = np.repeat(several, length)
        at, shard, block = at[keep], shard[keep], np.repeat(np.arange(several.sum()), length[several])
        if not len(at):
            break
    return at, block


def repeated(data: np.ndarray, sizes: np.ndarray, begin: np.ndarray, depth: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(place, block): of the strings of `depth` symbols that begin at these places of texts laid end to end, those that
    occur again, block after block of equal ones.

    sizes: of the texts, which are never parted; shards are as many texts in a row as fit. No string may lie over two.
    """
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none
    sym = symbols(data)
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):
        start = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, start + shard, side="right"))))
    edges = np.array([ends[c - 1] if c else 0 for c in cuts])
    shards = [transform(sym[a:z], depth) for a, z in zip(edges[:-1], edges[1:])]
    begin = np.sort(begin)
    cut = np.searchsorted(begin, edges)
    asked = [begin[a:z] - e for a, z, e in zip(cut[:-1], cut[1:], edges[:-1])]
    found, block = merge(shards, [a + (depth - 1) * STRIDE for a in asked], depth) if len(shards) > 1 else (none, none)
    order = np.concatenate([t.order + e for t, e in zip(shards, edges[:-1])])
    # what no other shard has is repeated within its own, if at all
    wanted = np.zeros(len(sym), bool)
    wanted[begin] = True
    inside = wanted[order]
    inside[found] = False
    number = np.concatenate([t.group.astype(np.int64) + (i << 16) for i, t in enumerate(shards)])[inside]
    own = order[inside]
    border = _changes(number)
    alone = border & np.append(border[1:], True)[: len(border)]
    own, number = own[~alone], np.cumsum(border)[~alone]
    return np.concatenate([order[found], own]), np.concatenate([block, number + (block[-1] + 1 if len(block) else 0)])
