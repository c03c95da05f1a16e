"""Hierarchical multi-length packing of token sequences.

A document's ids are cut into full windows of the longest tier; the rest is routed to the smallest
tier that holds it. Each tier is packed, longest first: a window is opened by one of the tier's
pieces, its gap is filled by the longest pieces of shorter tiers that fit, and what gap is left
by cutting one more. Finished windows are dealt to step groups of even token counts. Each
partition packs its own documents, within a bounded buffer: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from webweft.llm.bpe import default_path, encoder, slices
from webweft.llm.common import keyed_text, lean, read

#: Windows of these lengths are full in themselves.
TIERS = (2048, 1024, 512, 256)
#: Pieces that wait in a task's buffer before their tiers are packed.
WAITING = 4096
#: Tokens of a step group.
STEP_TOKENS = 32_768

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class Packer:
    """One partition's packing. add() documents, take windows from full(), and the rest from tail().

    A window is (length, [(doc, start, length), ...]).
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.wait: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.n = 0

    def _route(self, length: int, doc: int, start: int) -> None:
        tier = min(t for t in self.tiers if t >= length)
        insort(self.wait[tier], (length, doc, start))
        self.n += 1

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list]]:
        """Full windows of the longest tier; the rest waits."""
        top, at = self.tiers[0], 0
        while length - at >= top:
            yield top, [(doc, at, top)]
            at += top
        if at < length:
            self._route(length - at, doc, at)

    def _take(self, gap: int, below: list[int]) -> tuple[int, int, int] | None:
        """The longest waiting piece of the tiers that fits the gap."""
        for t in below:
            row = self.wait[t]
            if row and (k := bisect_right(row, (gap, 1 << 62, 0))):
                self.n -= 1
                return row.pop(k - 1)
        return None

    def full(self) -> Iterator[tuple[int, list]]:
        """Windows packed full from what waits. A tier's pieces wait on where all that is left can't fill a window."""
        for k, tier in enumerate(self.tiers):
            left = sum(x[0] for t in self.tiers[k:] for x in self.wait[t])
            while self.wait[tier] and left >= tier:
                left -= tier
                length, doc, start = self.wait[tier].pop()
                self.n -= 1
                window, gap = [(doc, start, length)], tier - length
                while gap:
                    got = self._take(gap, self.tiers[k + 1 :]) or self._take(gap, [tier])
                    if got is None:  # nothing fits whole: cut one more, shorter tiers first
                        row = next(self.wait[t] for t in [*self.tiers[k + 1 :], tier] if self.wait[t])
                        n, d, s = row.pop(0)
                        self.n -= 1
                        self._route(n - gap, d, s + gap)
                        got = (gap, d, s)
                    window.append((got[1], got[2], got[0]))
                    gap -= got[0]
                yield tier, window

    def tail(self) -> Iterator[tuple[int, list]]:
        """What is left, cut into windows of falling powers of two, so that none has padding."""
        rest = [(d, s, n) for t in self.tiers for n, d, s in self.wait[t]]
        self.wait, self.n = {t: [] for t in self.tiers}, 0
        left = sum(n for _, _, n in rest)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                d, s, n = rest.pop(0)
                if n > gap:
                    rest.insert(0, (d, s + gap, n - gap))
                    n = gap
                window.append((d, s, n))
                gap -= n
            yield size, window
            left -= size


def _pack(path: str, end_id: int, tiers: tuple[int, ...], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        end = int(end_id).to_bytes(4, "little")
        held: dict[int, tuple[int | None, bytes, int, int]] = {}  # of a document that waits: its id, its ids from a place on, that place, all its tokens
        seq = doc = made = 0
        groups: list[tuple[int, int]] = []  # open ones, of steps, as a heap: tokens, number

        def rows(windows: list[tuple[int, list]]) -> pa.RecordBatch:
            nonlocal seq, made
            out: list[tuple] = []
            ids: list[bytes] = []
            # long windows first, each to the emptiest open group; a full group closes
            for size, window in sorted(windows, key=lambda w: -w[0]):
                if groups and groups[0][0] + size <= STEP_TOKENS:
                    tokens, g = heappop(groups)
                else:
                    tokens, g, made = 0, base + made, made + 1
                if tokens + size < STEP_TOKENS:
                    heappush(groups, (tokens + size, g))
                at = 0
                for d, s, n in window:
                    key, raw, lo, tokens_ = held[d]
                    part = raw[4 * (s - lo) : 4 * (s - lo + n)]
                    out.append((key, s, n, zlib.crc32(part), tokens_, base + seq, at, size, g))
                    at += n
                    if with_ids:
                        ids.append(part)
                seq += 1
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                ends = np.cumsum([0] + [len(c) // 4 for c in ids]).astype(np.int32)
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def forget() -> None:
            """Keeps of each document what still waits: less than the longest tier, however long it is."""
            first: dict[int, int] = {}
            for row in packer.wait.values():
                for _, d, s in row:
                    first[d] = min(first.get(d, s), s)
            for d in list(held):
                key, raw, lo, tokens_ = held[d]
                if d not in first:
                    del held[d]
                elif first[d] > lo:
                    held[d] = key, raw[4 * (first[d] - lo) :], first[d], tokens_

        for keys, texts in slices(batches):
            windows: list[tuple[int, list]] = []
            flat, begins = enc.encode(texts)
            for key, a, b in zip(keys.to_pylist(), begins.tolist(), begins[1:].tolist()):
                held[doc] = (key, flat[a:b].tobytes() + end, 0, b - a + 1)
                windows += packer.add(doc, b - a + 1)
                doc += 1
            if packer.n >= WAITING:
                windows += packer.full()
            if windows:
                yield rows(windows)
                forget()
        windows = [*packer.full(), *packer.tail()]
        if windows:
            yield rows(windows)

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA[, ids array<int>]: one per piece. Each id of each row's text, end_id after it, lies in one piece.

    A text may be of any length: of what waits a task holds less than the longest tier's tokens a document.
    A null or empty text is its end_id alone. Repeated rows are packed each on its own; a null
    doc_id stays null. Every window is full: of a tier's length, or, for the few pieces that a
    partition has left over, of a smaller power of two. Empty in, empty out.
    """
    run = _pack(path or default_path(), end_id, tuple(tiers), with_ids)
    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run), SCHEMA + ", ids array<int>" * with_ids)


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op8_hierarchical_packing": op8_hierarchical_packing}
ORACLE: dict[str, str] = {}
