"""Words of many texts at once, by their UTF-8 bytes, and filters of hashes that tasks ask before they send a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are taken together; a longer text is taken alone.
CHUNK = 1 << 20
#: Bits of a filter for each hash, and the most that it has: beyond, it lets more pass, which costs rows and no result.
BITS_A_KEY, MOST_BITS = 24, 1 << 26

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TABLE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_BASE, _INVERSE))
    return _powers


def texts(batch: pa.RecordBatch, column: int, most: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes in lower case, each row's end): texts laid end to end with a line break after each; a null is empty."""
    column_ = pc.fill_null(batch.column(column), "")
    size = np.append(0, np.cumsum(pc.binary_length(column_).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
    lo = 0
    while lo < len(column_):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, side="right")) - 1)
        # only what is taken together is copied
        joined = pc.binary_join_element_wise(column_.slice(lo, hi - lo).cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        data = np.frombuffer(joined.buffers()[2], np.uint8)[: size[hi] - size[lo]]
        yield slice(lo, hi), LOWER[data], size[lo + 1 : hi + 1] - size[lo]
        lo = hi


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are inside a word."""
    edges = np.flatnonzero(np.diff(inside[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a stretch of the text after another, so that a long text takes little memory."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + CHUNK, side="right")))
        at = int(start[lo])
        part = data[at : int(stop[hi - 1])]
        power, inverse = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * power[: len(part)], dtype=np.uint64, out=sums[1:])
        a, z = start[lo:hi] - at, stop[lo:hi] - at
        out[lo:hi] = mix((sums[z] - sums[a]) * inverse[a] + (z - a).astype(np.uint64))
        lo = hi
    return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


class Filter:
    """Two bits for each hash of a set: what it has not is not in the set. Its size is bounded, whatever the set's."""

    def __init__(self, words_: np.ndarray):
        self.words = words_

    @staticmethod
    def of(keys: DataFrame) -> Broadcast:
        """A filter of a column of longs, sent to each executor once. The driver gets its bits, by columns."""
        spark = keys.sparkSession
        bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_A_KEY * keys.count()).bit_length()))
        key = F.col(keys.columns[0])
        places = keys.where(key.isNotNull()).select(F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1))).alias("at"))
        got = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return spark.sparkContext.broadcast(Filter(out))

    def has(self, h: np.ndarray) -> np.ndarray:
        last = np.uint64(len(self.words) * 64 - 1)

        def bit(at: np.ndarray) -> np.ndarray:
            return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        out = bit(h & last)
        out[out] = bit(h[out] >> np.uint64(32) & last)
        return out


def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and how often they occur."""
    h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n
