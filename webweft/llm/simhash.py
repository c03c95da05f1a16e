"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints that share a block of bits (pigeonhole: radius + 1 blocks) meet in a bucket. There
their bits stand vertically, 64 fingerprints to a machine word and plane. One query's distances
to 64 fingerprints are counted at once by carry-save counters, plane after plane, and a block
is abandoned as soon as all of its lanes exceed the radius. A bucket over `cap` is dealt anew by
the bits that its key does not fix, until its size is bounded; no pair is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import Stored, keyed_text, lean, read
from webweft.llm.graph import components, local_roots

#: Most fingerprints of a bucket that one task compares.
CAP = 4096
#: Query-block pairs that are compared together.
PAIRS = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over shingles of lower-cased (A-Z) words, repeats included; 0 without words."""
    return simhash(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def links_in_runs(fp: np.ndarray, starts: np.ndarray, radius: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within a run of fp that differ in at most radius bits, each found bit-sliced.

    starts: first index of each run. skip: mask of bits known to be equal within each run.
    """
    found = list(hits(fp, starts, radius, skip))
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (empty, empty)


def hits(fp: np.ndarray, starts: np.ndarray, radius: int, skip: int = 0, ask: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """links_in_runs() some at a time. ask: indices whose links alone are wanted, each (asked, any other of its run)."""
    n = len(fp)
    length = np.diff(np.append(starts, n))
    n_blocks = (length + 63) // 64
    run_of = np.repeat(np.arange(len(starts)), length)
    lane_at = np.arange(n) - starts[run_of]
    block0 = np.cumsum(n_blocks) - n_blocks
    block = block0[run_of] + lane_at // 64
    lane = (lane_at % 64).astype(np.uint64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    lanes = np.diff(np.append(first, n)).astype(np.uint64)
    valid = np.where(lanes == 64, _ALL, (np.uint64(1) << (lanes % np.uint64(64))) - np.uint64(1))
    order = [p for p in range(64) if not skip >> p & 1]
    planes = {p: np.bitwise_or.reduceat(((fp >> np.uint64(p)) & np.uint64(1)) << lane, first) for p in order}
    # each query meets the blocks of its run: all of them, or those from its own on
    who = np.arange(n) if ask is None else ask
    begin = block if ask is None else block0[run_of[who]]
    reach = (block0 + n_blocks)[run_of[who]] - begin
    upto = np.cumsum(reach)
    lo = 0
    while lo < len(who):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        q = np.repeat(who[lo:hi], reach[lo:hi])
        blk = np.arange(len(q)) - np.repeat(np.cumsum(reach[lo:hi]) - reach[lo:hi], reach[lo:hi]) + np.repeat(begin[lo:hi], reach[lo:hi])
        for a, b in _compare(fp, planes, order, valid, first, q, blk, radius):
            keep = b > a if ask is None else b != a
            yield a[keep], b[keep]
        lo = hi


def _compare(fp, planes, order, valid, first, q, blk, radius):
    size = max(1, radius.bit_length())
    count = [np.zeros(len(q), dtype=np.uint64) for _ in range(size)]
    over = np.zeros(len(q), dtype=np.uint64)

    def within() -> np.ndarray:
        more, same = over.copy(), np.full(len(over), _ALL)
        for j in reversed(range(size)):
            if radius >> j & 1:
                same &= count[j]
            else:
                more |= same & count[j]
                same &= ~count[j]
        return valid[blk] & ~more

    for k, p in enumerate(order):
        carry = planes[p][blk] ^ (np.uint64(0) - ((fp[q] >> np.uint64(p)) & np.uint64(1)))
        for j in range(size):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if k % 6 == 5:
            live = within() != 0
            if not live.all():
                q, blk, over = q[live], blk[live], over[live]
                count = [c[live] for c in count]
            if not len(q):
                return
    hit = np.unpackbits(within().astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(hit)
    yield q[row], first[blk[row]] + lane


def _bucket_links(radius: int):
    def solve(tbl, key, fp):
        change = np.flatnonzero((np.diff(tbl, prepend=-1) != 0) | (np.diff(key, prepend=key[0] - 1) != 0))
        length = np.diff(np.append(change, len(fp)))
        many = np.repeat(length > 1, length)
        if not many.any():
            return None
        fp = fp[many]
        length = length[length > 1]
        starts = np.cumsum(length) - length
        a, b = links_in_runs(fp.view(np.uint64), starts, radius)
        root = local_roots(len(fp), a, b)
        off = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[off]), pa.array(fp[root[off]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            tbl, key, _ = cols
            last = np.flatnonzero((tbl != tbl[-1]) | (key != key[-1])) if len(tbl) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut and (out := solve(*(c[:cut] for c in cols))) is not None:
                yield out
        if held is not None and len(held[0]) and (out := solve(*held)) is not None:
            yield out

    return run


def _spread(free: list[int], blocks: int) -> list[list[int]]:
    """free bits in as many blocks as asked for, evenly."""
    return [free[len(free) * i // blocks : len(free) * (i + 1) // blocks] for i in range(blocks)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def fingerprint_links(fps: DataFrame, radius: int = 2, cap: int = CAP) -> DataFrame:
    """(u, v): links that join all distinct fingerprints (column fp) within radius bits into their groups.

    Each bucket gives a spanning star of each of its groups, not all pairs. Buckets of more than
    cap fingerprints are dealt anew by blocks of the bits that are still free; a bucket whose free
    bits number at most log2(cap) can't be larger than cap, so this ends.
    """
    spark = fps.sparkSession
    tables = [list(range(64))]
    now = fps.select("fp", F.lit(0).alias("tbl"))
    out, stored = None, []
    while True:
        split, keys = [], []
        for free in tables:
            keys.append([len(split) + i for i in range(radius + 1)])
            split += [(b, [x for x in free if x not in b]) for b in _spread(free, radius + 1)]
        # table t of this level goes to its radius + 1 blocks
        cases = F.when(F.lit(False), F.array().cast("array<struct<tbl:int,key:long>>"))
        for t, to in enumerate(keys):
            cases = cases.when(F.col("tbl") == t, F.array(*[F.struct(F.lit(k).alias("tbl"), F.col("fp").bitwiseAND(F.lit(_mask(split[k][0]))).alias("key")) for k in to]))
        level = now.select("fp", "tbl", *([] if len(tables) == 1 else ["bucket"])).withColumn("to", F.explode(cases))
        held = [] if len(tables) == 1 else ["bucket"]
        level = level.select(F.col("to.tbl").alias("tbl"), (F.xxhash64("bucket", "to.key") if held else F.col("to.key")).alias("key"), "fp")
        table = Stored(level.repartition("tbl", "key"), "buckets")
        stored.append(table)
        hot = table.df.groupBy("tbl", "key").count().where(F.col("count") > cap).select("tbl", "key")
        rest = [free for _, free in split]
        any_hot = min(map(len, rest)) > cap.bit_length() and not hot.isEmpty()
        small = table.df.join(hot, ["tbl", "key"], "left_anti") if any_hot else table.df
        links = small.repartition("tbl", "key").sortWithinPartitions("tbl", "key").select("tbl", "key", "fp").mapInArrow(lean(_bucket_links(radius)), "u long, v long")
        out = links if out is None else out.union(links)
        if not any_hot:
            break
        now = table.df.join(hot, ["tbl", "key"]).select("fp", "tbl", F.col("key").alias("bucket"))
        tables = rest
    done = Stored(out.distinct(), "links")
    for t in stored:
        t.drop()
    return spark.read.schema(done.schema).parquet(done.path)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, cap: int = CAP) -> DataFrame:
    """(doc_id, fp long, component_id): one row per input row; component_id is the smallest doc_id reachable.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated. A null id takes part but is never a component's smallest. Empty in, empty out.
    """
    own = Stored(keyed_text(docs, id_col, text_col).mapInArrow(lean(_fingerprints(shingle)), "doc_id long, fp long"), "fingerprints")
    first = own.df.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(first.select("fp"), radius, cap))
    label = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    label = Stored(label, "labels").df
    group = label.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = label.join(group, "root").select("fp", "component_id")
    return own.df.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: Bands of two minima each: texts of Jaccard similarity 0.8 share one with probability 1 - 0.36**12.
BANDS = 12
#: Bits by which SimHashes of such sets differ at most, save for a share below that: a bit differs with
#: probability 3/16 at most (four shingles of five), and more than 28 of 64 do with 1.1e-6.
NEAR_BITS = 28
_rng = np.random.default_rng(8)
_MULTIPLY = _rng.integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of lower-cased (A-Z) words, repeats included; fewer words are one shingle, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, zip(*(words[i:] for i in range(shingle))))), dtype=np.uint64, count=len(words) - shingle + 1)


def simhash(h: np.ndarray) -> int:
    if not len(h):
        return 0
    h = h.astype(">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 16384):
        ones += np.unpackbits(h[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _sketch(shingle: int):
    """Of each text: a digest of its words, the SimHash of its set of shingles, and a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, fps, keys = [], [], []
            for t in b.column(1).to_pylist():
                # the set that similarity is measured on: a repeated line must not outvote the rest
                h = np.unique(shingle_hashes(t, shingle))
                digest.append(xxhash.xxh3_64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())))
                fps.append(simhash(h))
                if len(h):
                    h = h ^ (h >> np.uint64(31))
                    least = [(h * m).min() for m in _MULTIPLY]
                    keys.append([int(least[2 * k] ^ (least[2 * k + 1] >> np.uint64(1))) for k in range(BANDS)])
                else:
                    keys.append([])
            lists = pa.array([np.array(k, dtype=np.uint64).view(np.int64) for k in keys], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["doc_id", "text_hash", "node", "fp", "keys"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns of batches sorted by their first, cut where it changes; a run is never parted."""
    held = None
    for b in batches:
        cols = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in b.columns]
        cols = cols if held is None else [x + y if isinstance(x, list) else np.append(x, y) for x, y in zip(held, cols)]
        cut = np.flatnonzero(cols[0] != cols[0][-1]) if b.num_rows else []
        at = int(cut[-1]) + 1 if len(cut) else 0
        if at:
            yield [c[:at] for c in cols]
        held = [c[at:] for c in cols]
    if held is not None and len(held[0]):
        yield held


#: Columns of what meets in a cell: side 0 is compared with all of the cell, side 1 with side 0 alone. comp is the
#: group that a node is known to be in; nodes of one group are not compared.
_CELL = "cell long, side int, node long, fp long, comp long"


def _close(radius: int):
    """Members of a cell that another group's SimHash is close to, one of the two being of side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches):
            cell, side, _, fp, comp = cols
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            near = np.zeros(len(cell), dtype=bool)
            for a, b in hits(fp.view(np.uint64), starts, radius, ask=np.flatnonzero(side == 0)):
                other = comp[a] != comp[b]
                near[a[other]] = near[b[other]] = True
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in cols], names=[x.split()[0] for x in _CELL.split(", ")])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sets = [], []
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if xxhash.xxh3_64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())) == n & 0xFFFFFFFFFFFFFFFF:
                    node.append(n)
                    sets.append(np.unique(shingle_hashes(t, shingle)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


class Sets:
    """Sets of which many pairs are compared, as bit sets over the elements that several of them share.

    Where those would be very large, pairs are compared one by one.
    """

    MOST_WORDS = 1 << 24

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(x) for x in sets])
        _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        words = int(shared.sum()) // 64 + 1
        self.bits = None
        if words * len(sets) <= self.MOST_WORDS:
            keep = shared[element]
            bit = (np.cumsum(shared) - 1)[element[keep]]
            self.bits = np.zeros((len(sets), words), dtype=np.uint64)
            np.bitwise_or.at(self.bits, (np.repeat(np.arange(len(sets)), self.size)[keep], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jaccard similarity of the sets a[i] and b[i]."""
        both = np.empty(len(a), dtype=np.int64)
        if self.bits is None:
            both[:] = [len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())]
        else:
            step = max(1, 2_000_000 // self.bits.shape[1])
            for i in range(0, len(a), step):
                both[i : i + step] = np.bitwise_count(self.bits[a[i : i + step]] & self.bits[b[i : i + step]]).sum(1, dtype=np.int64)
        return both / np.maximum(self.size[a] + self.size[b] - both, 1)


#: Cells of more members are compared with one of them first: what is linked by that needs no more comparisons.
SMALL_CELL = 256


def _cell_links(fp: np.ndarray, side: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (comp, comp) between the groups of a cell, as stars. No pair of differing groups is left out, but those that
    links found before already join."""
    groups, at = np.unique(comp, return_inverse=True)
    root = np.arange(len(groups))
    all_sets = Sets(sets)
    start = np.zeros(1, dtype=np.int64)

    def take(ask: np.ndarray) -> None:
        nonlocal root
        for a, b in hits(fp, start, radius, ask=ask):
            # a pair is asked for from either side; one of them must be side 0
            open_ = (root[at[a]] != root[at[b]]) & ((side[a] == 0) | (side[b] == 0))
            a, b = a[open_], b[open_]
            good = all_sets.similarity(a, b) >= similarity - 1e-12 if len(a) else np.zeros(0, bool)
            if good.any():
                root = local_roots(len(groups), np.append(np.arange(len(groups)), at[a[good]]), np.append(root, at[b[good]]))

    if len(fp) > small:
        take(np.flatnonzero(side == 0)[:1])
        most = np.bincount(root[at]).argmax()
        take(np.flatnonzero(root[at] != most))
    else:
        take(np.flatnonzero(side == 0))
    off = np.flatnonzero(root != np.arange(len(groups)))
    return groups[off], groups[root[off]]


def _small_cells(fp: np.ndarray, comp: np.ndarray, starts: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """_cell_links() of many small cells together, all of side 0."""
    a, b = links_in_runs(fp, starts, radius)
    a, b = (x[comp[a] != comp[b]] for x in (a, b))
    cell = np.searchsorted(starts, a, side="right")
    by = np.argsort(cell, kind="stable")
    a, b, cell = a[by], b[by], cell[by]
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(a)]
    good = np.zeros(len(a), dtype=bool)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo <= 3:
            near = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a[lo:hi].tolist(), b[lo:hi].tolist())]
            either = [len(sets[i]) + len(sets[j]) - n for i, j, n in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), near)]
            good[lo:hi] = np.array(near) / np.maximum(either, 1) >= similarity - 1e-12
        elif hi > lo:
            own, at = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
            good[lo:hi] = Sets([sets[i] for i in own.tolist()]).similarity(at[: hi - lo], at[hi - lo :]) >= similarity - 1e-12
    root = local_roots(len(fp), a[good], b[good])
    off = np.flatnonzero(root != np.arange(len(fp)))
    return comp[off], comp[root[off]]


def _verified(radius: int, similarity: float, small: int):
    """Links of groups in a cell: of texts that are close by SimHash and similar by their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, side, _, fp, comp, raw in _runs(batches):
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            length = np.diff(np.append(starts, len(cell)))
            fp, sets = fp.view(np.uint64), [np.frombuffer(x, np.uint64) for x in raw]
            plain = (length <= small) & (np.maximum.reduceat(side, starts) == 0)
            out = []
            if plain.any():
                own = np.flatnonzero(np.repeat(plain, length))
                size = length[plain]
                out.append(_small_cells(fp[own], comp[own], np.cumsum(size) - size, [sets[i] for i in own.tolist()], radius, similarity))
            for lo, n in zip(starts[~plain].tolist(), length[~plain].tolist()):
                if n > 1:
                    s = slice(lo, lo + n)
                    out.append(_cell_links(fp[s], side[s], comp[s], sets[s], radius, similarity, small))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["u", "v"])

    return run


def near_duplicate_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = NEAR_BITS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): groups of texts whose sets of shingles have at least this Jaccard similarity.

    Texts of equal words are one node. Nodes that share a band of two shingle minima are compared bit-sliced
    by SimHash; those within radius are held against each other's shingles. A bucket of more than cap
    texts is first compared with a few of its own, in parts; then what is not in its largest group by that is
    compared with all of it, part by part, so that no pair of texts that are in different groups is left out.
    component_id is the smallest doc_id reachable; texts without words form one group. Repeated rows
    stay repeated. A null id takes part but is never the smallest; a group without ids has none. Empty in, empty out.
    """
    return _grouped(keyed_text(docs, id_col, text_col), shingle, similarity, radius, cap).select("doc_id", "component_id")


#: Members of a crowded bucket, on average, that all others are compared with first.
LEADERS = 32


def _grouped(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = NEAR_BITS, cap: int = CAP) -> DataFrame:
    """near_duplicate_texts() of rows (doc_id, text), with the hash of each row's text: (doc_id, text_hash, component_id)."""
    no_id = F.lit(-(1 << 63))
    own = Stored(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lean(_sketch(shingle)), "doc_id long, text_hash long, node long, fp long, keys array<long>"), "sketches")
    # of each node one row that its text is taken from, and the smallest id
    nodes = Stored(own.df.groupBy("node", "fp", "keys").agg(F.min(F.struct(F.coalesce("doc_id", no_id).alias("at"), "text_hash")).alias("row"), F.min("doc_id").alias("first")), "nodes")
    member = nodes.df.select("node", "fp", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node", "fp")
    buckets = Stored(member, "bands")
    many = buckets.df.groupBy("bucket").count().where("count > 1")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")

    def links_of(cells: DataFrame) -> Stored:
        """(u, v) of _CELL rows: those that are close by SimHash, verified by their shingles."""
        close = Stored(cells.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(lean(_close(radius)), _CELL), "close")
        texts = rows.select(F.coalesce("doc_id", no_id).alias("at"), F.xxhash64("text").alias("text_hash"), "text")
        wanted = close.df.select("node").distinct().join(nodes.df.select("node", "row.*"), "node")
        sets = texts.join(wanted, ["at", "text_hash"]).select("text", "node").mapInArrow(lean(_sets(shingle)), "node long, shingles binary").dropDuplicates(["node"])
        ready = close.df.join(sets, "node").select("cell", "side", "node", "fp", "comp", "shingles")
        out = Stored(ready.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(lean(_verified(radius, similarity, SMALL_CELL)), "u long, v long"), "links")
        close.drop()
        return out

    crowded = many.where(F.col("count") > cap).select("bucket", F.col("count").alias("n"), F.ceil(F.col("count") / cap).cast("int").alias("parts"))
    crowded = Stored(crowded, "crowded")
    plain = buckets.df.join(many.where(F.col("count") <= cap).select("bucket"), "bucket", "left_semi")
    found = [links_of(plain.select(F.col("bucket").alias("cell"), F.lit(0).alias("side"), "node", "fp", F.col("node").alias("comp")))]
    if not crowded.df.isEmpty():
        inside = buckets.df.join(crowded.df, "bucket")
        cell = lambda *of: F.xxhash64("bucket", *of).alias("cell")
        # each part of a crowded bucket with its leaders: as many in any bucket, chosen by hash
        leads = inside.where(F.pmod(F.xxhash64("node", F.lit(1)), "n") < LEADERS).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        stars = leads.select(cell("p"), F.lit(0).alias("side"), "node", "fp", F.col("node").alias("comp")).union(inside.select(cell(part("parts")), F.lit(1), "node", "fp", "node"))
        found.append(links_of(stars))
        # what is not in a bucket's largest group by now meets all of it
        known = Stored(components(found[0].df.union(found[1].df)), "known")
        inside = inside.join(known.df, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        largest = inside.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
        rest = largest.where("most < all").select("bucket", "largest", F.ceil((F.col("all") - F.col("most")) / cap).cast("int").alias("rest_parts"))
        inside = Stored(inside.join(rest, "bucket").select("bucket", "node", "fp", "comp", "parts", "largest", "rest_parts"), "inside")
        left = inside.df.where("comp <> largest").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        every = inside.df.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
        found.append(links_of(left.select(cell(part("rest_parts"), "p"), F.lit(0).alias("side"), "node", "fp", "comp").union(every.select(cell("r", part("parts")), F.lit(1), "node", "fp", "comp"))))
        known.drop()
        inside.drop()
    links = found[0].df
    for more in found[1:]:
        links = links.union(more.df)
    roots = components(links)
    label = Stored(nodes.df.groupBy("node").agg(F.min("first").alias("first")).join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "groups")
    group = label.df.groupBy("root").agg(F.min("first").alias("component_id"))
    done = Stored(own.df.select("doc_id", "text_hash", "node").join(label.df.join(group, "root").select("node", "component_id"), "node").select("doc_id", "text_hash", "component_id"), "near")
    for t in (own, nodes, buckets, crowded, label, *found):
        t.drop()
    return done.df


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, in all their columns, that stand for their group: those of its smallest id.

    Rows with a null id stay. Where ids repeat, rows of equal id and text are one first, and of rows
    with equal id all stay that are in the group they stand for.
    """
    ids = docs.select(F.col(id_col).alias("__id"))
    if not ids.where("__id is not null").groupBy("__id").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates([id_col, text_col])
    groups = _grouped(keyed_text(docs, id_col, text_col), **how)
    # by text as well: another text under the same id may stand for a group of its own
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text")).distinct()
    return docs.join(gone, (docs[id_col] == F.col("__gone")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__text")), "left_anti")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE: dict[str, str] = {}
