"""Word trigram model with deleted interpolation.

Documents are taken in blocks. A block sends its distinct words and word pairs, as sorted slices of
64-bit hashes with its own training counts, to the slices' tasks; these add up the counts of all
blocks and send them back in the same order. So a block knows the corpus counts of all it holds,
and no token is ever a row. Triples go the same way in a second exchange, when the first one's files are gone.

Estimates are mixed by buckets of context frequency: pairs, words and a uniform share first, and triples with that
mixture. The weights are learnt by expectation-maximisation on held-out counts: each training document is left out
of the counts that predict it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import Stored, fold, lean, read, release_shuffles

#: Characters of text in a block.
BLOCK_CHARS = 2_000_000
#: Buckets of context frequency: 0, 1, 2-3, 4-7, and so on.
BUCKETS = 40
#: Half powers of two that probabilities are binned by for the weights; 0 has a bin of its own.
BINS = 96
ROUNDS = 60
#: Hashes that a slice has about; least and most slices are 2**SLICE_BITS. A block sends a row for each slice, so that many
#: small ones cost more than their hashes. Beyond 2**38 pairs (of about four terabytes of text) slices grow with the
#: input, as a block's slices would hold no more than a pair each.
SLICE, SLICE_BITS = 1 << 20, (8, 18)
#: Hashes that are added up at once.
RANGE = 1 << 21
#: The end of a text. No word has a space.
END = b" "

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Stands for the hash of the pair before a text's first word.
_START = np.uint64(0x94D049BB133111EB)
_PART = "block long, kind int, slice int, data binary"
_BLOCK = "block long, n_pairs long, ids binary, null_ids binary, sizes binary, learn binary, tokens binary, words binary"
#: Blocks with corpus counts: of words and pairs, and of triples too, when hashes are no longer needed.
_COUNTED = _BLOCK + ", n_words long, word_counts binary, pair_counts binary"
_CHAINED = _COUNTED.replace(" words binary,", "") + ", triple_counts binary"
#: Parts of the blocks that are put together one after another, so that no more of them are on disk twice.
PARTS = 4


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), schema.split(", "))], names=_names(schema))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * _K1 + b
    h = (h ^ (h >> np.uint64(32))) * _K2
    return h ^ (h >> np.uint64(29))


def _bin(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.clip(1 - 2 * np.log2(np.maximum(x, 1e-300)), 1, BINS - 1), 0).astype(np.int64)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _places(n: int) -> int:
    """Bits that number n places."""
    return max(n - 1, 1).bit_length()


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (not negative) in ascending order and their places. Keys are sorted with their places in the low bits, which
    takes a fraction of an argsort's time, wherever both have room."""
    bits = _places(len(keys))
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = (keys << bits) | np.arange(len(keys))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where keys in order differ from the one before."""
    out = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=out[1:])
    return out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the number of each key among them. A block has fewer than 2**31."""
    ordered, order = _sorted(keys)
    first = _starts(ordered)
    at = np.empty(len(keys), dtype=np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return ordered[first], at


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a block's row is large."""
    for b in batches:
        columns = list(zip(b.schema.names, b.columns))
        for i in range(b.num_rows):
            yield {k: c[i].as_py() for k, c in columns}


class Block:
    """Token stream of some documents: tokens are numbers of the block's words, the most frequent first.

    A pair is a token and the one before it in the stream; the one before a text's first is END. A triple is a token and
    its context, the pair before it; a text's first has the context START, which is numbered after all pairs.
    """

    def __init__(self, ids, sizes: np.ndarray, learn: np.ndarray, tokens: np.ndarray, words: np.ndarray):
        self.ids, self.sizes, self.learn, self.tokens, self.words = ids, sizes, learn, tokens, words
        end = tokens[-1]
        self.before = np.append(end, tokens[:-1]) if len(tokens) else tokens
        self.pair_keys, self.pairs = _numbered(self.before.astype(np.int64) * len(words) + tokens)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    @classmethod
    def of(cls, ids, texts: pa.Array, learn: np.ndarray) -> Block:
        """Of texts as an Arrow array of strings without nulls."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        # blanks around a text leave empty words
        real = np.asarray(pc.binary_length(split.flatten())) > 0
        sizes = np.diff(np.append(0, np.cumsum(real))[split.offsets.to_numpy()]) + 1
        coded = split.flatten().filter(pa.array(real)).dictionary_encode()
        end = len(coded.dictionary)
        tokens = np.full(int(sizes.sum()), end, dtype=np.int32)
        within = np.ones(len(tokens), dtype=bool)
        within[np.cumsum(sizes) - 1] = False
        tokens[within] = coded.indices.to_numpy()
        # the dictionary's words lie one after another; as single scalars they would take longer than their hashes
        ends = np.cumsum(np.asarray(pc.binary_length(coded.dictionary), dtype=np.int64)).tolist()
        own = b"".join([pc.binary_join(pa.ListArray.from_arrays([0, end], coded.dictionary), "")[0].as_py().encode(), END])
        words = np.fromiter((xxhash.xxh64_intdigest(own[a:b]) for a, b in zip([0, *ends], [*ends, len(own)])), np.uint64, end + 1)
        _, order = _sorted(len(tokens) - np.bincount(tokens, minlength=len(words)))
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(ids, sizes.astype(np.int64), learn, rank[tokens], words[order])

    @cached_property
    def context(self) -> np.ndarray:
        out = np.append(np.int32(len(self.pair_keys)), self.pairs[:-1]) if len(self.pairs) else self.pairs
        out[np.cumsum(self.sizes) - self.sizes] = len(self.pair_keys)
        return out

    @cached_property
    def _triples(self) -> tuple[np.ndarray, np.ndarray]:
        return _numbered(self.context.astype(np.int64) * len(self.words) + self.tokens)

    @property
    def triple_keys(self) -> np.ndarray:
        return self._triples[0]

    @property
    def triples(self) -> np.ndarray:
        return self._triples[1]

    def hashes(self, kind: int) -> np.ndarray:
        """Of distinct words (0), pairs (1) or triples (2)."""
        if kind == 0:
            return self.words
        n = len(self.words)
        pairs = _pair_hash(self.words[self.pair_keys // n], self.words[self.pair_keys % n])
        if kind == 1:
            return pairs
        return _pair_hash(np.append(pairs, _START)[self.triple_keys // n], self.words[self.triple_keys % n])

    def counts(self, kind: int) -> np.ndarray:
        """Training counts of the block's words, pairs or triples."""
        of, n = ((self.tokens, len(self.words)), (self.pairs, len(self.pair_keys)), (self.triples, len(self.triple_keys)) if kind == 2 else None)[kind]
        return np.bincount(of[self.learn[self.doc]], minlength=n)


def _slices(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which hashes are sent, by their high bits, and each slice's end in it."""
    s = (h >> np.uint64(64 - bits)).astype(np.int64)
    low = np.uint64((1 << _places(len(h))) - 1)
    both = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    both.sort()
    return (both & low).astype(np.int64), np.cumsum(np.bincount(s, minlength=1 << bits))


def _planes(h: np.ndarray) -> np.ndarray:
    """Hashes byte by byte, so that those that change slowly lie together. The first byte of a hash is its slice's and stays out."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 6::-1].T)


def _joined(planes: np.ndarray, c: np.ndarray) -> bytes:
    """Hashes of a slice, by their planes, and their counts."""
    counts = _narrow(c)
    return counts[:1] + planes.tobytes() + counts[1:]


def _pack(h: np.ndarray, c: np.ndarray) -> bytes:
    return _joined(_planes(h), c)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 1) // (7 + data[0])
    h = np.zeros((n, 8), dtype=np.uint8)
    h[:, 6::-1] = np.frombuffer(data, np.uint8, 7 * n, 1).reshape(7, n).T
    return h.view("<u8").reshape(-1), _wide(data[:1] + data[7 * n + 1 :])


def _store():
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        def block() -> Block:
            ids, texts, learn = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            return Block.of(ids.to_pylist(), texts, np.array(learn.to_pylist(), dtype=bool))

        held, size = [], 0
        for b in batches:
            start = 0
            for i, chars in enumerate(pc.utf8_length(b.column(1)).to_pylist()):
                size += chars + 1
                if size >= BLOCK_CHARS:
                    held.append(b.slice(start, i + 1 - start))
                    yield block()
                    held, size, start = [], 0, i + 1
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for n, block in enumerate(blocks(batches)):
            null = np.array([i is None for i in block.ids])
            ids = np.array([i or 0 for i in block.ids], dtype=np.int64)
            yield _batch(_BLOCK, [(base + n, len(block.pair_keys), ids.tobytes(), null.tobytes(), block.sizes.tobytes(), block.learn.tobytes(), _squeeze(block.tokens), block.words.tobytes())])

    return run


def _squeeze(tokens: np.ndarray) -> bytes:
    """Token numbers byte by byte, compressed: small numbers are frequent. Before them, how many bytes a number has, and how many there are."""
    size = 3 if tokens.max(initial=0) < 1 << 24 else 4
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T)
    return bytes([size]) + len(tokens).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[9:], size * n, "zstd"), np.uint8).reshape(size, n)
    out = planes[0].astype(np.int32)
    for k in range(1, size):
        out |= planes[k].astype(np.int32) << (8 * k)
    return out


def _block(row: dict) -> Block:
    get = lambda k, t: np.frombuffer(row[k], t)
    null = get("null_ids", bool)
    ids = [None if x else i for i, x in zip(get("ids", np.int64).tolist(), null.tolist())]
    return Block(ids, get("sizes", np.int64), get("learn", bool), _unsqueeze(row["tokens"]), get("words", np.uint64))


def _requests(bits: int, kinds: tuple[int, ...]):
    """Of each stored block: its hashes and training counts, a row for each kind (0 words, 1 pairs, 2 triples) and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(row)
            for kind in kinds:
                h, c = block.hashes(kind), block.counts(kind)
                order, ends = _slices(h, bits)
                planes, c = _planes(h[order]), c[order]
                edges = [0, *ends.tolist()]
                out = [(row["block"], kind, s, _joined(planes[:, lo:hi], c[lo:hi])) for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
                for k in range(0, len(out), 10_000):
                    yield _batch(_PART, out[k : k + 10_000])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts for each request, in its order; as block -1, a slice's number of words and of tokens."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        parts = [_unpack(r[3]) for r in rows]
        size = [len(h) for h, _ in parts]
        h = np.concatenate([h for h, _ in parts])
        c = np.concatenate([c for _, c in parts])
        back = np.empty(len(h), dtype="<i8")
        distinct = tokens = 0
        # a slice of very many hashes is added up range by range
        for own in _ranges(h):
            order, first = _grouped(h[own])
            total = np.add.reduceat(c[own][order], np.flatnonzero(first))
            sums = np.empty(len(order), dtype=np.int64)
            sums[order] = total[np.cumsum(first) - 1]
            back[own] = sums
            distinct, tokens = distinct + int((total > 0).sum()), tokens + int(total.sum())
        cuts = np.cumsum([0, *size])
        out = [(r[0], r[1], r[2], _narrow(back[a:b])) for r, a, b in zip(rows, cuts, cuts[1:])]
        if rows[0][1] == 0:
            out.append((-1, 0, rows[0][2], np.array([distinct, tokens], dtype="<i8").tobytes()))
        return _batch(_PART, out)

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][1:3] != row[1:3]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal hashes of a slice together, and where in it another begins.

    They are sorted by what their places leave of their bits; where that puts two of them in the wrong order, by all.
    """
    bits = _places(len(h))
    low = np.uint64((1 << bits) - 1)
    both = h << np.uint64(8)  # the first byte is the slice's
    both &= ~low
    both |= np.arange(len(h), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    ordered = h[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(h)
        ordered = h[order]
    return order, _starts(ordered)


def _ranges(h: np.ndarray) -> Iterator[np.ndarray | slice]:
    """Where a slice's hashes lie, of which all equal ones come together, about RANGE at a time."""
    n = -(-len(h) // RANGE)
    if n <= 1:
        yield slice(None)
        return
    # low bits: the high ones number the slice and are its own
    of = (h & np.uint64(0xFFFFFFFF)) % np.uint64(n)
    order = np.argsort(of, kind="stable")
    yield from np.split(order, np.cumsum(np.bincount(of.astype(np.int64), minlength=n))[:-1])


def _narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes as their largest needs; the first byte tells how many."""
    top = int(x.max(initial=0))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(k[2]))
    return bytes([int(kind[2])]) + x.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _assemble(bits: int, kinds: tuple[int, ...], before: str, after: str):
    """Blocks with the corpus counts of what they hold, from a block's stored row (kind -1) and its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[dict]) -> pa.RecordBatch:
            block = _block(rows[0])
            known = {k: rows[0][k] for k in _names(before)} | {"n_words": len(block.words)}
            for kind in kinds:
                order, _ = _slices(block.hashes(kind), bits)
                c = np.empty(len(order), dtype=np.int64)
                c[order] = np.concatenate([_wide(r["data"]) for r in rows[1:] if r["kind"] == kind])
                known[("word_counts", "pair_counts", "triple_counts")[kind]] = _narrow(c)
            return _batch(after, [tuple(known[k] for k in _names(after))])

        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["block"] != row["block"]:
                yield solve(held)
                held = []
            held.append(row)
        if held:
            yield solve(held)

    return run


class Counted:
    """A block with the corpus counts of its words, pairs and, if there are any, triples, by token."""

    def __init__(self, row: dict):
        self.block = block = _block(row | {"words": np.zeros(row["n_words"], np.uint64).tobytes()})
        words, pairs = _wide(row["word_counts"]), _wide(row["pair_counts"])
        self.words, self.before, self.pairs = words[block.tokens], words[block.before], pairs[block.pairs]
        if "triple_counts" in row:
            # START is the context of as many tokens as there are texts
            self.context = np.append(pairs, words[block.tokens[-1]])[block.context]
            self.triples = _wide(row["triple_counts"])[block.triples]

    def without_own(self) -> dict[str, np.ndarray]:
        """The counts at training tokens, their own documents left out."""
        block = self.block
        own = block.learn[block.doc]
        doc = block.doc[own].astype(np.int64)
        first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]

        def within(x: np.ndarray) -> np.ndarray:
            """How often each token's x stands in its document."""
            ordered, order = _sorted(doc * (len(block.tokens) + len(block.words) + 2) + x[own])
            runs = np.diff(np.append(np.flatnonzero(_starts(ordered)), len(ordered)))
            c = np.empty(len(order), dtype=np.int64)
            c[order] = np.repeat(runs, runs)
            return c

        def before(c: np.ndarray) -> np.ndarray:
            """Each token's predecessor's; what stands before a text counts once in it."""
            return np.where(first, 1, np.append(1, c[:-1])[: len(c)])

        words, pairs = within(block.tokens), within(block.pairs)
        out = {"words": self.words[own] - words, "before": self.before[own] - before(words), "pairs": self.pairs[own] - pairs, "sizes": block.sizes[doc]}
        if hasattr(self, "triples"):
            out |= {"context": self.context[own] - before(pairs), "triples": self.triples[own] - within(block.triples)}
        return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _mixed(words: np.ndarray, before: np.ndarray, pairs: np.ndarray, n: np.ndarray | int, v: int, weights: np.ndarray) -> np.ndarray:
    """Probabilities by pairs, words and the uniform share."""
    bucket = _bucket(before)
    pair, word, rest = (np.ascontiguousarray(w)[bucket] for w in weights.T)
    return pair * _share(pairs, before) + word * (words / np.maximum(n, 1)) + rest / (v + 1)


def _held_out(n: int, v: int = 0, weights: np.ndarray | None = None):
    """Sums over the training documents' tokens, each predicted without its document, binned by two estimates: of pairs
    and words or, with the weights of those, of triples and the mixture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = Counted(row).without_own()
            if not len(at["words"]):
                continue
            rest = np.maximum(n - at["sizes"], 1)
            if weights is None:
                context, high, low = at["before"], _share(at["pairs"], at["before"]), at["words"] / rest
            else:
                context, high, low = at["context"], _share(at["triples"], at["context"]), _mixed(at["words"], at["before"], at["pairs"], rest, v, weights)
            cell = (_bucket(context) * BINS + _bin(high)) * BINS + _bin(low)
            # a cell's sums by one count over all cells, of which there are a few hundred thousand
            size = np.bincount(cell)
            cells = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells, size[cells].astype(np.float64), np.bincount(cell, weights=high)[cells], np.bincount(cell, weights=low)[cells])], names=["cell", "n", "high", "low"])

    return run


def learn_weights(cells, v: int) -> np.ndarray:
    """BUCKETS x 3 weights (pair, word, uniform) from binned sums (rows of cell, n, high, low)."""
    out = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    if not len(cells):
        return out
    cell, n = cells["cell"].to_numpy(), cells["n"].to_numpy()
    p = np.stack([cells["high"].to_numpy() / n, cells["low"].to_numpy() / n, np.full(len(n), 1.0 / (v + 1))], axis=1)
    bucket = cell // (BINS * BINS)
    for k in range(BUCKETS):
        own = bucket == k
        if not own.any():
            if k > 1:
                out[k] = out[k - 1]
            continue
        w = np.array([0.4, 0.4, 0.2]) if k else np.array([0.0, 0.8, 0.2])
        for _ in range(ROUNDS):
            post = p[own] * w
            post /= post.sum(1, keepdims=True)
            w = (post * n[own, None]).sum(0) / n[own].sum()
            w = np.maximum(w, [0.0, 1e-9, 1e-9])
            w /= w.sum()
        out[k] = w
    return out


def learn_shares(cells) -> np.ndarray:
    """The triples' share for each bucket, the rest being the mixture's, from binned sums (rows of cell, n, high, low)."""
    out = np.zeros(BUCKETS)
    if not len(cells):
        return out
    cell, n = cells["cell"].to_numpy(), cells["n"].to_numpy()
    high, low = cells["high"].to_numpy() / n, cells["low"].to_numpy() / n
    bucket = cell // (BINS * BINS)
    for k in range(1, BUCKETS):
        own = bucket == k
        share = 0.5
        if own.any():
            for _ in range(ROUNDS):
                got = share * high[own]
                share = float((n[own] * got / np.maximum(got + (1 - share) * low[own], 1e-300)).sum() / n[own].sum())
                share = min(share, 1 - 1e-9)
            out[k] = share
        elif k > 1:
            out[k] = out[k - 1]
    return out


def _score(n: int, v: int, weights: np.ndarray, shares: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = Counted(row)
            block = at.block
            docs = len(block.sizes)
            share = shares[_bucket(at.context)]
            p = share * _share(at.triples, at.context) + (1 - share) * _mixed(at.words, at.before, at.pairs, n, v, weights)
            base = np.log10((at.words + 0.5) / (n + 0.5 * (v + 1)))
            known = np.bincount(block.doc[at.words > 0], minlength=docs)
            add = lambda x: np.bincount(block.doc, weights=x, minlength=docs)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.sizes), pa.array(known.astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _exchanged(blocks: DataFrame, bits: int, kinds: tuple[int, ...]) -> Stored:
    """The answers (_PART) to what blocks ask for of these kinds."""
    spark = blocks.sparkSession
    # a task for every few slices, however many partitions shuffles have by default
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (len(kinds) << bits) // 16)
    asked = blocks.mapInArrow(lean(_requests(bits, kinds)), _PART)
    answers = Stored(asked.repartition(tasks, "kind", "slice").sortWithinPartitions("kind", "slice").mapInArrow(lean(_add_up), _PART), "lm-answers")
    release_shuffles(spark)
    return answers


def _part(k: int):
    return F.pmod(F.xxhash64("block"), F.lit(PARTS)) == k


def _put_together(parts: list[DataFrame], answers: DataFrame, bits: int, kinds: tuple[int, ...], before: str, after: str, done=lambda k: None) -> list[Stored]:
    """Blocks of schema `after`, a table for each of the PARTS; done is told when a part is there."""
    types = dict(x.split() for x in before.split(", "))
    lost = [F.lit(None).cast(t.replace("long", "bigint")).alias(k) for k, t in types.items() if k != "block"]
    out = []
    for k, blocks in enumerate(parts):
        stored = blocks.select(*types, F.lit(-1).alias("kind"), F.lit(0).alias("slice"), F.lit(None).cast("binary").alias("data"))
        both = stored.union(answers.where("block >= 0").where(_part(k)).select("block", *lost, "kind", "slice", "data"))
        out.append(Stored(both.repartition("block").sortWithinPartitions("block", "kind", "slice").mapInArrow(lean(_assemble(bits, kinds, before, after)), after), "lm-counted"))
        done(k)
        release_shuffles(answers.sparkSession)
    return out


def _all(tables: list[Stored]) -> DataFrame:
    out = tables[0].df
    for t in tables[1:]:
        out = out.union(t.df)
    return out


def lm_scores(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    learn: a Boolean Column over docs; null is false. Texts are lower-cased (A-Z) words and an end; a
    null or empty text is an end alone. Null ids stay null, and each of repeated rows counts as a document. base_score: of add-half word frequencies; score: of the
    interpolated model; both log10. Without training rows every token is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = Stored(rows.mapInArrow(lean(_store()), _BLOCK), "lm-blocks")
    pairs = blocks.df.agg(F.sum("n_pairs")).first()[0] or 1
    bits = int(np.clip(np.ceil(np.log2(pairs / SLICE)), *SLICE_BITS))
    sums = "cell long, n double, high double, low double"

    def binned(df: DataFrame, run):
        cells = df.mapInArrow(lean(run), sums).groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).toPandas()
        return cells.sort_values("cell")

    answers = _exchanged(blocks.df, bits, (0, 1))
    totals = answers.df.where("block = -1").select("data").collect()
    v, n = (int(x) for x in np.sum([np.frombuffer(r.data, "<i8") for r in totals], axis=0)) if totals else (0, 0)
    counted = _put_together([blocks.df.where(_part(k)) for k in range(PARTS)], answers.df, bits, (0, 1), _BLOCK, _COUNTED)
    for t in (blocks, answers):
        t.drop()
    weights = learn_weights(binned(_all(counted), _held_out(n)), v)
    answers = _exchanged(_all(counted), bits, (2,))
    chained = _put_together([t.df for t in counted], answers.df, bits, (2,), _COUNTED, _CHAINED, done=lambda k: counted[k].drop())
    answers.drop()
    shares = learn_shares(binned(_all(chained), _held_out(n, v, weights)))
    scored = _all(chained).mapInArrow(lean(_score(n, v, weights, shares)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(read(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_deleted_interpolation": op9_deleted_interpolation}
ORACLE: dict[str, str] = {}
