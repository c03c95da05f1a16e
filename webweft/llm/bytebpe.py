"""Byte-level BPE from a public tokenizer file: pre-tokens, exact merges of many words at once, decoding."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Words of more bytes than this are merged one by one with a heap, in n log n.
LONG = 128
#: Words that a worker remembers; beyond that it starts anew.
CACHE_WORDS = 400_000

#: White space, as Unicode's property has it.
SPACE = "\t-\r \x85\xa0  -     　"


#: The letters and numbers among the first 256 code points.
LATIN_LETTER, LATIN_NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(rf" ?\p{{L}}+|'(?:s|t|re|ve|m|ll|d)| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for each of the first 256 code points."""
    out = np.full(256, 3, dtype=np.uint8)
    for kind, signs in ((0, "[\t-\r \x85\xa0]"), (1, f"[{LATIN_LETTER}]"), (2, f"[{LATIN_NUMBER}]")):
        out[[c for c in range(256) if re.match(signs, chr(c))]] = kind
    return out


def _latin_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, in texts of code points under 256 without apostrophes, laid end to end."""
    kind = _kinds()[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[begins] = edge[-1] = True
    before = np.append(np.uint8(9), kind[:-1])
    before[edge[:-1]] = 9
    solid_next = np.append(kind[1:] != 0, False) & ~edge[1:]
    space = kind == 0
    joined = np.append(False, raw[:-1] == 32) & ~edge[:-1]  # a blank goes to what follows it
    return np.flatnonzero(np.where(space, (before != 0) | solid_next, (kind != before) & ~joined))


def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of the texts one after another (UTF-8, binary), and each text's number of them."""
    latin, raws, wide = [], [], []
    for i, t in enumerate(texts):
        try:
            raw = t.encode("latin-1")
            plain = b"'" not in raw
        except UnicodeEncodeError:
            plain = False
        if plain:
            latin.append(i)
            raws.append(raw)
        else:
            wide.append(i)
    count = np.zeros(len(texts), dtype=np.int64)
    own = pa.array([], pa.binary())
    if any(raws):
        raw = np.frombuffer(b"".join(raws), np.uint8)
        size = np.array([len(r) for r in raws])
        begins = (np.cumsum(size) - size)[size > 0]
        starts = _latin_starts(raw, begins)
        at = np.append(0, np.cumsum(1 + (raw >= 128), dtype=np.int32))  # a code point's place in UTF-8
        data = b"".join([texts[i].encode() for i in latin])
        own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(at[starts], at[-1]).astype(np.int32)), pa.py_buffer(data)])
        count[latin] = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(size))))
    if not wide:
        return own, count
    find = _pattern()
    found = [find(texts[i]) for i in wide]
    count[wide] = [len(f) for f in found]
    words = pa.array([w.encode("utf-8", "surrogatepass") for f in found for w in f], pa.binary())
    if not len(own):
        return words, count
    # back into the order of the texts
    both, first = pa.concat_arrays([own, words]), np.zeros(len(texts), dtype=np.int64)
    first[latin] = np.cumsum(count[latin]) - count[latin]
    first[wide] = len(own) + np.cumsum(count[wide]) - count[wide]
    take = np.arange(len(both)) + np.repeat(first - (np.cumsum(count) - count), count)
    return both.take(pa.array(take)), count


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Merge rules and vocabulary of a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        to_byte = {c: b for b, c in byte_letters().items()}
        self.token_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.array([vocab[byte_letters()[b]] for b in range(256)], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = np.append(key[order], np.int64(1) << 60), np.append(order, 0)
        self.made = made
        at = {int(x): b for b, x in enumerate(self.byte_id)}
        self.byte_ranks = np.full((256, 256), len(pairs), dtype=np.int64)
        for r, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            if a in at and b in at:
                self.byte_ranks[at[a], at[b]] = r
        self.rule = dict(zip(key.tolist(), range(len(key))))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap of its adjacent pairs; lowest rank first, then leftmost."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rule, made = self.rule, self.made
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rule.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rule.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (s, i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (s := rule.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, (s, h, sym[h], sym[i]))
        return [s for s in sym if s >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32 bytes. All words advance together, a merge rule a round."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.merge_long(w), dtype="<u4").tobytes()
        if not short:
            return out
        length = np.array([len(words[i]) for i in short])
        raw = b"".join([words[i] for i in short])
        sym = self.byte_id[np.frombuffer(raw, np.uint8)]
        owner = np.repeat(np.arange(len(short)), length)
        none = len(self.made)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks(left: np.ndarray) -> np.ndarray:
            """The rank of the pair that starts at each place."""
            right = np.minimum(left + 1, len(sym) - 1)
            key = sym[left] << 20 | sym[right]
            at = np.searchsorted(self.keys, key)
            return np.where((self.keys[at] == key) & (owner[left] == owner[right]) & (left != right), self.ranks[at], none)

        rank = self.byte_ranks[np.frombuffer(raw, np.uint8)[:-1], np.frombuffer(raw, np.uint8)[1:]]
        rank = np.append(np.where(owner[1:] == owner[:-1], rank, none), none)
        while len(sym):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            over = least == none
            if over.any():
                gone = np.repeat(over, size)
                done.append((owner[gone], sym[gone]))
                stay = ~gone
                sym, owner, rank = sym[stay], owner[stay], rank[stay]
                size, least = size[~over], least[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, size)
            if (hit[1:] & hit[:-1]).any():  # a run of one sign: every other pair of it
                start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), np.arange(len(hit)), 0))
                hit &= (np.arange(len(hit)) - start) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            stay = ~np.append(False, hit[:-1])
            sym, owner, rank = sym[stay], owner[stay], rank[stay]
            where -= np.arange(len(where))  # where the merged signs are now; only they and those before them have new pairs
            rank[where] = ranks(where)
            prior = where[where > 0] - 1
            rank[prior] = ranks(prior)
        owner = np.concatenate([o for o, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(owner, kind="stable")
        flat = sym[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(short))) * 4).tolist()
        lo = 0
        for i, hi in zip(short, ends):
            out[i] = flat[lo:hi]
            lo = hi
        return out


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class Encoder:
    """Texts to ids, as the tokenizers library does without special tokens added.

    lookup: gives the ids (uint32 bytes) of those of a list of words that it knows, else None;
    other words are merged exactly. What has been found is remembered, within a bound.
    """

    def __init__(self, bpe: ByteBpe, lookup=None):
        self.bpe, self.lookup, self.known = bpe, lookup, {}

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            ask = [words[i] for i in new]
            got = self.lookup(ask) if self.lookup else [None] * len(ask)
            rest = [i for i, g in enumerate(got) if g is None]
            for i, ids in zip(rest, self.bpe.merge_many([ask[i] for i in rest])):
                got[i] = ids
            for i, ids in zip(new, got):
                out[i] = ids
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
            known.update(zip(ask, got))
        return out

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens, count = cut(texts)
        if not len(tokens):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        coded = tokens.dictionary_encode()
        ids = self._learn(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in ids]) // 4
        at = coded.indices.to_numpy()
        many = size[at]
        ends = np.cumsum(many)
        flat = np.frombuffer(b"".join(ids), "<u4")
        flat = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[at] - (ends - many), many)]
        return flat, np.append(0, ends)[np.append(0, np.cumsum(count))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after another, and the place in them at which each text begins, the end last."""
        special = self.bpe.special
        if not any(s in t for t in texts for s in special):
            return self._ids(texts)
        # texts that hold a special token's string fall into parts around it
        parts = [self.bpe.split_special(t) for t in texts]
        flat, begins = self._ids(["" if p in special else p for ps in parts for p in ps])
        out, bounds, k = [], [0], 0
        for ps in parts:
            own = []
            for p in ps:
                own.append(np.array([special[p]], dtype="<u4") if p in special else flat[begins[k] : begins[k + 1]])
                k += 1
            out += own
            bounds.append(bounds[-1] + sum(map(len, own)))
        return np.concatenate(out), np.array(bounds)
