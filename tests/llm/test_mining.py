"""Hard negatives, phrase collocations and benchmark decontamination against brute force, and on edge tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from webweft.llm import collocations, decontaminate, hard_negatives, registry, wordhash
from webweft.llm.suffix_automaton import SuffixAutomaton

LOWER = str.maketrans(wordhash.UPPER_CASE, wordhash.LOWER_CASE)
#: Columns beside the operators' own, with names that the operators use.
EXTRA = "score long, n long, h long, doc string, rid string, a string, cell int"
MORE = (1, 2, 3, "d", "r", "a", 4)


# --- hashes of words ---


def test_words_and_hashes(monkeypatch):
    texts = ["Ab c\tÉé", None, "", "c ab " * 50 + "x" * 400, "ab"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    inside = np.ones(256, bool)
    inside[[32, 9, 10]] = False

    def hashed():
        out = []
        for rows, data, ends in wordhash.texts(batch, 0, 64):
            start, stop = wordhash.words(data, inside)
            h = wordhash.hashes(data, start, stop)
            at = np.searchsorted(ends, start, side="right") + rows.start
            out += zip(at.tolist(), [data[a:z].tobytes().decode() for a, z in zip(start, stop)], h.tolist())
        return out

    got = hashed()
    assert [(r, w) for r, w, _ in got] == [(r, w) for r, t in enumerate(texts) for w in (t or "").translate(LOWER).split()]
    assert len({h for _, _, h in got}) == len({w for _, w, _ in got}) == len({(w, h) for _, w, h in got})
    monkeypatch.setattr(wordhash, "CHUNK", 64)  # long texts are hashed a stretch at a time
    assert hashed() == got


@pytest.mark.parametrize("most", [1 << 26, 1 << 8])
def test_a_filter_has_all_its_keys(spark, monkeypatch, most):
    monkeypatch.setattr(wordhash, "MOST_BITS", most)
    keys = [(random.Random(i).getrandbits(64) - (1 << 63),) for i in range(3000)]
    f = wordhash.Filter.of(spark.createDataFrame([*keys, (None,)], "k long")).value
    assert f.has(np.array([k for k, in keys], np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert f.has(others).mean() < 0.02 if most > 1 << 20 else True


# --- suffix automata ---


@pytest.mark.parametrize("seed", range(4))
def test_suffix_automaton(seed):
    rng = random.Random(seed)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 12))]
    deep = 5
    symbols = np.array([x for s in seqs for x in s])
    depth = np.concatenate([np.minimum(np.arange(1, len(s) + 1), deep) for s in seqs])
    a = SuffixAutomaton(symbols, depth)
    want, ends = Counter(), defaultdict(set)
    for k, s in enumerate(seqs):
        for j in range(len(s)):
            for n in range(1, min(deep, j + 1) + 1):
                want[tuple(s[j - n + 1 : j + 1])] += 1
                ends[tuple(s[j - n + 1 : j + 1])].add((k, j))
    got = [(tuple(symbols[e - n + 1 : e + 1].tolist()), c) for cols in a.substrings() for e, n, c in zip(*(x.tolist() for x in cols))]
    assert len(got) == len(want) and dict(got) == want
    # states are the classes of equal ends, links lead to the longest suffix that ends elsewhere too
    assert len(a.count) == len({frozenset(e) for e in ends.values()})
    for k in range(len(a.count)):
        word = tuple(symbols[a.end[k] - a.longest[k] + 1 : a.end[k] + 1].tolist())
        same = [w for w in (word[i:] for i in range(len(word))) if ends[w] == ends[word]]
        assert len(same[-1]) == a.shortest[k]
        up = word[len(word) - a.shortest[k] + 1 :]
        assert (a.link[k] == -1) == (not up)
        if up:
            j = a.link[k]
            assert tuple(symbols[a.end[j] - a.longest[j] + 1 : a.end[j] + 1].tolist()) == up


def test_no_symbols():
    a = SuffixAutomaton(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(a.count) and not list(a.substrings())


# --- collocations ---


def brute_phrases(rows, longest=5, least=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cands = {p for p, a in f.items() if a >= least and len(p) > 2}
    inner = {(p[0], *p[i:j]) for p in cands for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and f[(p[0], *p[i:j])] <= f[p]}
    out = []
    for p in cands - inner:
        a, lang = f[p], p[0]
        score, k = min((1000 * a * n[lang] // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
        out.append((lang, -score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])], n[lang]))
    rank, got = Counter(), []
    for lang, s, a, phrase, left, r, total in sorted(out):
        rank[lang] += 1
        if top is None or rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, r, total, -s))
    return sorted(got)


def _tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, filtered, top", [(3, 3, 2000), (3, 2, 2000), (5, 5, 7)])
def test_collocations(spark, monkeypatch, least, filtered, top):
    monkeypatch.setattr(collocations, "COMBINE", 50)
    monkeypatch.setattr(collocations, "ROWS", 7)
    monkeypatch.setattr(collocations, "SHARD", 300)
    rng = random.Random(least)
    rows = [(" ".join(rng.choice(["the", "of", "New", "york", "CITY", "é", "日本", "x.", "y,z", "a\tb", "line\n"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(200)]
    rows += [("deep blue sea of calm waters", "en")] * 9 + [(None, "en"), ("", None)]
    docs = spark.createDataFrame([(t, g, *MORE) for t, g in rows], f"text string, lang string, {EXTRA}")
    single, phrases = collocations.phrase_counts(docs, 5, least, filtered)
    assert phrases.df.where("phrase like 'deep blue sea%'").count() == 3
    assert _tuples(collocations.collocations(docs, least=least, top=top)) == brute_phrases(rows, least=least, top=top)


def test_large_products_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    a, n, left, r = 3_000_000_007, 20_000_000_000_033, 5_000_000_011, 4_000_000_019
    counts = {"single": [("en", "x", left), ("en", "y", r), ("en", "z", n - left - r)], "phrases": [("en", "x y", a)]}

    class Held:
        def __init__(self, rows):
            self.df = spark.createDataFrame(rows, "lang string, phrase string, n long")

    monkeypatch.setattr(collocations, "phrase_counts", lambda *_, **__: (Held(counts["single"]), Held(counts["phrases"])))
    docs = spark.createDataFrame([], "text string, lang string")
    assert _tuples(collocations.collocations(docs)) == [("en", 1, "x y", a, left, r, n, 1000 * a * n // (left * r))]


def test_collocation_edges(spark):
    kinds = "text string, lang string"
    assert _tuples(collocations.collocations(spark.createDataFrame([], kinds))) == []
    assert _tuples(collocations.collocations(spark.createDataFrame([(None, None), ("", ""), (" ,.\n", "en")], kinds))) == []
    long = " ".join(f"w{i % 7}" for i in range(60_000))
    assert _tuples(collocations.collocations(spark.createDataFrame([(long, "en")], kinds))) == brute_phrases([(long, "en")])


def test_phrase_query(spark, sf):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _tuples(registry.queries()["op12_suffix_automaton_phrases"](spark, sf)) == brute_phrases(rows)


# --- hard negatives ---


def brute_negatives(rows, anchors, positives=5, negatives=5):
    out = []
    for i, label, v in (r for r in rows if anchors(r[0])):
        score = [(-sum(x * y for x, y in zip(v, w)), j, g) for j, g, w in rows if j != i]
        for s, j, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fit = sorted(x for x in score if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(i, j, k, m, -s, -t) for k, (t, m, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("cell, pairs, dim", [(32_768, 1 << 19, 64), (40, 300, 3), (40, 300, 70)])
def test_hard_negatives(spark, monkeypatch, cell, pairs, dim):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "PAIRS", pairs)
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, dim)) * rng.choice([0.01, 1, 30], (300, 1))
    x[40:80] = x[40]  # ties, across labels
    x[100] = 0
    labels = rng.integers(0, 3, 300)
    rows = [(i * 5, int(labels[i]), x[i].tolist(), *MORE) for i in range(300)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<double>, {EXTRA}"), wordhash.F.col("id") % 50 == 0)
    whole = [(i, g, [int(np.floor(256 * c)) for c in v]) for i, g, v, *_ in rows]
    want = brute_negatives(whole, lambda i: i % 50 == 0)
    assert _tuples(got) == want and len(want) > 50


def test_bit_planes():
    v = np.random.default_rng(3).integers(-300, 300, (50, 70))
    p = hard_negatives.slice_planes(v, 10)
    weights = hard_negatives._weights(10)
    back = sum(w * np.unpackbits(np.ascontiguousarray(p[k].T).view(np.uint8), axis=1, bitorder="little")[:, :70].astype(int) for k, w in enumerate(weights))
    assert (back == v).all() and p.shape == (10, 2, 50)


def test_hard_negative_edges(spark):
    kinds = f"vec_id long, label int, embedding array<float>, {EXTRA}"
    nan, inf = float("nan"), float("inf")
    f = lambda rows: _tuples(hard_negatives.hard_negatives(spark.createDataFrame([(*r, *MORE) for r in rows], kinds), wordhash.F.col("id") % 100 == 0))
    assert f([]) == [] and f([(100, 1, [1.0, 2.0])]) == [] and f([(1, 1, [1.0])]) == [] and f([(0, 0, [0.0, 0.0]), (1, 0, [0.0, 0.0]), (2, 1, [0.0, 0.0])]) == [(0, 1, 1, 2, 0, 0)]
    bad = [(None, 1, [1.0, 1.0]), (7, None, [1.0, 1.0]), (8, 1, None), (9, 1, [1.0, None]), (10, 1, [nan, 1.0]), (11, 2, [inf, 1.0]), (12, 2, [1.0]), (13, 2, [1e30, 1.0])]
    good = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [0.5, 0.0]), (4, 2, [1.01, 0.0]), (5, 3, [0.9, 0.5]), (5, 3, [0.9, 0.5])]
    assert f(bad + good) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 5, 65536, 58880)]
    # a negative product has no negatives, whatever they score
    assert f([(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.9]), (3, 2, [0.5])]) == []


def test_hard_negative_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(c))) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert _tuples(registry.queries()["op11_bit_sliced_hard_negatives"](spark, sf)) == brute_negatives(rows, lambda i: i % 100 == 0)


# --- decontamination ---


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_hits(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = _words(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, named = _words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    named |= wins[tuple(w[k : k + n])]
        named = sorted(str(x) for x in named if x is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _hits(spark, docs, items, **k):
    d = spark.createDataFrame([(*r, *MORE) for r in docs], f"doc_id long, text string, {EXTRA}")
    i = spark.createDataFrame([(*r, *MORE) for r in items], f"item_id long, text string, {EXTRA}")
    got = decontaminate.decontaminate(d, i, **k).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got), key=str)


@pytest.mark.parametrize("few", [0, 100_000])
def test_decontaminate(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
    monkeypatch.setattr(decontaminate, "COMBINE", 20)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "a-b", "x_y"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(25)] + [(3, text(12)), (None, text(14)), (90, None), (91, " .,"), (92, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(120)]
    for k in range(60):  # passages of items, whole or in part, with other separators and cases
        w = _words(items[rng.randrange(len(items))][1])
        a = rng.randrange(max(1, len(w) - 9))
        docs.append((200 + k, text(rng.randrange(9)) + ". " + "--\n".join(w[a : a + rng.randrange(8, 30)]).upper() + "!" + text(4)))
    docs += [(None, None), (None, docs[130][1]), (5, docs[131][1]), (5, docs[131][1]), (6, ""), (7, "w1 " * 5000 + docs[140][1] + " w2" * 5000)]
    want = brute_hits(docs, items)
    assert _hits(spark, docs, items) == want and sum(r[5] for r in want) > 60


def test_decontaminate_edges(spark):
    docs, items = [(1, "one two three"), (None, None)], [(1, "one two")]
    assert _hits(spark, [], items) == [] and _hits(spark, docs, []) == brute_hits(docs, [])
    assert _hits(spark, docs, [(1, None), (2, "..")]) == brute_hits(docs, [])
    assert _hits(spark, docs, items) == brute_hits(docs, items)
    assert _hits(spark, docs, items, window=1) == brute_hits(docs, items, 1)


def test_containment(spark):
    """Windows of which a share of the shingles is in its place."""
    item = " ".join(f"w{i}" for i in range(10))
    w = item.split()
    one, two = " ".join([*w[:4], "X", *w[5:]]), " ".join(["X", *w[1:8], "Y", w[9]])
    docs = [(1, "a b " + item), (2, "a " + one + " b"), (3, two), (4, " ".join(w[5:] + w[:5])), (5, item[3:])]
    assert [r[2] for r in _hits(spark, docs, [(1, item)])] == [10, 0, 0, 0, 0]
    # of 8 shingles 5, and 5, are left when one word in the midst, or the first and the last but one, are others
    assert [r[2] for r in _hits(spark, docs, [(1, item)], containment=0.6)] == [10, 10, 10, 0, 0]
    assert [r[2] for r in _hits(spark, docs, [(1, item)], containment=0.7)] == [10, 0, 0, 0, 0]


def test_decontamination_query(spark, sf):
    read = lambda t, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    got = [tuple(r) for r in registry.queries()["op13_prefix_filtered_decontamination"](spark, sf).collect()]
    assert sorted(got, key=str) == brute_hits(read("documents", "doc_id"), read("benchmark", "item_id"))


# --- packing ---


def test_waiting_documents_are_held_in_part(spark, monkeypatch):
    """Long documents whose last pieces wait leave no more than those in memory, and their pieces are right when they come."""
    import zlib

    from webweft.llm import packing

    held = []
    rest = packing.Packer.full

    def full(self):
        held.append(self.n)
        yield from rest(self)

    monkeypatch.setattr(packing.Packer, "full", full)
    monkeypatch.setattr(packing, "WAITING", 8)
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 200, 5000])))) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).collect()
    ids = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        ids.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    enc = packing.encoder(packing.default_path())
    for i, t in texts:
        parts = sorted(ids[i])
        flat, _ = enc.encode([t])
        assert [x for _, p, _ in parts for x in p] == [*flat.tolist(), 1] and {n for *_, n in parts} == {len(flat) + 1}
