"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on edge tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from webweft.llm import ann, bpe, bwt, bytebpe, deleted_lm, graph, imatch, license_scan, line_dedup, packing, quality, simhash, suffix_dedup, transducer

DOCS = "doc_id long, text string, lang string, fp long, score string, doc string, rid string, spans int, component_id int, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    texts = [(1, "the same text of some words here"), (2, "the same text of some words here"), (2, "the same text of some words here"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " end"), (None, "lost id text one two three four"), (8, "x"), (9, "Ünï çödé 日本語 🙂 <|endoftext|> it's"), (2, "another text under the same id"), (None, None)]
    return spark.createDataFrame([(i, t, "en", 1, "s", "d", "r", 2, 3, 4) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


# --- graph ---


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long"), one_task).collect()}
    assert got == {x: find(x) for x in parent if x in got} and all(x in got for x in parent if x != 7 or find(7) != 7)


# --- SimHash ---


def slow_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fp: dict, radius=2):
    ids = list(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(docs, rows):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fp = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fp
    assert {i: c for i, (_, c) in got.items()} == groups(fp)


@pytest.mark.parametrize("cap", [4096, 8])
def test_bitsliced_links_with_dense_buckets(spark, cap):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(40)} | {rng.getrandbits(64) for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), cap=cap)
    got = {r.node: r.root for r in graph.components(links).collect()}
    want = groups({x: x & (1 << 64) - 1 for x in sorted(signed)})
    assert {x: got.get(x, x) for x in signed} == want


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 7])
def test_bitsliced_distances(radius):
    rng = np.random.default_rng(radius)
    fp = (rng.integers(0, 1 << 16, 300, dtype=np.uint64) * np.uint64(0x0001000100010001)) & np.uint64(0x00FF00FF0000FFFF)
    starts = np.array([0, 1, 80, 210])
    a, b = simhash.links_in_runs(fp, starts, radius)
    run = np.searchsorted(starts, np.arange(300), side="right")
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if run[i] == run[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("cap, small", [(4096, 256), (4096, 4), (16, 256), (16, 4)])
def test_near_duplicate_texts(spark, cap, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    monkeypatch.setattr(simhash, "LEADERS", 3)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(8 if g else 60):
            t = list(base)
            for _ in range(k % 8):
                t[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", " ", "a b", "a b", "A  b"]
    data = list(enumerate(texts))
    rng.shuffle(data)
    sets = {i: (set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())}) for i, t in data}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(data, "doc_id long, text string"), cap=cap).collect()}
    assert got == {i: find(i) for i in sets}


def test_near_duplicates_with_heavily_repeated_lines(spark):
    """A line that one copy repeats often adds few distinct shingles; the copies stay similar and are found."""
    rng = random.Random(6)
    data, pairs = [], []
    for n, line, often, rarely in [(300, 10, 100, 2), (60, 5, 20, 1), (100, 10, 10, 1)]:
        for _ in range(20):
            body, line_words = ([f"w{rng.randrange(10**6)}" for _ in range(k)] for k in (n, line))
            a, b = (" ".join(body + line_words * k) for k in (often, rarely))
            sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b)]
            assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
            pairs.append(len(data))
            data += [(len(data), a), (len(data) + 1, b)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [i for i in pairs if got[i + 1] != i] == []


def test_null_ids_take_part(spark):
    """A text whose rows have no id at all links the texts on both sides of it."""
    words = [f"w{i}" for i in range(110)]
    texts = [" ".join(words), " ".join(words[:-12] + ["x"] * 12), " ".join(words[:-18] + ["y"] * 6 + ["x"] * 12)]
    df = spark.createDataFrame([(7, texts[0]), (None, texts[1]), (None, texts[1]), (9, texts[2]), (None, "alone in its group with no id")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicate_texts(df).collect()), key=str)
    assert got == sorted([(7, 7), (0, 7), (0, 7), (9, 7), (0, None)], key=str)


def test_similarity_of_large_sets(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 300, dtype=np.uint64)) for _ in range(20)]
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(20), np.arange(20)))
    want = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert simhash.Sets(sets).similarity(a, b).tolist() == pytest.approx(want)
    monkeypatch.setattr(simhash.Sets, "MOST_WORDS", 1)
    assert simhash.Sets(sets).similarity(a, b).tolist() == pytest.approx(want)


def test_a_chain_in_a_crowded_bucket(spark):
    """Texts that differ step by step, each like the next alone, in buckets that are dealt in parts: one group."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([f"c{k}x{i}" if i < 4 * (k % 25) + 4 and i >= 4 * (k % 25) - 4 else base[i] for i in range(200)]) for k in range(50)]
    data = list(enumerate(texts))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in data}
    links = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = graph.local_roots(50, np.array([i for i, _ in links], int), np.array([j for _, j in links], int))
    for cap in (4096, 6):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(data, "doc_id long, text string"), cap=cap).collect()}
        assert got == {i: int(root[i]) for i in sets}


def test_simhash_edges(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == edge.count() and {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicate_texts(empty).count() == 0
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    left = sorted((r.doc_id or -1, (r.text or "")[:12]) for r in kept.collect())
    assert [x for x in left if x[0] == 1] and not [x for x in left if x[0] in (4, 5)] and [x for x in left if x[0] == 6] and not [x for x in left if x[0] == 7]


def test_one_of_each_keeps_other_texts_of_an_id(edge):
    got = sorted(r.text for r in simhash.one_of_each(edge).where("doc_id = 2").collect())
    assert got == ["another text under the same id"]


# --- suffix dedup ---


def slow_removal(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            if s in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(s)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def removal(df, **how):
    return {r.doc_id: (r.n_bytes, sum(s.hi - s.lo for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_dedup(df, **how).collect()}


def test_suffix_dedup(docs, rows):
    assert removal(docs) == slow_removal(rows)


def test_suffix_dedup_hard_cases(spark):
    rng = random.Random(2)
    piece = "".join(rng.choice("abcde ") for _ in range(400))
    texts = [piece, piece[:99], piece[:100], piece[1:101] + "q", "x" + piece[150:260] + "y", piece[150:249], "a" * 500, "b" * 130 + "a" * 130, "ab" * 200, "ba" * 90, "é" * 120, "z" + "é" * 60, ""]
    texts += ["".join(rng.choice("ab") for _ in range(300)) + piece[k : k + 90 + k] for k in range(0, 60, 7)]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert removal(df) == slow_removal(data)
    # one passage in many near copies: contexts of crowded anchors go by longer ones
    near = []
    for i in range(60):
        t = list(piece)
        for _ in range(i % 9):
            t[rng.randrange(400)] = rng.choice("xyz")
        near.append((i, rng.choice("pq") * (i % 5) + "".join(t)))
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(3)
    want = slow_removal(near)
    assert removal(df) == want
    for many in (3, 1):
        assert removal(df, many=many) == want
    assert removal(spark.createDataFrame(data, "doc_id long, text string").repartition(5), many=1) == slow_removal(data)


@pytest.mark.parametrize("shard", [40, 170, 700, bwt.SHARD])
def test_merged_transforms(shard):
    """The transform of a shard by sorted suffixes, and repeated intervals of merged ones by counting strings."""
    rng = random.Random(shard)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) + rng.choice([b"", b"passage that is there again", b"passage that is there"]) + bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    depth = 5
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(sizes) - sizes
    begin = np.array([a + k for a, t in zip(start, texts) for k in range(len(t) - 4 * depth + 1)])
    place, block = bwt.repeated(data, sizes, begin, depth, shard)
    got = {}
    for p, b in zip(place.tolist(), block.tolist()):
        got.setdefault(b, set()).add(p)
    want = {}
    for p in begin.tolist():
        want.setdefault(data[p : p + 4 * depth].tobytes(), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    one = data[: min(len(data), 300)]
    sym = bwt.symbols(one)
    t = bwt.transform(sym, 200)
    suffix = lambda i: tuple(sym[i::4].tolist())
    assert [suffix(i) for i in t.order] == sorted(map(suffix, range(len(one))))
    assert all(t.before[k] == sym[i - 4] and t.order[t.back[k]] == i - 4 for k, i in enumerate(t.order) if i >= 4)


@pytest.mark.parametrize("shard", [400, 1_700, bwt.SHARD])
def test_merge_is_exact(shard):
    rng = random.Random(4)
    base = bytes(rng.choice(b"abc") for _ in range(164))
    contexts = [bytes(c if rng.random() > 0.01 else 100 for c in base) for _ in range(30)]
    doc, rid, lo = np.arange(30), np.zeros(30, int), np.zeros(30, int)
    seg, a, b = suffix_dedup.repeated_spans(contexts, doc, rid, lo, shard=shard)
    got = [bytearray(164) for _ in contexts]
    for s, x, y in zip(seg.tolist(), a.tolist(), b.tolist()):
        got[s][x:y] = b"\1" * (y - x)
    seen = set()
    for c, g in zip(contexts, got):
        want = bytearray(164)
        for p in range(65):
            if c[p : p + 100] in seen:
                want[p : p + 100] = b"\1" * 100
        seen |= {c[p : p + 100] for p in range(65)}
        assert g == want


def test_anchors_share_out_the_windows():
    """Each string of 100 bytes is in one context, and equal strings have equal anchors."""
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(700)), b"a" * 350, b"x" * 99, b"", b"ab" * 90, bytes(rng.randrange(256) for _ in range(1_500)), b"q" * 100]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for piece in suffix_dedup.PIECES:
        at, h, c, c2, lo, hi = suffix_dedup.anchors(data, ends, piece=piece)
        windows = [p for a, z in zip(lo, hi) for p in range(a, z - 99)]
        assert sorted(windows) == [e - len(t) + k for t, e in zip(texts, ends) for k in range(len(t) - 99)]
        of = {}
        for k, (i, a, z) in enumerate(zip(at, lo, hi)):
            assert a <= i and i + piece <= a + 100 and i >= z - 100 and i - a < 128 and z - i < 128
            for p in range(a, z - 99):
                assert of.setdefault(data[p : p + 100].tobytes(), h[k]) == h[k]
        by = {}
        for k in range(len(at)):
            assert by.setdefault((h[k], c[k], c2[k]), data[lo[k] : hi[k]].tobytes()) == data[lo[k] : hi[k]].tobytes()


def test_least_id_and_null_are_apart(spark):
    text = "one text of more than a hundred bytes that stands in several documents, of which some have no id at all and one has the least"
    df = spark.createDataFrame([(-(1 << 63), text), (None, text), (5, text), (6, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, len(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()), key=str)
    assert [g[1] for g in got if not g[0]] == [-(1 << 63), 5, 6] and sum(g[2] > 50 for g in got) == 1
    assert suffix_dedup.without_repeats(df.withColumn("n_chars", F.length("text"))).count() == 4


def test_suffix_edges(edge, empty):
    got = suffix_dedup.suffix_dedup(edge).collect()
    assert len(got) == edge.count() and {r.n_bytes for r in got if r.doc_id in (3, 4)} == {0}
    long = {r.doc_id: r for r in got if r.doc_id in (6, 7)}
    assert len(long[7].kept) < 200 and len(long[6].kept) > 100_000
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    clean = suffix_dedup.without_repeats(edge)
    assert clean.columns == edge.columns and clean.count() == edge.count()


def test_whole_characters():
    text = "aéb日c"
    raw = text.encode()
    for lo in range(len(raw)):
        for hi in range(lo, len(raw) + 1):
            kept = suffix_dedup.whole_characters(text, [(lo, hi)])
            assert all(c in text for c in kept) and len(kept.encode()) >= len(raw) - (hi - lo)
    assert suffix_dedup.whole_characters(text, [(1, 3)]) == "ab日c"


# --- BPE ---

TOKENIZER = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tok():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def hard_texts():
    rng = random.Random(9)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x300), rng.randrange(0x300, 0xD7FF), 9, 10, 32, 32, 39, 0x1F600 + rng.randrange(80)]))
    return ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "it's I'll ''s 'S don't", "a" * 700, "ab" * 400 + " " * 50 + "\n\n x", "日本語 １２３ ²½ⅷ", "\x1c\x1d\x85\xa0 z", *("".join(pick() for _ in range(rng.randrange(80))) for _ in range(200))]


def test_encoder_equals_library(tok, rows):
    enc = bytebpe.Encoder(bytebpe.load(bpe.default_path()))
    texts = hard_texts() + [t for _, t in rows[:60]]
    flat, at = enc.encode(texts)
    for t, a, b in zip(texts, at, at[1:]):
        assert flat[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t[:60]


def test_transducer(tmp_path):
    words = sorted({f"{a}{b}{c}".encode() for a in ("", "un", "re") for b in ("do", "work", "é") for c in ("", "s", "ing")})
    ids = [np.arange(i % 4, dtype="<u4").tobytes() for i in range(len(words))]
    (tmp_path / "t").write_bytes(transducer.build(words, ids))
    t = transducer.Transducer(str(tmp_path / "t"))
    assert t.lookup(words) == ids and t.lookup([b"", b"und", b"undoings", b"zz"]) == [None] * 4
    assert len(t.final) < sum(map(len, words)) / 3  # suffixes are shared
    (tmp_path / "e").write_bytes(transducer.build([], []))
    assert transducer.Transducer(str(tmp_path / "e")).lookup([b"a"]) == [None]


def test_round_trip(spark, edge, empty, tok):
    got = bpe.bpe_encode(edge, decode=True, words=50)
    pairs = [(r.ids, r.decoded) for r in got.collect()]
    texts = [r.text or "" for r in edge.select("text").collect()]
    assert sorted(pairs) == sorted((tok.encode(t, add_special_tokens=False).ids, t) for t in texts)
    back = bpe.bpe_decode(got.select("doc_id", "ids"))
    assert sorted(r.text for r in back.collect()) == sorted(texts)
    assert bpe.bpe_encode(empty).count() == 0


# --- packing ---


def check_pieces(pieces, tok, texts, windows=(2048, 1024, 512, 256)):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.ids == ids[at : at + p.length].tolist()
            at += p.length
        assert at == len(ids)
    padding = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(docs, rows, tok, edge, empty):
    assert check_pieces(packing.pack(docs).collect(), tok, dict(rows)) == 0
    one = edge.where("doc_id is not null and doc_id <> 2")
    check_pieces(packing.pack(one).collect(), tok, {r.doc_id: r.text for r in one.collect()})
    assert packing.pack(edge).where("start = 0").count() == edge.count()
    assert packing.pack(empty).count() == 0


def test_step_groups_are_even(docs):
    got = packing.pack(docs, with_ids=False).dropDuplicates(["sequence_id"]).groupBy("step_group").agg(F.sum("window").alias("n")).collect()
    assert max(r.n for r in got) <= packing.STEP_TOKENS


def test_step_groups_of_many_batches(monkeypatch):
    """Groups that close between batches: their numbers are not given again, and open ones are filled."""
    monkeypatch.setattr(packing, "WAITING", 20)
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 1})()))
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "word", "of", "tokens"]) for _ in range(rng.choice([100, 250, 500, 700, 1020, 1500, 2040]))) for _ in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 30), pa.int64()), pa.array(texts[i : i + 30])], names=["doc_id", "text"]) for i in range(0, 3000, 30)]
    size, group = {}, {}
    for b in packing._pack(packing.default_path(), 1, packing.TIERS, False)(iter(batches)):
        for r in b.to_pylist():
            size[r["sequence_id"]], group[r["sequence_id"]] = r["window"], r["step_group"]
    total = Counter()
    for s, n in size.items():
        total[group[s]] += n
    assert len(total) > 20 and max(total.values()) <= packing.STEP_TOKENS


# --- quality ---


def test_quality_held_out(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.trained_on_folds(docs, labels)
    got = quality.quality_scores(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(edge, model).count() == edge.count() and quality.quality_scores(empty, model).count() == 0
    kept = quality.quality_filter(edge, model)
    assert kept.columns == edge.columns
    none = quality.train(docs.limit(0), labels)
    assert {r.score for r in quality.quality_scores(edge, none).collect()} == {0.5}


def test_quality_query(spark, sf, docs, rows):
    """The query's rows by one document after another; the model by plain descent on the pairs' logistic loss."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(i, t) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([quality.features(t) for _, t in own]), np.array([labels[i] for i, _ in own])
    order = np.lexsort((*x.T, y))
    model = quality.fit_pairs(x[order], y[order])
    got = {r.doc_id: r for r in quality.op4_quality_classifier(spark, sf).collect()}
    for i, t in rows:
        score = float(model.score(np.array([quality.features(t)]))[0])
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == (score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    good, bad = np.flatnonzero(y[order] == 1), np.flatnonzero(y[order] == 0)
    z = (x[order] - model.mean) / model.scale
    rng = np.random.default_rng(7)
    diff = z[rng.choice(good, quality.PAIRS)] - z[rng.choice(bad, quality.PAIRS)]
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 0.5e-3 * w @ w
    best = loss(model.weights)
    for k in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            assert loss(model.weights + step * np.eye(len(model.weights))[k]) >= best
    below = np.mean(z @ model.weights < model.threshold)
    assert below == pytest.approx(np.mean(y == 0), abs=1 / len(y))


def test_training_takes_one_text_for_an_id(spark):
    docs = spark.createDataFrame([(1, f"many words of one id {k}") for k in range(50)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, 5), (1, 1)], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(docs.repartition(7), labels)
    assert (a.weights == b.weights).all() and a.threshold == b.threshold and (a.mean == b.mean).all()


def test_bradley_terry_orders():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    label = (x[:, 0] - 2 * x[:, 2] > 0).astype(int)
    m = quality.fit_pairs(x, label)
    assert ((m.score(x) >= 0.5) == label).mean() > 0.97 and abs(m.weights[1]) < abs(m.weights[2])


# --- language model ---


def slow_lm(rows, learns):
    """Counts of words, pairs and triples, and weights by EM without binning, each training document under the others."""
    tok = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in rows}
    chain = {i: list(zip(["start", (None, x[0]), *zip(x, x[1:])], [None, *x], x)) for i, x in tok.items()}
    c, c2, c3, ctx = Counter(), Counter(), Counter(), Counter()
    for i in tok:
        if learns(i):
            for g, h, w in chain[i]:
                c[w] += 1
                c2[h, w] += 1
                c3[g, w] += 1
                ctx[g] += 1
    n, v = sum(c.values()), len(c)
    bucket = lambda x: int(deleted_lm._bucket(np.array([x]))[0])
    share = lambda a, b: a / b if b else 0.0
    seen = []
    for i in tok:
        if learns(i):
            own = [Counter(x) for x in (tok[i], [(h, w) for _, h, w in chain[i]], [(g, w) for g, _, w in chain[i]], [g for g, _, _ in chain[i]])]
            rest = n - len(tok[i])
            seen += [(c[h] - own[0][h], c2[h, w] - own[1][h, w], (c[w] - own[0][w]) / max(rest, 1), ctx[g] - own[3][g], c3[g, w] - own[2][g, w]) for g, h, w in chain[i]]
    weights, shares = {}, {}
    for k in {bucket(x[0]) for x in seen}:
        p = np.array([(share(x[1], x[0]), x[2], 1 / (v + 1)) for x in seen if bucket(x[0]) == k])
        w = np.array([0.4, 0.4, 0.2]) if k else np.array([0.0, 0.8, 0.2])
        for _ in range(deleted_lm.ROUNDS):
            post = p * w
            w = (post / post.sum(1, keepdims=True)).mean(0)
        weights[k] = w
    for k in {bucket(x[3]) for x in seen} - {0}:
        own = [x for x in seen if bucket(x[3]) == k]
        high = np.array([share(x[4], x[3]) for x in own])
        low = np.array([weights[bucket(x[0])] @ [share(x[1], x[0]), x[2], 1 / (v + 1)] for x in own])
        y = 0.5
        for _ in range(deleted_lm.ROUNDS):
            y = (y * high / (y * high + (1 - y) * low)).mean()
        shares[k] = y

    def p(g, h, w):
        if bucket(c[h]) not in weights or (bucket(ctx[g]) not in shares and ctx[g]):
            return None
        low = weights[bucket(c[h])] @ [share(c2[h, w], c[h]), share(c[w], n), 1 / (v + 1)]
        y = shares.get(bucket(ctx[g]), 0.0)
        return y * share(c3[g, w], ctx[g]) + (1 - y) * low

    return tok, chain, c, n, v, p


def test_language_model(docs, rows):
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    got = {r.doc_id: r for r in deleted_lm.lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect()}
    tok, chain, c, n, v, p = slow_lm(rows, learns)
    told = 0
    for i, _ in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok[i]), sum(c[w] > 0 for w in tok[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok[i]), rel=1e-9)
        each = [p(*x) for x in chain[i]]
        if None not in each:
            assert r.score == pytest.approx(sum(map(math.log10, each)), rel=0.02)
            told += 1
    assert told > 0.9 * len(rows)
    held = [r for i, r in got.items() if not learns(i)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    """Of all words that may follow one context, the end and one unknown word among them."""
    rows = [(1, "a b a c"), (2, "a b b"), (3, "c a"), (4, "a b a"), (5, "b c")]
    words = ["a", "b", "c", "unknown"]
    before = ["", "a ", "a b ", "b c "]
    asked = [(100 + 10 * k + j, f"{h}{w}") for k, h in enumerate(before) for j, w in enumerate(words)] + [(100 + 10 * k + 9, h) for k, h in enumerate(before)]
    got = {r.doc_id: r.score for r in deleted_lm.lm_scores(spark.createDataFrame(rows + asked, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert all(x < 0 and math.isfinite(x) for x in got.values())
    _, _, c, n, v, p = slow_lm(rows, lambda i: True)
    assert n == sum(len(t.split()) + 1 for _, t in rows) and v == 4
    for g, h in (("start", None), ((None, "a"), "a"), (("a", "b"), "b"), (("b", "c"), "c")):
        assert sum(p(g, h, w) for w in [*words, None]) == pytest.approx(1.0)


def test_a_text_that_occurs_twice_is_told_apart(spark):
    """Words that are frequent everywhere, in an order that two documents share."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    twin = " ".join(rng.choice(words) for _ in range(60))
    rows = list(enumerate([*texts, twin, twin]))
    got = {r.doc_id: r.score / r.n_tokens for r in deleted_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 0).collect()}
    held = [got[i] for i in range(150) if i % 5 == 0]
    assert got[150] > max(held) and got[150] > np.mean(held) + 4 * np.std(held)


def test_lm_edges(edge, empty):
    got = deleted_lm.lm_scores(edge, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == edge.count() and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert deleted_lm.lm_scores(empty, F.lit(True)).count() == 0
    alone = deleted_lm.lm_scores(edge, F.lit(None).cast("boolean")).collect()
    assert {r.train_tokens for r in alone} == {0} and all(math.isfinite(r.score) for r in alone)


def test_large_slices_are_added_up_in_ranges(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)[rng.integers(0, 500, 3_000)]
    monkeypatch.setattr(deleted_lm, "RANGE", 400)
    parts = [np.arange(len(h))[own] for own in deleted_lm._ranges(h)]
    assert len(parts) == 8 and sorted(np.concatenate(parts).tolist()) == list(range(3_000))
    assert sum(len(set(h[p].tolist())) for p in parts) == len(set(h.tolist()))


def test_packed_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 8, 300):
        h = np.sort(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        c = rng.integers(0, [1, 300, 70_000][n % 3], n)
        a, b = deleted_lm._unpack(deleted_lm._pack(h, c))
        assert (a == h).all() and (b == c).all()


def test_keys_are_sorted_with_their_places():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.int64), rng.integers(0, 50, 400), rng.integers(0, 1 << 40, 400).repeat(3), rng.integers(0, 1 << 62, 400).repeat(2)):
        distinct, at = deleted_lm._numbered(keys)
        want, places = np.unique(keys, return_inverse=True)
        assert (distinct == want).all() and (at == places).all()
    # a slice's hashes, of which some differ in the bits that their places take
    h = rng.integers(0, 1 << 44, 500, dtype=np.uint64)[rng.integers(0, 500, 3_000)] + rng.integers(0, 4, 3_000, dtype=np.uint64)
    order, first = deleted_lm._grouped(h)
    assert sorted(order.tolist()) == list(range(3_000)) and first.sum() == len(set(h.tolist()))
    assert all((h[order[a:b]] == h[order[a]]).all() for a, b in zip(np.flatnonzero(first), [*np.flatnonzero(first)[1:], 3_000]))


def test_keys_are_numbered_faster_than_by_argsort():
    keys = np.random.default_rng(1).integers(0, 1 << 34, 400_000)

    def least(f):
        took = []
        for _ in range(5):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: deleted_lm._numbered(keys)) < 0.8 * least(lambda: np.unique(keys, return_inverse=True))


def test_blocks_of_odd_texts():
    texts = ["", " \t\n", " B a\x0bA\x0c", "a\u00a0B \x1c\u00c9 \u00e9", "x" * 300 + "\r\nx"]
    block = deleted_lm.Block.of(list(range(5)), pa.array(texts), np.ones(5, dtype=bool))
    want = [[*t.encode().lower().split(), b" "] for t in texts]
    hashes = [xxhash.xxh64_intdigest(w) for ws in want for w in ws]
    assert block.sizes.tolist() == [len(ws) for ws in want] and block.words[block.tokens].tolist() == hashes
    assert (deleted_lm._unsqueeze(deleted_lm._squeeze(block.tokens)) == block.tokens).all()
    big = np.array([0, 1 << 24, (1 << 31) - 1], dtype=np.int32)
    assert (deleted_lm._unsqueeze(deleted_lm._squeeze(big)) == big).all()


# --- nearest neighbours ---


def recall(spark, x, ids, got, k=20):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:k]].tolist()
        own = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, k + 1)) and len({r.vec_id for r in own}) == k
        assert all(r.score == pytest.approx(s[ids == r.vec_id][0], abs=1e-12) for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hits += len(set(best) & {r.vec_id for r in own})
        total += k
    return hits / total


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_ann(spark, sf, table):
    e = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    data = e.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in data], dtype=float)
    ids = np.array([r.vec_id for r in data])
    assert recall(spark, x, ids, ann.nearest_neighbours(e, F.col("id") % 20 == 0).collect()) >= 0.9


def test_ann_in_many_cells(spark, monkeypatch):
    """Clustered vectors of differing length; lists in parts, several blocks of queries, few lists probed."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24)) * 2
    x = centres[rng.integers(0, 30, 6_000)] + rng.standard_normal((6_000, 24)) * 0.6
    x[:1_500] = centres[0] + rng.standard_normal((1_500, 24)) * 0.05
    ids = rng.permutation(6_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(8)
    monkeypatch.setattr(ann, "GROUP_VECTORS", 1_024)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 100)
    assert recall(spark, x, ids, ann.nearest_neighbours(df, F.col("id") % 20 == 0, least_probes=4).collect()) >= 0.9
    # lists that hold fewer than k: such a query looks through all of them
    got = ann.nearest_neighbours(df.where("vec_id < 90"), F.col("id") % 20 == 0, k=60, target=0.0, least_probes=1).collect()
    assert recall(spark, x[ids < 90], ids[ids < 90], got, 60) >= 0.9


def test_ann_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [float("inf"), 0.0]), (1, [1.0, 0.0]), (9, [-2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 9, -2.0), (20, 1, 9, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


# --- I-Match ---


def slow_imatch(texts, common=imatch.COMMON, rare=imatch.RARE):
    """Fingerprints of texts, by document frequencies in a counter and sets of terms."""
    import struct

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def terms(t):
        return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", t.lower()) if w}

    def digest(hs):
        h = 42
        for x in sorted(hs):
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
        return signed(h) ^ 42

    sets = [terms(t) for t in texts]
    df = Counter(h for s in sets for h in s)
    n = len(texts)
    band = {h for h, k in df.items() if max(2, rare * n) <= k <= max(2, common * n)}
    bits = min(max(imatch.BITS[0], len(band).bit_length() + imatch.SLACK), imatch.BITS[1])
    slots = {h & ((1 << bits) - 1) for h in band}
    out = []
    for s in sets:
        lex = {h for h in s if h & ((1 << bits) - 1) in slots}
        out.append([digest(lex or s), *(digest({h for h in lex if h & m == m}) & 0xFFFFFF for m in imatch.masks()[1:])])
    return out, band, df


def slow_likeness(a, b):
    if a == b:
        return 1.0
    best, at = 0.0, 0
    for _, n in imatch.DENSITIES:
        filled = [(x, y) for x, y in zip(a[at : at + n], b[at : at + n]) if x or y]
        if len(filled) >= imatch.LEAST_FILLED:
            best = max(best, sum(x == y for x, y in filled) / len(filled))
        at += n
    return best


def test_imatch(spark, docs, rows, edge, empty):
    want, band, df = slow_imatch([t or "" for _, t in rows])
    assert 0 < len(band) < len(df)
    got = {r.doc_id: list(r.fp) for r in imatch.imatch_fingerprints(docs).collect()}
    assert got == {i: fp for (i, _), fp in zip(rows, want)}
    texts = [r.text or "" for r in edge.collect()]
    want, _, _ = slow_imatch(texts)
    got = imatch.imatch_fingerprints(edge).collect()
    assert sorted((r.text, list(r.fp)) for r in got) == sorted((t, fp) for t, fp in zip(texts, want)) and imatch.imatch_fingerprints(empty).count() == 0
    assert all(not any(r.fp) for r in got if not r.text.strip())


def test_likeness(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        a = [rng.randrange(3) for _ in range(sum(n for _, n in imatch.DENSITIES))]
        pairs.append((a, [x if rng.random() < 0.6 else rng.randrange(3) for x in a]))
    pairs.append((pairs[0][0], pairs[0][0]))
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<long>, b array<long>").coalesce(1).select(imatch.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([slow_likeness(a, b) for a, b in pairs])


def test_ranges(spark, monkeypatch):
    ids = sorted(random.Random(1).sample(range(-(10**12), 10**12), 3_000))
    rows = spark.createDataFrame([(i,) for i in ids], "__id long").repartition(5)
    monkeypatch.setattr(imatch, "COARSE", 8)
    cuts = imatch._cuts(rows, 60)
    assert 40 <= len(cuts) <= 64
    got = {r["__id"]: r.k for r in rows.select("__id", imatch._range_of(F.col("__id"), cuts).alias("k")).collect()}
    assert got == {i: sum(c < i for c in cuts) for i in ids} and max(Counter(got.values()).values()) < 150


def test_next_rows(spark, edge):
    rows = [(i, f"t{i}") for i in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    old, imatch.RANGE_DOCS = imatch.RANGE_DOCS, 20
    try:
        got = {r.doc_id: r.next_text for r in imatch.with_next(df, ["text"]).collect()}
        ties = imatch.with_next(edge.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"]).collect()
        assert imatch.with_next(df.limit(0), ["text"]).count() == 0
    finally:
        imatch.RANGE_DOCS = old
    assert got == {i: f"t{(i + 3) % 900}" for i, _ in rows}
    order = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in edge.collect()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.next_text) for r in ties) == sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


def test_imatch_query(spark, sf, rows):
    got = {r.doc_id: r for r in imatch.op6_imatch_fingerprints(spark, sf).collect()}
    texts = [t or "" for _, t in rows]
    fps, band, _ = slow_imatch(texts)
    show = lambda fp: f"{fp[0] & 0xFFFFFFFFFFFFFFFF:016x}" + "".join(f"{x:06x}" for x in fp[1:])
    for k, (i, t) in enumerate(rows):
        nxt = (k + 1) % len(rows)
        h = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + texts[nxt][:h]).encode()).hexdigest()
        assert got[i].fingerprint == show(fps[k]) and got[i].near_next == pytest.approx(slow_likeness(fps[k], fps[nxt]))
        assert got[i].near_edited == 1.0 or got[i].fingerprint != got[i].edited_fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 10 * np.mean([r.near_next for r in got.values()])


# --- lines and licences ---


def test_line_dedup_edges(spark, edge, empty):
    got = line_dedup.line_dedup(edge)
    assert got.count() == edge.count() and line_dedup.line_dedup(empty).count() == 0
    df = spark.createDataFrame([(2, "One two three four FIVE\nshort\n x  one two three four five"), (1, "one two  three four five\nshort\nother words to be kept here"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert rows[1].removed == [] and [(s.start, s.end) for s in rows[2].removed] == [(0, 23)] and rows[2].kept == "short\n x  one two three four five"
    assert rows[3].n_units == 1 and rows[3].kept == "" and rows[2].n_removed == 1
    para = spark.createDataFrame([(1, "a b c d e\nf\n\nsame words in this one"), (2, "same words\nin this one\n\nz")], "doc_id long, text string")
    assert [r.kept for r in line_dedup.line_dedup(para, by="paragraph").orderBy("doc_id").collect()] == ["a b c d e\nf\n\nsame words in this one", "z"]


def slow_passages(rows, least=25):
    """Sentences of each text that lie in a passage which stands earlier, by the words of all passages there are."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        at, gone = line_dedup.units(t or "", "passage"), set()
        words = [re.findall("[^\x20\x09-\x0d]+", t[a:z].lower()) for a, z in at]
        runs = set()
        for lo in range(len(at)):
            enough = [hi for hi in range(lo, len(at)) if sum(map(len, words[lo : hi + 1])) >= least]
            if enough:
                runs.add((lo, enough[0]))
                if sum(map(len, words[lo + 1 :])) < least:
                    runs.add((lo, len(at) - 1))
        for lo, hi in sorted(runs):
            key = " ".join(x for w in words[lo : hi + 1] for x in w)
            if seen.setdefault(key, (i, lo)) != (i, lo):
                gone.update(range(lo, hi + 1))
        out[i] = (gone, "".join(t[a:z] for k, (a, z) in enumerate(at) if k not in gone))
    return out


def test_passages(spark, sf, rows):
    want = slow_passages(rows)
    got = {r.doc_id: r for r in line_dedup.op3_line_dedup(spark, sf).collect()}
    assert {i: (r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (len(gone), hashlib.sha256(kept.encode()).hexdigest()) for i, (gone, kept) in want.items()}
    assert sum(len(gone) > 0 for gone, _ in want.values()) > 10


def test_passages_hard_cases(spark, edge, empty):
    passage = "This one. " + " ".join(f"Sentence {i} of a passage!" for i in range(8)) + " Its end."
    apart = [f"Sentence {i} of a passage!" for i in range(8)]
    texts = [passage, f"Words before it {passage.upper()} and after.", "\n".join(apart[:4]), "one two " * 40, "one two " * 40, "", None, "x. " * 60, passage.replace(" ", "\n \t"), " " + passage + " "]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), "passage").collect()}
    want = slow_passages([(i, t or "") for i, t in rows])
    assert {i: (r.n_removed, r.kept) for i, r in got.items()} == {i: (len(gone), kept) for i, (gone, kept) in want.items()}
    assert got[1].kept == "WORDS BEFORE IT THIS ONE. ".replace("WORDS BEFORE IT", "Words before it") + "ITS END. and after." and got[2].n_removed == 0 and got[4].kept == "" and got[7].kept == "x. "
    for r in got.values():
        t = texts[r.doc_id] or ""
        assert r.kept == "".join(t[a:z] for a, z in zip([0, *(s.end for s in r.removed)], [*(s.start for s in r.removed), len(t)]))
    assert line_dedup.line_dedup(edge, "passage").count() == edge.count() and line_dedup.line_dedup(empty, "passage").count() == 0
    twice = {(r.doc_id, r.kept == "") for r in line_dedup.line_dedup(edge, "passage").where("doc_id in (6, 7)").collect()}
    assert twice == {(6, False), (7, False)}


def test_license_scan(spark, edge, empty):
    rows = [(1, "text\nReleased under the MIT license\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed to drive a car under the bridge"), (4, "this work IS   licensed under the GNU general public license version 2"), (None, "All rights reserved."), (1, "text\nReleased under the MIT license\nmore")]
    got = sorted((r.doc_id or 0, r.start_word, r.n_words, r.license) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 3, "reserved"), (1, 1, 5, "MIT"), (1, 1, 5, "MIT"), (2, 0, 12, "GPL-3.0"), (4, 0, 12, "GPL-2.0")]
    assert license_scan.license_scan(edge).count() == 0 and license_scan.license_scan(empty).count() == 0


def test_license_whatever_the_layout(spark):
    """The grant wrapped in a longer text, six times over, in a comment block with a long rule, and whole licences."""
    grant = license_scan.NOTICES[18][1]
    w = grant.split()
    wrapped = [" ".join(w[i : i + 11]) for i in range(0, len(w), 11)]
    prose = " ".join(f"word{i}" for i in range(4_000))
    texts = [f"{prose}\n" + "\n".join(wrapped) + f"\n{prose}", " ".join([grant] * 6), "/*" + "-" * 3_000 + "\n * " + "\n * ".join(wrapped) + "\n*/"]
    texts += [f"{prose}\n# {text}\n{prose}" for _, text in license_scan.TEXTS]
    got = {}
    for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.n_words, r.license, r.dice))
    n = len(re.sub("[^a-z0-9]+", " ", grant.lower()).split())
    assert got[0] == [(4_000, n, "MIT", 1.0)] and got[2] == [(0, n, "MIT", 1.0)] and sorted(got[1]) == [(k * n, n, "MIT", 1.0) for k in range(6)]
    for i, (name, text) in enumerate(license_scan.TEXTS):
        ((start, n_words, found, dice),) = got[3 + i]
        # a last bigram that the run has already adds nothing
        n = len(re.sub("[^a-z0-9]+", " ", text.lower()).split())
        assert (start, found, dice) == (4_000, name, 1.0) and n - 2 <= n_words <= n


def test_line_dedup_all(spark, sf, rows):
    got = {r.doc_id: r for r in line_dedup.op3_line_dedup_all(spark, sf).collect()}
    seen, short = set(), 0
    for i, t in sorted(rows):
        spans, kept, at = [], [], 0
        for line in (t or "").split("\n"):
            words = tuple(line.lower().split())
            if words and words in seen:
                spans.append(f"{at}-{at + len(line)}")
                short += len(words) < 5
            else:
                kept.append(line)
            seen.add(words)
            at += len(line) + 1
        assert (got[i].n_removed, got[i].removed_spans, got[i].kept_sha256) == (len(spans), ",".join(spans), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert short > 0


def slow_runs(text):
    """The runs of words that license_scan() should find, from all runs there are."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    b = list(zip(w, w[1:]))
    found = []
    for name, notice in license_scan.TEMPLATES:
        t = {tuple(x.split()) for x in license_scan.template_bigrams(notice)}
        if 1.5 * len(t & set(b)) < len(t):
            continue
        for lo in range(len(b)):
            own = set()
            for hi in range(lo, len(b)):
                own.add(b[hi])
                if len(own) > 1.5 * len(t):
                    break
                dice = 2 * len(own & t) / (len(own) + len(t))
                if dice >= 0.8:
                    found.append((-dice, -len(own & t), name, hi - lo, lo, hi))
    kept = []
    for x in sorted(found):
        if all(x[5] + 1 < y[4] or y[5] + 1 < x[4] for y in kept):
            kept.append(x)
    return sorted((x[4], x[3] + 2, x[2], round(-x[0], 9)) for x in kept)


def test_license_runs(spark, edge, empty):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "of", "license", "under", "work", "is", "a", "cat", "runs", "in"]) for _ in range(n))
    texts = []
    for name, notice in license_scan.TEMPLATES:
        w = notice.split()
        wrapped = "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        dealt = [x for x in w if rng.random() > 0.04]
        texts += [f"{prose(150)}\n{wrapped}\n{prose(150)}", f"{prose(30)} {notice} {prose(30)}", f"{prose(9)} {' '.join(dealt)} {prose(9)}"]
    mit = license_scan.NOTICES[18][1]
    texts += [" ".join([mit] * 9), f"{mit}\n{prose(400)}\nAll rights reserved. x {mit}", prose(300), "", "license"]
    rows = list(enumerate(texts))
    got = {}
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.n_words, r.license, round(r.dice, 9)))
    want = {i: slow_runs(t) for i, t in rows}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert all(license_scan.TEMPLATES[i // 3][0] in {x[2] for x in got[i]} for i in range(3 * len(license_scan.TEMPLATES)) if i % 3 < 2)
    assert license_scan.license_scan(edge).count() == 0 and license_scan.license_scan(empty).count() == 0


# --- all of it ---


def test_registry():
    from webweft.llm import registry

    names = list(registry.queries())
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in names}) == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)


def test_pipeline(spark, sf, tok):
    import corpus_pipeline as c

    docs, cols = spark.read.parquet(f"{sf}/documents.parquet"), None
    sizes = []
    for name, stage in c.STAGES[:-1]:
        from webweft.stored import Stored

        docs = Stored(stage(spark, docs, sf), name).df
        cols = cols or docs.columns
        assert docs.columns == cols
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > 0
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    check = packing.pack(docs).collect()
    assert check_pieces(check, tok, {r.doc_id: r.text for r in docs.collect()}) == 0
    assert c.run(spark, sf).count() > 0


def test_pipeline_edges(spark, sf, edge, empty):
    import corpus_pipeline as c

    for docs in (edge, empty):
        for name, stage in c.STAGES:
            out = stage(spark, docs, sf)
            n = out.count()
            assert n <= docs.count() or name == "packing"
            assert name == "packing" or out.columns == docs.columns
    # what is clean stays: a text that nothing else shares
    kept = {r.doc_id for r in c.STAGES[1][1](spark, edge, sf).collect()}
    assert {6, 8, 9} <= kept
