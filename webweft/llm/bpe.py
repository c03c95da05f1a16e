"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words of the corpus are merged once and compiled with their ids into an automaton
(transducer.py); Spark ships its file to each executor, where workers memory-map it. Words
that the automaton lacks are merged exactly (bytebpe.py), so its size changes no result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm import bytebpe, transducer
from webweft.llm.common import Stored, keyed_text, lean, read, shared_dir

#: Words in the lexicon; bounds what the driver collects and the automaton's size.
LEXICON_WORDS = 65_536
#: Distinct words that a counting task holds; rarer ones leave, which only changes what is remembered.
COUNT_WORDS = 300_000
#: Characters of text that a worker takes at once.
CHARS = 2_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys (column 0) and texts (column 1) in slices of about CHARS characters."""
    for b in batches:
        texts = b.column(1).to_pylist()
        lo = size = 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= CHARS or hi == len(texts):
                yield b.column(0).slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for _, texts in slices(batches):
        coded = bytebpe.cut(texts)[0].dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        seen.update(dict(zip(coded.dictionary.to_pylist(), n.tolist())))
        least = 1
        while len(seen) > COUNT_WORDS:
            least *= 2
            seen = Counter({w: n for w, n in seen.items() if n >= least})
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def build_lexicon(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Name of the shipped automaton file (SparkFiles) for the most frequent words of all docs."""
    spark = docs.sparkSession
    counts = keyed_text(docs, id_col, text_col).mapInArrow(lean(_count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = Stored(counts, "words")
    # the least count that at most `words` words reach, by a histogram of quarter powers of two
    level = F.floor(4 * F.log2("n")).cast("int").alias("level")
    room, least = words, 1 << 62
    for r in counts.df.groupBy(level).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    raw = sorted(bytes(r.word) for r in counts.df.where(level >= least).select("word").collect())
    counts.drop()
    data = transducer.build(raw, bytebpe.load(path).merge_many(raw))
    jvm, name = spark._jvm, f"lexicon-{uuid.uuid4().hex}.bin"
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")
    return name


@lru_cache(maxsize=2)
def encoder(path: str, lexicon: str | None = None) -> bytebpe.Encoder:
    """This worker's encoder; the lexicon's file is mapped, not read."""
    lookup = transducer.Transducer(SparkFiles.get(lexicon)).lookup if lexicon else None
    return bytebpe.Encoder(bytebpe.load(path), lookup)


def id_lists(flat: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _round_trip(path: str, lexicon: str | None, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, lexicon)
        piece = enc.bpe.token_bytes.__getitem__
        for keys, texts in slices(batches):
            flat, begins = enc.encode(texts)
            arrays, names = [keys, id_lists(flat, begins)], ["doc_id", "ids"]
            if decode:
                ids, at = flat.tolist(), begins.tolist()
                back = [b"".join(map(piece, ids[a:b])).decode("utf-8", "replace") for a, b in zip(at, at[1:])]
                arrays, names = [*arrays, pa.array(back, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS, decode: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded string]): one row per input row, ids as the tokenizers library gives
    them without special tokens added. Null text is empty and has no ids; null ids stay null, repeated rows stay
    repeated; a special token's string in a text is that token. Empty in, empty out.
    """
    path = path or default_path()
    lexicon = build_lexicon(docs, path, id_col, text_col, words)
    return keyed_text(docs, id_col, text_col).mapInArrow(lean(_round_trip(path, lexicon, decode)), "doc_id long, ids array<int>" + ", decoded string" * decode)


def bpe_decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): special tokens are kept; a null list gives an empty text, null and unknown ids nothing."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = bytebpe.load(path).token_bytes.get
        for b in batches:
            text = [b"".join(get(i, b"") for i in x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>")).mapInArrow(lean(run), "doc_id long, text string")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_encode(read(spark, sf_dir, "documents"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
ORACLE: dict[str, str] = {}
