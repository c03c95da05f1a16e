"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a preferred (label 1) and another (label 0) document give feature differences; logistic
loss on them gives weights, so that a document's strength is their product with its features.
The strength at the quantile that the share of label 0 names is the threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import fold, keyed_text, lean, read

#: Most labelled rows that are fitted on; bounds what is broadcast and collected.
SAMPLE_ROWS = 20_000
#: Preference pairs drawn from them, with a fixed seed.
PAIRS = 60_000
FEATURES = ("capitals", "signs", "digits", "odd_bytes", "repeats", "distinct", "word_length", "no_letters", "exclaimed", "word_end_signs", "words_a_line", "line_ends", "log_words", "top_word", "lower_starts", "pair_repeats")

_BYTE = np.zeros((4, 256), dtype=bool)
_BYTE[0, 65:91] = True  # capitals
_BYTE[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # signs
_BYTE[1, [34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = False  # those of prose
_BYTE[2, 48:58] = True  # digits
_BYTE[3, [*range(0, 9), *range(14, 32), 127]] = True  # control bytes


def features(text: str | None) -> list[float]:
    """Numbers of FEATURES; all 0 for an empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    size = len(raw)
    lines = count[10] + 1
    last = b"".join([w[-1:] for w in words])
    first = b"".join([w[:1] for w in words])
    ends = np.bincount(np.frombuffer(last, np.uint8), minlength=256)
    starts = np.bincount(np.frombuffer(first, np.uint8), minlength=256)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    distinct = Counter(words)
    common = max(distinct.values()) / n if n > 20 else 0.0
    bare = sum(w.isalpha() for w in distinct) / len(distinct)
    return [
        count[_BYTE[0]].sum() / letters,
        count[_BYTE[1]].sum() / size,
        count[_BYTE[2]].sum() / size,
        count[_BYTE[3]].sum() / size,
        same,
        len(distinct) / n,
        min(40.0, (size - n) / n) / 10,
        bare,
        count[33] / n,
        ends[_BYTE[1]].sum() / n,
        math.log1p(n / lines) / 5,
        (ends[46] + ends[44]) / n,
        math.log1p(n) / 10,
        common,
        starts[97:123].sum() / n,
        1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0,
    ]


@dataclass(frozen=True)
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> BradleyTerry:
    """Weights by Newton's method on the pairs' logistic loss; even scores where there is only one label."""
    d = x.shape[1]
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # of the wrong order
        gradient = diff.T @ p / pairs - ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(z @ w)
    k = int(round(len(bad) / len(label) * len(s)))  # as many lie below as have label 0
    at = (s[max(0, k - 1)] + s[min(len(s) - 1, k)]) / 2
    return BradleyTerry(mean, scale, w, float(at))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> BradleyTerry:
    """A model from at most sample_rows labelled documents, chosen by a hash of their id.

    Labels other than 0 and 1 and null ids are left out; of several labels for an id the least holds, and of several
    texts under an id the one with the least hash. Without documents or labels every score is even.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    got = keyed_text(docs, id_col, text_col).join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).select("label", "text").mapInArrow(lean(_features), "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # the same fit, in whatever order rows come
    return fit_pairs(x[order], got["label"].to_numpy()[order])


def _scores(model: BradleyTerry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], names=[*b.schema.names[:-1], "score"])

    return run


def quality_scores(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row, from the text alone. Null and empty texts get the score of no words.

    Null ids stay null, repeated rows stay repeated. Empty in, empty out.
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(lean(_scores(model)), "doc_id long, score double")


def quality_filter(docs: DataFrame, model: BradleyTerry, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, in all their columns, whose score is at least `least`; rows of equal text stay or go together."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in text]).reshape(-1, len(FEATURES))))

    return docs.where(score(F.coalesce(F.col(text_col), F.lit(""))) >= least)


def trained_on_folds(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Learnt only from rows whose crc32(doc_id) mod 3 is not 1."""
    return train(docs, labels.where(fold("doc_id", 3) != 1))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality_scores(docs, trained_on_folds(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE: dict[str, str] = {}
