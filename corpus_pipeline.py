"""A corpus pipeline: quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of documents. In every stage a null text is an empty one, texts may be of any
length, columns beside doc_id and text go along untouched, whatever their names, and no rows in give no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webweft.llm import packing, quality, simhash, suffix_dedup
from webweft.llm.common import Stored, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier accepts, in all their columns.

    Rows of equal text, null ids and repeated ids among them, stay or go together. Without labels all stay.
    """
    return quality.quality_filter(docs, quality.trained_on_folds(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Texts that share a band of shingle minima are compared bit-sliced by their SimHashes, and those that are close by
    their shingles. The smallest id stands for its group. Rows with a null id stay; of rows that are equal in id and
    text one stays; texts without words are one group.
    """
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that stand earlier; n_chars is renewed.

    All rows stay, be it with an empty text. A null id comes before all others; of several rows with one id and text
    each has the same left. Characters that a passage covers in part stay.
    """
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of every document; an empty text is its end alone. Null ids and repeated rows are packed
    like any other."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: SimHash groups and byte-pair ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is stored for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
