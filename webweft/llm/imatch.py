"""I-Match document fingerprints, in DataFrame expressions alone.

Document frequencies are counted over all texts by 64-bit hashes of terms. The lexicon is the band of terms that are
neither common nor rare; it is sent along as a bit set, in which a term is known by low bits of its hash. A
text's distinct lexicon terms are sorted and hashed once for each of several randomised sub-lexicons, of falling
density, so that short and long texts alike have some that a small edit leaves as they were. Likeness is the share of
sub-lexicons on which two texts agree.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import Stored, keyed_text, read

#: The bit set has 2**SLACK to 2**(SLACK + 1) bits for each term of the band: so seldom, or half as seldom, is a term out
#: of it taken for one. Least and most bits are 2**BITS; a band of more than 2**21 terms, which takes texts of more than
#: 400 distinct terms each on average, all of them in the band, has fewer bits a term.
SLACK, BITS = 6, (16, 27)
#: Band of document frequency, as shares of all documents: inverse document frequency from log 10 to log 5000.
COMMON, RARE = 0.1, 0.0002
#: Sub-lexicons by density: so many that hold 2**-d of the lexicon each. The first is the whole lexicon.
DENSITIES = ((0, 1), (2, 6), (4, 8), (5, 8), (6, 8), (7, 8), (9, 8))
#: Sub-lexicons of a density that must have terms of a text for their agreement to count by itself.
LEAST_FILLED = 3

#: Documents that a range of ids has about; most ranges, and those that are cut in one pass.
RANGE_DOCS, RANGES, COARSE = 2_000, 65_536, 1_024

_FIRST = -(1 << 63)


def masks(seed: int = 5) -> list[int]:
    """Bits that a term's hash must have set to be in each sub-lexicon."""
    rng = random.Random(seed)
    out = []
    for d, n in DENSITIES:
        out += [sum(1 << b for b in rng.sample(range(BITS[1], 63), d)) for _ in range(n)]
    return out


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7f]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", common: float = COMMON, rare: float = RARE) -> list[int]:
    """The band of terms over all documents, as a bit set in 64-bit words."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = Stored(df.where((F.col("df") <= max(2, common * n)) & (F.col("df") >= max(2, rare * n))).select("t"), "band")
    bits = min(max(BITS[0], band.df.count().bit_length() + SLACK), BITS[1])
    slot = F.col("t").bitwiseAND(F.lit((1 << bits) - 1))
    # at most a row a word
    words = band.df.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(t & 63 as int))")).alias("bits")).collect()
    out = [0] * (1 << (bits - 6))
    for r in words:
        out[r.w] = r.bits
    band.drop()
    return out


def constant(bits: list[int]) -> Column:
    """The lexicon as one literal, which the optimizer folds from its text form."""
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<long>")


def fingerprint(text: Column, bits: list[int]) -> Column:
    """A number for each sub-lexicon, 64 bits for the whole one and 24 for others; 0 where the text has none of its terms.

    A text without lexicon terms is told by all of its terms, in the first place alone.
    """
    low, words = F.lit(64 * len(bits) - 1), constant(bits)

    def kept(h: Column) -> Column:
        t = h.bitwiseAND(low)
        word = F.element_at(words, F.shiftright(t, 6).cast("int") + 1)
        return F.getbit(word, t.bitwiseAND(F.lit(63)).cast("int")) == 1

    def digest(hs: Column) -> Column:
        # the hash of nothing is its seed, 42; written so that hs is evaluated once
        return F.xxhash64(hs).bitwiseXOR(F.lit(42).cast("long"))

    subsets = F.array(*[F.lit(m).cast("long") for m in masks()[1:]])

    def of(every: Column, lex: Column) -> Column:
        whole = digest(F.when(F.size(lex) > 0, lex).otherwise(every))
        return F.concat(F.array(whole), F.transform(subsets, lambda m: digest(F.filter(lex, lambda h: h.bitwiseAND(m) == m)).bitwiseAND(F.lit(0xFFFFFF).cast("long"))))

    # one-element arrays name a value, so that it is evaluated once
    named = F.transform(F.array(F.sort_array(terms(text))), lambda every: F.transform(F.array(F.filter(every, kept)), lambda lex: of(every, lex))[0])
    return named[0]


def likeness(a: Column, b: Column) -> Column:
    """The best agreement of two fingerprints, over densities: of a density's sub-lexicons that either text has
    terms of, the share on which both agree; 1 for equal fingerprints."""
    shares, at = [], 1
    for d, n in DENSITIES:
        x, y = F.slice(a, at, n), F.slice(b, at, n)
        # tens of thousands count the filled sub-lexicons, units those that agree
        both = F.aggregate(F.zip_with(x, y, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(10_001)).otherwise(F.lit(10_000))), F.lit(0), lambda s, x: s + x)
        shares.append(F.transform(F.array(both), lambda v: F.when(v >= LEAST_FILLED * 10_000, (v % 10_000) / F.floor(v / 10_000)).otherwise(F.lit(0.0)))[0])
        at += n
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*shares))


def as_text(fp: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(fp[0]), 16, "0")), F.array_join(F.transform(F.slice(fp, 2, F.greatest(F.size(fp) - 1, F.lit(0))), lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), ""))


def imatch_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fp array<long>): one row per input row.

    Null text is empty; an empty text has all zeros. Null ids stay null and repeated rows stay repeated, each of them
    counting as a document. Empty in, empty out.
    """
    rows = keyed_text(docs, id_col, text_col)
    return rows.withColumn("fp", fingerprint(F.col("text"), lexicon(rows)))


def _cuts(rows: DataFrame, count: int) -> list[int]:
    """Ids that part rows into about count ranges of like size; in two passes if there are many, each over ids alone."""
    coarse = min(count, COARSE)
    got = rows.agg(F.percentile_approx("__id", [i / coarse for i in range(1, coarse)], 20 * coarse)).first()[0] if coarse > 1 else []
    cuts = sorted(set(got or []))
    fine = -(-count // coarse)
    if fine > 1:
        inner = rows.groupBy(_range_of(F.col("__id"), cuts).alias("r")).agg(F.percentile_approx("__id", [i / fine for i in range(1, fine)], 20 * fine).alias("c"))
        # at most COARSE rows of RANGES / COARSE ids each
        cuts = sorted(set(cuts).union(*(r.c for r in inner.collect())))
    return cuts


def _range_of(id_: Column, cuts: list[int]) -> Column:
    """How many cuts lie below an id, by bisection."""
    if not cuts:
        return F.lit(0)
    every = constant(cuts)
    step = lambda lo_hi, _: F.when(lo_hi[0] < lo_hi[1], F.when(F.element_at(every, F.floor((lo_hi[0] + lo_hi[1]) / 2).cast("int") + 1) < id_, F.array((F.floor((lo_hi[0] + lo_hi[1]) / 2) + 1).cast("int"), lo_hi[1])).otherwise(F.array(lo_hi[0], F.floor((lo_hi[0] + lo_hi[1]) / 2).cast("int")))).otherwise(lo_hi)
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), F.array(F.lit(0), F.lit(len(cuts))), step)[0]


def with_next(rows: DataFrame, columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """rows (doc_id, text) with next_<c>: column c of the row that follows by ascending doc_id, then text;
    the last row is followed by the first. Null ids come first. prepare adds columns, which are evaluated once a row.

    Rows go to ranges of ids by quantiles, and the first of each range as a guest to the one before it
    too, so that no task sees more than its range; of that a window holds two rows at a time.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("__id", F.coalesce("doc_id", F.lit(_FIRST)))
    n = rows.count()
    cuts = _cuts(rows, min(RANGES, max(1, -(-n // RANGE_DOCS))))
    rows = rows.withColumn("__range", _range_of(F.col("__id"), cuts)).withColumn("__guest", F.lit(0))
    # at most RANGES rows: the first id of each range, and the range that it visits
    heads = [(r["__range"], r["head"]) for r in rows.groupBy("__range").agg(F.min("__id").alias("head")).orderBy("__range").collect()]
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    guests = F.broadcast(spark.createDataFrame(list(before.items()), "__id long, __to int"))
    guests = rows.join(guests, "__id").select(*[F.col("__to").alias(c) if c == "__range" else F.lit(1).alias(c) if c == "__guest" else F.col(c) for c in rows.columns])
    w = Window.partitionBy("__range").orderBy("__guest", "__id", "text")
    out = prepare(rows.union(guests)).select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return out.where("__guest = 0").drop("__id", "__range", "__guest")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_text(read(spark, sf_dir, "documents"))
    bits = lexicon(rows)
    rows = with_next(rows, ["text", "fp"], lambda rows: rows.withColumn("fp", fingerprint(F.col("text"), bits))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited"), bits))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


QUERIES = {"op6_imatch_fingerprints": op6_imatch_fingerprints}
ORACLE: dict[str, str] = {}
