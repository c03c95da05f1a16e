"""Phrase collocations: word sequences that occur more often together than apart.

A phrase cannot be more frequent than its parts, so words, pairs and triples are counted first, by their hashes, and what is
seldom parts the texts: filters of the frequent ones let tasks pass over most places. (A filter may let more pass,
never less, so no phrase is lost and no count depends on a hash.) Over what is left each shard builds a generalised
suffix automaton of bounded depth; its states give every distinct phrase and its count, and the counts are summed globally.

A phrase is subsumed if a longer one that holds it is as frequent. Then so is one that is longer by a
single word: the phrase is its suffix (a suffix link) or its prefix. Both are cuts of the longer one, whose parts' counts
are looked up for its score anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import Stored, lean, read
from webweft.llm.suffix_automaton import SuffixAutomaton
from webweft.llm.wordhash import LOWER_CASE, UPPER_CASE, Filter, counted, hashes, mix, runs, texts, words

#: Words of a phrase, its least count, and how many phrases of a language are reported.
LONGEST, LEAST, TOP = 5, 100, 2_000
#: Bytes of text in a shard, hashes that a task counts before it sends them, and rows that it sends together.
SHARD, COMBINE, ROWS = 2 << 20, 500_000, 50_000
#: Parts in which a language's phrases are ranked first.
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_INSIDE = np.ones(256, bool)
_INSIDE[[*_BREAKS, 0x20, 0x09]] = False
_PARTS = np.zeros(256, bool)
_PARTS[[*_BREAKS]] = True


class Tokens:
    """The words of some texts: where they lie, their language, and whether the word before is of the same piece."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: pa.Array):
        self.data = data
        self.start, self.stop = words(data, _INSIDE)
        of = np.searchsorted(ends, self.start, side="right")
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy()[of] if len(of) else np.zeros(0, np.int32)
        piece = np.cumsum(_PARTS[data])[self.start]  # each text ends with a line break
        self.joined = np.append(False, piece[1:] == piece[:-1])[: len(piece)]

    def hashes(self) -> np.ndarray:
        """Of each word in its language."""
        raw = [b"\n" + x.encode() for x in self.langs.to_pylist()]
        data = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.cumsum([len(x) for x in raw])
        lang = hashes(data, stop - [len(x) for x in raw], stop) if raw else np.zeros(0, np.uint64)
        return mix(hashes(self.data, self.start, self.stop) ^ lang[self.lang]) if len(self.lang) else np.zeros(0, np.uint64)

    def strings(self) -> pa.Array:
        offsets = np.append(0, np.cumsum(self.stop - self.start)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[_INSIDE[self.data]]))])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """Of rows (text, lang), some megabytes at a time."""
    for b in batches:
        for rows, data, ends in texts(b, 0, SHARD):
            yield Tokens(data, ends, b.column(1).slice(rows.start, rows.stop - rows.start))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of single words."""
    for t in _shards(batches):
        coded = t.strings().dictionary_encode()
        many = len(coded.dictionary)
        key, n = np.unique(t.lang.astype(np.int64) * max(many, 1) + coded.indices.to_numpy(), return_counts=True)
        for lo in range(0, len(key), ROWS):
            k = key[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([t.langs.take(pa.array(k // many)), coded.dictionary.take(pa.array(k % many)), pa.array(n[lo : lo + ROWS])], names=["lang", "phrase", "n"])


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each (word, lang)."""
    for b in batches:
        for rows, data, ends in texts(b, 0):
            t = Tokens(data, ends, b.column(1).slice(rows.start, rows.stop - rows.start))
            yield pa.RecordBatch.from_arrays([pa.array(runs(t.hashes(), 1).view(np.int64))], names=["h"])


def _frequent(t: Tokens, filters: list[Broadcast]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of words, and for 1, 2, ... words whether those that end at a place may be frequent, as far as there are filters."""
    h = t.hashes()
    out: list[np.ndarray] = []
    for n, f in enumerate(filters, 1):
        ok = _may(out, t, n)
        at = np.flatnonzero(ok)
        ok[at] = f.value.has(runs(h, n)[at - n + 1])
        out.append(ok)
    return h, out


def _may(shorter: list[np.ndarray], t: Tokens, n: int) -> np.ndarray:
    """Where n words end of which all but the first, and all but the last, may be frequent."""
    if n == 1:
        return np.ones(len(t.start), bool)
    ok = shorter[n - 2] & t.joined
    ok[1:] &= shorter[n - 2][:-1]
    ok[: n - 1] = False
    return ok


def _count_runs(filters: list[Broadcast]):
    """(h, n): how often word sequences, longer by one than the last filter's, occur."""
    n = len(filters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def send() -> Iterator[pa.RecordBatch]:
            h, c = counted(held)
            for lo in range(0, len(h), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + ROWS].view(np.int64)), pa.array(c[lo : lo + ROWS])], names=["h", "n"])

        for t in _shards(batches):
            h, ok = _frequent(t, filters)
            got = runs(h, n)[np.flatnonzero(_may(ok, t, n)) - n + 1]
            held.append((got, np.ones(len(got), np.int64)))
            many += len(got)
            if many > COMBINE:
                yield from send()
                held, many = [], 0
        if many:
            yield from send()

    return run


def phrases_of(t: Tokens, may: list[np.ndarray], longest: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(lang, phrase, count) of each distinct sequence of 2 to `longest` words all of whose parts may be frequent."""
    pair, most = may[1], may[-1]
    # in a row of places that all end a frequent triple, say, a phrase may reach from the row's first triple on
    place = np.arange(len(most))
    row = place - np.maximum.accumulate(np.where(~most, place, -1))
    depth = np.where(most, np.minimum(longest, row + len(may) - 1), 0)
    for n, ok in enumerate(may[:-1], 1):
        depth = np.where(ok & ~most, np.maximum(depth, n), depth)
    near = pair | np.append(pair[1:], False)  # words of some frequent pair
    depth = np.where(near, np.maximum(depth, 1), 0)
    # the words with a space after each
    data = t.data.copy()
    data[t.stop] = 0x20
    keep = _INSIDE[t.data]
    keep[t.stop] = True
    data = data[keep]
    stop = np.cumsum(t.stop - t.start + 1) - 1
    start = stop - (t.stop - t.start)
    coded = t.strings().dictionary_encode()
    symbols = t.lang.astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    for end, length, count in SuffixAutomaton(symbols, depth).substrings(2):
        for lo in range(0, len(end), ROWS):
            e, a = end[lo : lo + ROWS], start[end[lo : lo + ROWS] - length[lo : lo + ROWS] + 1]
            size = stop[e] - a
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            take = np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])
            phrase = pa.Array.from_buffers(pa.string(), len(e), [None, pa.py_buffer(offsets), pa.py_buffer(data[take])])
            yield t.langs.take(pa.array(t.lang[e])), phrase, count[lo : lo + ROWS]


def _count_phrases(filters: list[Broadcast], longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            _, may = _frequent(t, filters)
            for lang, phrase, count in phrases_of(t, may, longest):
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count)], names=["lang", "phrase", "n"])

    return run


_COUNTS = "lang string, phrase string, n long"


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, filtered: int = 3, text_col: str = "text", lang_col: str = "lang") -> tuple[Stored, Stored]:
    """(lang, phrase, n) of all words, and of all phrases of 2 to `longest` words that occur `least` times.

    filtered: sequences of up to so many words, 2 at least, are counted by hashes first.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    single = Stored(rows.mapInArrow(lean(_count_words), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    filters = [Filter.of(single.df.where(F.col("n") >= least).select("phrase", "lang").mapInArrow(lean(_hash_words), "h long"))]
    while len(filters) < min(filtered, longest):
        runs_ = Stored(rows.mapInArrow(lean(_count_runs(filters)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "runs")
        filters.append(Filter.of(runs_.df))
        runs_.drop()
    counts = rows.mapInArrow(lean(_count_phrases(filters, longest)), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    phrases = Stored(counts.where(F.col("n") >= least), "phrases")
    for f in filters:
        f.destroy()
    return single, phrases


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of a language by how much more often their words occur together
    than their parts would by chance, in thousandths.

    a: the phrase's count. l, r: those of its parts where it is cut so that the score is lowest, at the first such place.
    n: all words of the language. A phrase that lies in a longer one of the same count is left out. top: phrases reported of a
    language; None for all. Words are lower-cased (A-Z) and never cross `.,;:!?` or a line's end. A null text is empty, a null
    language `und`; equal rows count each. Empty in, empty out. All arithmetic is in decimals of 38 digits.
    """
    single, phrases = phrase_counts(docs, longest, least, text_col=text_col, lang_col=lang_col)
    totals = single.df.groupBy("lang").agg(F.sum("n").alias("total"))
    known = phrases.df.union(single.df.where(F.col("n") >= least))
    word = F.split("phrase", " ")
    cuts = phrases.df.select("lang", "phrase", F.col("n").alias("a"), word.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.size("w").alias("words"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = Stored(cuts, "cuts")
    whole = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.expr("(a_ * n_ * cast(1000 as decimal(4,0))) div (l_ * r_)")
    scored = cuts.df.join(totals, "lang").withColumns({"a_": whole("a"), "n_": whole("total"), "l_": whole("l"), "r_": whole("r")})
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    inner = cuts.df.where("words > 2")
    inside = inner.where("k = 1 and r = a").select("lang", F.col("rest").alias("phrase")).union(inner.where("k = words - 1 and l = a").select("lang", F.col("first").alias("phrase"))).distinct()
    out = lowest.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "m.l", "m.r", F.col("total").alias("n"), "m.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))
        out = out.withColumn("some", some).where(F.col("some") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = out.where(F.col("rank") <= top) if top is not None else out
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_suffix_automaton_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of two to five words over all documents, the first 2,000 of each language; a report of a fixed length."""
    return collocations(read(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^ \\t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER_CASE}', '{LOWER_CASE}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS p FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.n AS l, y.n AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n) AS BIGINT) AS score, cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ') JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.k > s.k AND 100 * f.n >= 100 * s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {TOP}
"""

QUERIES = {"op12_suffix_automaton_phrases": op12_suffix_automaton_phrases}
ORACLE: dict[str, str] = {"op12_suffix_automaton_phrases": _ORACLE}
