"""Removal of repeated lines, paragraphs or passages.

A text is cut into units, each unit's normalised words are hashed to 128 bits, and digests meet
globally. The earliest unit of each digest, by document id and place, is kept; later ones go, and the
spans that go are given as places in the original text. A digest's first place is a partial aggregate,
so a line that a third of all documents share is one row a task, and the join back on it may be split.

Passages are paragraphs that lie where they like: the fewest consecutive sentences, from each sentence
on, that have enough words together. So a passage that was put into the midst of a line is found, and
a stock sentence that many documents have is not a repeat by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import Stored, keyed_text, lean, read, release_shuffles

#: Units with fewer words than this are left alone: of lines and paragraphs, and of passages.
LEAST_WORDS = {"line": 5, "paragraph": 5, "passage": 25}
SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
#: A sentence with its end and the white space after it; they lie end to end.
SENTENCE = re.compile("[^.!?。！？\n]*[.!?。！？\n]+[ \t\n\f\r]*|[^.!?。！？\n]+")
_WORD = re.compile("[^\x20\x09-\x0d]+")
_UNIT = "doc long, rid long, start int, stop int, digest binary"


def units(text: str, by: str) -> list[tuple[int, int]]:
    """Start and end of each line, paragraph or (for passages) sentence."""
    if by == "passage":
        return [m.span() for m in SENTENCE.finditer(text)]
    out, at = [], 0
    for m in SEPARATORS[by].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def normalised(unit: str) -> list[str]:
    """Its words in lower case."""
    return _WORD.findall(unit.lower())


def hashed_runs(text: str, by: str, least_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """(first unit, end, words) of what is compared: each unit of least_words words or more; for passages, from each
    sentence on the fewest that have them together, and the fewest up to the last one that have them."""
    each = [normalised(text[a:z]) for a, z in units(text, by)]
    if by != "passage":
        yield from ((k, k + 1, w) for k, w in enumerate(each) if len(w) >= least_words)
        return
    words = [x for w in each for x in w]
    at = [0]
    for w in each:
        at.append(at[-1] + len(w))
    stop = 0
    for k in range(len(each)):
        if at[-1] - at[k] < least_words:
            break
        while stop <= k or at[stop] - at[k] < least_words:
            stop += 1
        yield k, stop, words[at[k] : at[stop]]
        if stop < len(each) and at[-1] - at[k + 1] < least_words:
            yield k, len(each), words[at[k] :]


def _units(by: str, least_words: int):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _UNIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for doc, rid, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, stop, words in hashed_runs(text, by, least_words):
                    out.append((doc, rid, k, stop, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
                    if len(out) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _cut(by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, total, many, spans, kept = [], [], [], [], []
            for doc, text, gone in zip(*(c.to_pylist() for c in b.columns)):
                all_units = units(text, by)
                late = {k for g in gone or () for k in range(g["start"], g["stop"])}
                ids.append(doc)
                total.append(len(all_units))
                many.append(len(late))
                cut: list[dict] = []
                for k in sorted(late):
                    a, z = all_units[k]
                    if by == "passage" and cut and cut[-1]["end"] == a:
                        cut[-1]["end"] = z
                    else:
                        cut.append({"start": a, "end": z})
                spans.append(cut)
                kept.append({"line": "\n", "paragraph": "\n\n", "passage": ""}[by].join(text[a:z] for k, (a, z) in enumerate(all_units) if k not in late))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(many, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_units", "n_removed", "removed", "kept"])

    return run


def line_dedup(docs: DataFrame, by: str = "line", least_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, n_removed, removed array<struct<start, end>>, kept): one row per input row.

    by: line, paragraph or passage (units are sentences then). removed: places in the original text (code
    points) of units whose normalised text, or whose passage's, stands earlier, in a document of smaller id
    or further up; for passages, sentences that lie end to end are one place, and one that overlaps its own
    repeat loses what the repeat covers. kept: the rest, joined again. Null text is empty: one empty line or
    paragraph, or no sentence. A null id comes first. Rows that share an id go by a hash of their text; rows
    equal in both count as one document. Units or passages under least_words words stay, and so does a
    whole text that has fewer. Empty in, empty out.
    """
    least_words = LEAST_WORDS[by] if least_words is None else least_words
    rows = keyed_text(docs, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("rid", F.xxhash64("text"))
    own = rows.select("doc", "rid", "text").mapInArrow(lean(_units(by, least_words)), _UNIT)
    place = F.struct("doc", "rid", "start")
    first = own.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # stored, so that the join stands on its own shuffle and a line that very many share may be split there
    first = Stored(first, "firsts")
    release_shuffles(docs.sparkSession)
    late = own.join(first.df, "digest").where(place > F.col("first"))
    gone = Stored(late.groupBy("doc", "rid").agg(F.collect_set(F.struct("start", "stop")).alias("gone")), "late")
    first.drop()
    release_shuffles(docs.sparkSession)
    return rows.join(gone.df, ["doc", "rid"], "left").select("doc_id", "text", "gone").mapInArrow(lean(_cut(by)), "doc_id long, n_units long, n_removed long, removed array<struct<start:int,end:int>>, kept string")


def _in_figures(done: DataFrame) -> DataFrame:
    chars = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    places = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "n_units", "n_removed", chars.alias("removed_chars"), places.alias("removed_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of passages: sentences in a row of 25 words or more."""
    return _in_figures(line_dedup(read(spark, sf_dir, "documents"), "passage"))


def op3_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of all lines but blank ones, however short."""
    return _in_figures(line_dedup(read(spark, sf_dir, "documents"), least_words=1))


QUERIES = {"op3_line_dedup": op3_line_dedup, "op3_line_dedup_all": op3_line_dedup_all}
ORACLE = {
    "op3_line_dedup_all": """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS u,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (
  SELECT *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS norm,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY u) - length(line) - 1 AS a FROM l),
r AS (
  SELECT *, CASE WHEN norm <> '' THEN row_number() OVER (PARTITION BY norm ORDER BY doc_id, u) ELSE 1 END AS k FROM n)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (k > 1) AS n_removed,
       CAST(coalesce(sum(length(line)) FILTER (k > 1), 0) AS BIGINT) AS removed_chars,
       coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(line) AS BIGINT), ',' ORDER BY u) FILTER (k > 1), '') AS removed_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY u) FILTER (k = 1), '')) AS kept_sha256
FROM r GROUP BY doc_id
""",
    "op3_line_dedup": """
WITH p AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?。！？\\n]*[.!?。！？\\n]+[ \\t\\n\\f\\r]*|[^.!?。！？\\n]+') AS s FROM documents),
u AS (SELECT doc_id, generate_subscripts(s, 1) AS u, unnest(s) AS unit FROM p),
n AS (
  SELECT *, regexp_extract_all(lower(unit), '[^\\x20\\x09-\\x0D]+') AS w FROM u),
c AS (
  SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY u) AS upto, sum(len(w)) OVER (PARTITION BY doc_id) AS total,
         max(u) OVER (PARTITION BY doc_id) AS last, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY u) AS z FROM n),
f AS (  -- from each sentence on, the fewest that have 25 words together
  SELECT a.doc_id, a.u AS lo, a.last, b.u AS hi, a.total - a.upto AS rest FROM
    (SELECT *, upto - len(w) + 25 AS need FROM c WHERE total - upto + len(w) >= 25) a
    ASOF JOIN c b ON a.doc_id = b.doc_id AND a.need <= b.upto),
r AS (  -- and the fewest up to the last one that have them
  SELECT doc_id, lo, hi FROM f UNION ALL SELECT doc_id, lo, last FROM f WHERE hi < last AND rest < 25),
t AS (
  SELECT r.*, array_to_string(list_filter(list_transform(range(lo, hi + 1), lambda k: x.ws[k]), lambda y: y <> ''), ' ') AS norm
  FROM r JOIN (SELECT doc_id, list(array_to_string(w, ' ') ORDER BY u) AS ws FROM c GROUP BY doc_id) x USING (doc_id)),
late AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, lo) AS k FROM t) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS u FROM late),
m AS (
  SELECT c.*, gone.u IS NOT NULL AS late, c.u - row_number() OVER (PARTITION BY c.doc_id, gone.u IS NOT NULL ORDER BY c.u) AS island
  FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.u = gone.u),
spans AS (
  SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(z AS BIGINT), ',' ORDER BY a) AS removed_spans
  FROM (SELECT doc_id, min(z - length(unit)) AS a, max(z) AS z FROM m WHERE late GROUP BY doc_id, island) GROUP BY doc_id),
done AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (late) AS n_removed, CAST(coalesce(sum(length(unit)) FILTER (late), 0) AS BIGINT) AS removed_chars,
         coalesce(string_agg(unit, '' ORDER BY u) FILTER (NOT late), '') AS kept
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
       coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id) LEFT JOIN spans USING (doc_id)
""",
}
