"""The page store: standard records, latest-wins upsert, lookups and counts over a Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webweft.functions import urls

RECORD = "url string, title string, text string, links array<string>, metadata string, crawled_at timestamp, status_code int, content_type string"
FIELDS = tuple(x.split()[0] for x in RECORD.split(", "))
MOST_FOUND = 100
#: Marks a save in which a URL may have several rows.
RAW = "_RAW"
#: What the store keeps.
STORED = f"id long, seq long, domain string, {RECORD}"


def make_record(pages: DataFrame, crawled_at: Column | None = None, status_code: str = "status_code", content_type: str = "content_type") -> DataFrame:
    """Standard records of parsed pages (column page): eight columns, the rest dropped; empty links too."""
    p = F.col("page")
    has = lambda c: F.col(c) if c in pages.columns else F.lit(None)
    return pages.select(
        p["url"].alias("url"),
        F.coalesce(p["title"], F.lit("")).alias("title"),
        F.coalesce(p["text"], F.lit("")).alias("text"),
        F.filter(F.coalesce(p["links"], F.array().cast("array<string>")), lambda x: x != "").alias("links"),
        F.coalesce(F.to_json(p["metadata"]), F.lit("{}")).alias("metadata"),
        (crawled_at if crawled_at is not None else F.current_timestamp()).alias("crawled_at"),
        has(status_code).cast("int").alias("status_code"),
        F.coalesce(has(content_type).cast("string"), F.lit("")).alias("content_type"),
    ).where("url is not null and url <> ''")


def validate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows lack a url, links or metadata, or hold metadata that is no JSON object.

    Columns that are missing, or of another type than a record's, raise.
    """
    types = {f.name: f.dataType.simpleString() for f in records.schema}
    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(RECORD)}
    if lost := [c for c in FIELDS if c not in types]:
        raise ValueError(f"records lack {', '.join(lost)}")
    if wrong := [f"{c} is {types[c]}, not {want[c]}" for c in FIELDS if types[c] not in (want[c], "void")]:
        raise ValueError("; ".join(wrong))
    object_ = F.coalesce(F.get_json_object("metadata", "$").startswith("{"), F.lit(False))
    ok = F.coalesce(F.col("url") != "", F.lit(False)) & F.col("links").isNotNull() & object_
    return records.where(ok), records.where(~ok)


def decoded(records: DataFrame) -> DataFrame:
    """records with metadata as a variant instead of JSON text; null where it is no JSON."""
    return records.withColumn("metadata", F.try_parse_json("metadata"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """The table after new rows: of each key the row with the highest seq, and id, the lowest seq it ever had.

    Partial aggregates: a key that was written very often is one row a task before the shuffle.
    """
    rows = existing.unionByName(new)
    return rows.groupBy(key).agg(F.min(seq).alias("id"), F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r")).select(key, "id", "r.*")


def count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("n"))


def get(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("url") == url)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find(pages: DataFrame, domain: str | None = None, status_code: int | None = None, title_contains: str | None = None, limit: int = MOST_FOUND, order: str = "id") -> DataFrame:
    """Rows that meet all given conditions, oldest first. In title_contains % and _ are wildcards; ASCII case does not count."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a number not under 0")
    out = pages
    if domain is not None:
        # the store keeps the domain as a column, so that its files' statistics rule row groups out
        of = F.col("domain") if "domain" in out.columns else urls.domain(F.col("url"))
        out = out.where(of == domain.lower())
    if status_code is not None:
        out = out.where(F.col("status_code") == status_code)
    if title_contains is not None:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in title_contains)
        out = out.where(ascii_lower(F.col("title")).like("%" + low.replace("\\", "\\\\") + "%"))
    return out.orderBy(order).limit(limit)


def stats_by_domain(pages: DataFrame) -> DataFrame:
    return pages.groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


def stats_by_status(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status_code").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("status_code"))


class PageStore:
    """Records under a path, kept as a base and the deltas that were saved since; a read merges them, latest first.

    A save writes the new rows alone, as a folder that counts once it is complete: readers never see half of one, and a
    lost executor's tasks can run again. After MOST_DELTAS saves, base and deltas become a new base, sorted by domain
    and URL over its files, so that a search by domain reads few row groups and a large domain is many files. One writer
    at a time; a reader's snapshot holds until the second compaction after it.
    """

    MOST_DELTAS = 16

    def __init__(self, spark: SparkSession, path: str, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.most_deltas = spark, path.rstrip("/"), most_deltas

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _folders(self) -> list[tuple[int, str]]:
        """(number, kind) of complete folders, base or delta, in order."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        done = [n.getName() for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return sorted((int(n.split("=")[1]), n.split("=")[0]) for n in done if n.startswith(("base=", "delta=")))

    def _current(self) -> list[tuple[int, str]]:
        all_ = self._folders()
        base = max((k for k, kind in all_ if kind == "base"), default=0)
        return [(k, kind) for k, kind in all_ if k >= base]

    def _parts(self, folders: list[tuple[int, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.path}/{kind}={k}" for k, kind in folders])

    def _raw(self, folder: tuple[int, str]) -> bool:
        fs, p = self._fs(f"{self.path}/{folder[1]}={folder[0]}/{RAW}")
        return fs.exists(p)

    def read(self) -> DataFrame:
        """(id, domain, seq and the record's columns): of each URL its latest row, and id, the first seq it had.

        Filters on url and domain reach the files, as rows are grouped by both.
        """
        folders = self._current()
        rows = self._parts(folders)
        if not folders or len(folders) == 1 and not self._raw(folders[0]):
            return rows
        rest = [c for c in rows.columns if c not in ("url", "domain", "id")]
        got = rows.groupBy("url", "domain").agg(F.min("id").alias("id"), F.max_by(F.struct(*rest), "seq").alias("r"))
        return got.select("url", "domain", "id", "r.*").select(*rows.columns)

    def save(self, records: DataFrame) -> int:
        """Upserts records and gives the number of rows written; rows that are not valid stay out. Of rows with one URL
        in the same save, one counts."""
        good, _ = validate(records)
        folders = self._current()
        last = max((k for k, _ in folders), default=0)
        # numbers of a save lie above all those of the saves before it; within one, rows of other URLs may share one
        seq = F.lit((last + 1) << 44).cast("long") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 44))
        one = good.select(*FIELDS).withColumn("seq", seq).groupBy("url").agg(F.max_by(F.struct(*FIELDS[1:], "seq"), "seq").alias("r"))
        seen = Observation()
        rows = one.select(F.col("r.seq").alias("id"), "r.seq", urls.domain(F.col("url")).alias("domain"), "url", *[f"r.{c}" for c in FIELDS[1:]])
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/delta={last + 1}")
        if len(folders) >= self.most_deltas:
            self.compact()
        return seen.get["n"]

    def compact(self) -> None:
        """Makes one base of what there is; folders that an earlier base already replaced go."""
        now = self._current()
        if len(now) < 2:
            return
        old = [(k, kind) for k, kind in self._folders() if (k, kind) not in now]
        self.read().repartitionByRange("domain", "url").sortWithinPartitions("domain", "url").write.mode("overwrite").parquet(f"{self.path}/base={now[-1][0] + 1}")
        for k, kind in old:
            fs, p = self._fs(f"{self.path}/{kind}={k}")
            fs.delete(p, True)
