"""Sets of keys that grow level by level, and queues of what is still to do: written once, never shuffled again.

Keys lie in tables that are bucketed by hash and sorted. What is new among found keys takes a shuffle of those that were found:
they come to the buckets, which stay where they are. Tables of like size become one, so that of n there are some log n.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.stored import Stored, delete_at_end, shared_dir


class Bucketed:
    """A table in the shared folder, bucketed by a key and sorted."""

    def __init__(self, df: DataFrame, key: str, buckets: int, tag: str = "bucketed"):
        self.spark, self.key = df.sparkSession, key
        self.name = f"webweft_{tag}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{self.name}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(self.name)
        delete_at_end(self.spark, path)
        self.path, self.rows = path, self.df.count()  # from the files' footers

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class SeenSet:
    """Rows with distinct keys, to which levels are added."""

    def __init__(self, spark: SparkSession, key: str = "node", buckets: int | None = None):
        self.key = key
        # as many as a shuffle has partitions, so that what is grouped by the key lies like the buckets
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[Bucketed] = []

    def unseen(self, found: DataFrame) -> DataFrame:
        """Rows of found whose key is none of the set's; a null key is none. Group found by the key before, and it is shuffled once."""
        for t in self.tables:
            found = found.join(t.df.select(self.key), self.key, "left_anti")
        return found

    def add(self, rows: DataFrame) -> Bucketed:
        """Writes rows of the set's columns with keys that it has not. Returns their table, which stays until the next add at least."""
        new = Bucketed(rows, self.key, self.buckets, "seen")
        # of the earlier ones, none is less than twice as large as the one after it
        while len(self.tables) > 1 and self.tables[-2].rows < 2 * self.tables[-1].rows:
            b, a = self.tables.pop(), self.tables.pop()
            self.tables.append(Bucketed(a.df.union(b.df), self.key, self.buckets, "seen"))
            a.drop()
            b.drop()
        self.tables.append(new)
        return new

    def all(self) -> DataFrame:
        out = self.tables[0].df
        for t in self.tables[1:]:
            out = out.union(t.df)
        return out

    @property
    def rows(self) -> int:
        return sum(t.rows for t in self.tables)

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables = []


class PriorityQueue:
    """A queue over tables that takes offers while it gives out: the highest priority first, then first come.

    An item counts once, whenever it is offered again. Each offer is a table with a folder for each priority, in order, so
    that to pop reads the best priorities alone, from where the last pop ended. The driver keeps a count and
    that place for each priority; let priorities be classes, such as depths, not measures.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.seen, self.turn = spark, SeenSet(spark, "item", buckets), 0
        self.parts: dict[int, Stored] = {}  # by turn
        self.left: dict[tuple[int, int], int] = {}  # items by (priority, turn)
        self.place: dict[int, tuple] = {}  # by priority: turn, seq and item of the last one that was given out
        self.offered = self.given = 0

    def offer(self, items: DataFrame) -> int:
        """Takes (item, priority int, seq); seq is the order in which they come, after all earlier offers. Null items and
        priorities take no part. Returns how many are new."""
        rows = items.where("item is not null and priority is not null").select("item", F.col("priority").cast("int").alias("priority"), F.col("seq").cast("long").alias("seq"))
        first = rows.groupBy("item").agg(F.min(F.struct("seq", "priority")).alias("f")).select("item", "f.priority", "f.seq")
        new = self.seen.add(self.seen.unseen(first))
        self.offered += rows.count()
        part = Stored(new.df.repartitionByRange("priority", "seq", "item").sortWithinPartitions("priority", "seq", "item"), "queue", partition_by="priority")
        self.turn += 1
        self.parts[self.turn] = part
        for r in part.df.groupBy("priority").count().collect():
            self.left[r.priority, self.turn] = r["count"]
        return new.rows

    @property
    def queued(self) -> int:
        return sum(self.left.values())

    def pop(self, n: int) -> DataFrame:
        """(item, priority, seq, turn): the next n items, all if there are fewer; turn is the offer that brought them. They are stored."""
        best, have = [], 0
        by: dict[int, int] = {}
        for (p, _), k in self.left.items():
            by[p] = by.get(p, 0) + k
        for p in sorted(by, reverse=True):
            if have >= n:
                break
            if by[p]:
                best.append(p)
                have += by[p]
        rows = self.spark.createDataFrame([], self.seen.all().schema).withColumn("turn", F.lit(0)) if self.seen.tables else self.spark.createDataFrame([], "item string, priority int, seq long, turn int")
        for turn, part in self.parts.items():
            some = [p for p in best if self.left.get((p, turn))]
            if some:
                rows = rows.unionByName(part.df.where(F.col("priority").isin(some)).withColumn("turn", F.lit(turn)))
        for p in best:
            if p in self.place:
                turn, seq, item = self.place[p]
                last = F.struct(F.lit(turn).cast("int").alias("turn"), F.lit(seq).cast("long").alias("seq"), F.lit(item).cast(rows.schema["item"].dataType).alias("item"))
                rows = rows.where((F.col("priority") != p) | (F.struct("turn", "seq", "item") > last))
        if have > n:
            rows = rows.orderBy(F.desc("priority"), "turn", "seq", "item").limit(n)
        out = Stored(rows.select("item", "priority", "seq", "turn"), "popped")
        # a row for each priority and offer
        for r in out.df.groupBy("priority", "turn").agg(F.count("*").alias("n"), F.max(F.struct("turn", "seq", "item")).alias("last")).collect():
            self.left[r.priority, r.turn] -= r.n
            self.given += r.n
            if not self.left[r.priority, r.turn]:
                del self.left[r.priority, r.turn]
            self.place[r.priority] = max(self.place.get(r.priority, tuple(r["last"])), tuple(r["last"]))
        for turn in [t for t in self.parts if not any(t == own for _, own in self.left)]:
            self.parts.pop(turn).drop()
        return out.df

    def stats(self) -> dict[str, int]:
        return {"queued": self.queued, "total_added": self.seen.rows, "duplicates_skipped": self.offered - self.seen.rows}
