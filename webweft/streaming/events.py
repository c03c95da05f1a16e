"""Structured Streaming twins: statistics and breakers over a stream of page events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webweft.operators.breaker import Breaker, Machine
from webweft.stored import shared_dir

STATE = "state string, results array<boolean>, opened_at long, opened int, rejected int, probes int"
OUT = "domain string, state string, opened_times int, rejected int, failures int, calls int"


def stats(events: DataFrame, watermark: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Counts by window and status; late rows count up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum("size").alias("size"))


def breakers(events: DataFrame, breaker: Breaker = Breaker()) -> DataFrame:
    """OUT rows: each domain's state after each batch, from a stream (domain, us, id, ok). State is a few values a domain."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Machine(breaker, *state.get) if state.exists else Machine(breaker)
        rows = pd.concat(parts).sort_values(["us", "id"])
        for us, ok in zip(rows["us"], rows["ok"]):
            m.request(int(us), None if pd.isna(ok) else bool(ok))
        state.update(m.values())
        yield pd.DataFrame([(key[0], m.state, m.opened, m.rejected, m.failures, len(m.results))], columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("domain").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """All rows that a stream gives of what is there now; written as Parquet in the shared folder."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/{n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{at}/out")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the last batch."""
    keep = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), "batch").alias("r")).select(key, "r.*")
