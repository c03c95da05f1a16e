"""Sets and queues that grow, against models, and what a level of them shuffles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webweft.operators import frontier, seen


def test_a_seen_set(spark):
    rng = random.Random(2)
    s, have = seen.SeenSet(spark, buckets=3), set()
    for n in (40, 30, 200, 5, 5, 0, 60):
        found = [(str(rng.randrange(400)),) for _ in range(n)] + [(None,)]
        df = spark.createDataFrame(found, "node string").groupBy("node").agg(F.lit(1).alias("x"))
        new = s.unseen(df).where("node is not null")
        want = {x for x, in found if x is not None} - have
        assert {r.node for r in new.collect()} == want
        t = s.add(new)
        assert t.rows == len(want) and {r.node for r in t.df.collect()} == want
        have |= want
        sizes = [t.rows for t in s.tables[:-1]]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and s.rows == len(have)
    assert {r.node for r in s.all().collect()} == have and s.all().count() == len(have)
    s.drop()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?:hash|range|Round|Single)", plan))


def test_a_level_shuffles_what_it_found_alone(spark):
    """However many tables are known, finding what is new takes the one exchange that groups what was found."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = seen.SeenSet(spark)
        for k in range(3):
            s.tables.append(seen.Bucketed(spark.range(100 * k, 100 * k + 100).selectExpr("string(id) AS node"), "node", s.buckets))
        found = spark.range(250, 350).repartition(3).selectExpr("string(id) AS node", "id AS parent", "0 AS pos")
        new = s.unseen(frontier._first_places(found))
        assert exchanges(new) == exchanges(frontier._first_places(found)) and new.count() == 50
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_queue_that_takes_offers_between_pops(spark, seed):
    rng = random.Random(seed)
    q, model, ever, seq, offered = seen.PriorityQueue(spark, 3), [], set(), 0, 0
    for turn in range(1, 7):
        batch = []
        for _ in range(rng.choice([0, 5, 40])):
            seq += rng.choice([0, 1])
            batch.append((f"i{rng.randrange(120)}", rng.randrange(-2, 3), seq))
        rows = spark.createDataFrame([*batch, (None, 1, 0), ("x", None, 0)], "item string, priority int, seq long")
        first = {}
        for item, p, s in batch:
            if item not in ever:
                first[item] = min(first.get(item, (s, p)), (s, p))
        assert q.offer(rows) == len(first)
        offered += len(batch)
        ever |= set(first)
        model += [(-p, turn, s, item) for item, (s, p) in first.items()]
        n = rng.choice([0, 1, 7, 25])
        model.sort()
        got = sorted((-r.priority, r.turn, r.seq, r["item"]) for r in q.pop(n).collect())
        assert got == model[:n]
        model = model[n:]
        assert q.stats() == {"queued": len(model), "total_added": len(ever), "duplicates_skipped": offered - len(ever)}
    assert sorted((-r.priority, r.turn, r.seq, r["item"]) for r in q.pop(10_000).collect()) == model
    assert q.queued == 0 and not q.parts and q.pop(5).count() == 0


def test_a_queue_of_nothing(spark):
    q = seen.PriorityQueue(spark)
    assert q.pop(3).count() == 0 and q.stats() == {"queued": 0, "total_added": 0, "duplicates_skipped": 0}
    assert q.offer(spark.createDataFrame([], "item string, priority int, seq long")) == 0 and q.pop(3).count() == 0
