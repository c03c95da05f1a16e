"""Formats for df.write: what they write, and that a task that fails leaves nothing behind."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from webweft.operators import store
from webweft.operators.store import PageStore
from webweft.sources import readers, writers


@pytest.fixture(scope="module")
def records(spark):
    writers.register(spark)
    rows = [(f"http://s{k % 3}.test/{k}", f"t,{k}\n\"q\" ü", None if k == 2 else "x\0y", [f"http://a/{k}"], '{"n":%d}' % k, 200 if k % 2 else None, "text/html") for k in range(23)]
    df = spark.createDataFrame(rows, "url string, title string, text string, links array<string>, metadata string, status_code int, content_type string")
    return df.withColumn("crawled_at", F.timestamp_seconds(F.lit(1_700_000_000))).select(*store.FIELDS).repartition(4)


def failing(df, word="http://s1.test/7"):
    """df, one of whose rows makes its task fail."""
    return df.withColumn("title", F.when(F.col("url") == word, F.raise_error(F.lit("asked for"))).otherwise(F.col("title")))


def left_over(folder):
    return [x for x in os.listdir(folder) if "staging" in x]


@pytest.mark.parametrize("kind", ["webweft_json", "webweft_csv"])
@pytest.mark.parametrize("single", ["true", "false"])
def test_text_formats(spark, records, tmp_path, kind, single):
    path = str(tmp_path / "out")
    records.write.format(kind).mode("overwrite").option("single", single).save(path)

    def rows():
        files = [path] if single == "true" else sorted(f"{path}/{x}" for x in os.listdir(path) if x.startswith("part-"))
        out = []
        for f in files:
            text = open(f, encoding="utf-8", newline="").read()
            if kind == "webweft_csv":
                out += [(r["url"], r["title"], json.loads(r["links"]), r["status_code"]) for r in csv.DictReader(text.splitlines(True))]
            else:
                got = json.loads(text) if single == "true" else [json.loads(x) for x in text.splitlines()]
                out += [(r["url"], r["title"], r["links"], "" if r["status_code"] is None else str(r["status_code"])) for r in got]
        return sorted(out)

    want = sorted((r.url, r.title, r.links, "" if r.status_code is None else str(r.status_code)) for r in records.collect())
    assert rows() == want and not left_over(tmp_path)
    with pytest.raises(Exception, match="asked for"):
        failing(records).write.format(kind).mode("overwrite").option("single", single).save(path)
    assert rows() == want and not left_over(tmp_path)
    records.limit(0).write.format(kind).mode("overwrite").option("single", single).save(path)
    assert rows() == []
    if single == "false":
        records.write.format(kind).mode("append").save(path)
        records.write.format(kind).mode("append").save(path)
        assert rows() == sorted(want * 2)


def test_encodings(spark, records, tmp_path):
    path = str(tmp_path / "e.csv")
    records.select("url", "title").write.format("webweft_csv").mode("overwrite").options(single="true", encoding="utf-8-sig", delimiter=";").save(path)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfurl;title\n") and raw.count(b"\xef\xbb\xbf") == 1
    records.select(F.lit("日本 ü").alias("x")).write.format("webweft_csv").mode("overwrite").options(single="true", encoding="cp1252").save(path)
    assert set(open(path, encoding="cp1252").read().splitlines()) == {"x", "?? ü"}
    for bad in ({"single": "true"},):
        with pytest.raises(Exception, match="overwrite"):
            records.write.format("webweft_json").mode("append").options(**bad).save(path)


def test_the_array_is_read_back(spark, records, tmp_path):
    path = str(tmp_path / "a.json")
    records.write.format("webweft_json").mode("overwrite").option("single", "true").save(path)
    assert readers.read_json(spark, path).select("url").distinct().count() == 23


def test_the_store(spark, records, tmp_path):
    path = str(tmp_path / "store")
    writers.register(spark)
    again = records.limit(5).withColumn("title", F.lit("later")).unionByName(records.limit(0))
    records.unionByName(records).write.format("webweft_store").mode("append").save(path)
    s = PageStore(spark, path)
    assert s.read().count() == 23 and s.read().select("url").distinct().count() == 23
    with pytest.raises(Exception, match="asked for"):
        failing(records).write.format("webweft_store").mode("append").save(path)
    assert s.read().count() == 23 and not left_over(tmp_path)
    again.write.format("webweft_store").mode("append").save(path)
    assert s.read().where("title = 'later'").count() == again.select("url").distinct().count() and s.read().count() == 23
    s.save(records)
    assert s.read().where("title = 'later'").count() == 0
    s.compact()
    assert s.read().count() == 23
    with pytest.raises(Exception, match="append"):
        records.write.format("webweft_store").mode("overwrite").save(path)
    with pytest.raises(Exception, match="lack"):
        records.drop("links").write.format("webweft_store").mode("append").save(path)


def test_paths():
    assert writers.local("file:///tmp/x") == "/tmp/x"
    for bad in ("", None, "s3://b/x"):
        with pytest.raises(ValueError):
            writers.local(bad)


def test_the_memory_sink_is_bounded(spark, records):
    from webweft.sources import sinks

    small = sinks.MemorySink(most=30)
    assert small.write(records) == 23
    with pytest.raises(sinks.StorageError, match="more than 30"):
        small.write(records)
    assert len(small.rows) == 23
