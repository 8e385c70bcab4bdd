"""Stateful streams against the same rows as a batch, in any order of arrival, over restarts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import stateful, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    for k, v in stateful.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k in stateful.PROVIDER:
        spark.conf.unset(k)


def run(stream, folder, name):
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)


def test_rates_equal_the_batch_in_any_order(rocks, tmp_path):
    rows = rocks.read.parquet(f"{SF}/events.parquet").where("user_id % 7 = 0").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).limit(600)
    rows = rows.unionByName(rows.limit(40).withColumn("event_id", F.col("event_id") + 10_000_000)).persist()  # ties
    span = rows.agg(F.min("ts"), F.max("ts")).first()
    whole = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    for k in range(3):  # files out of order of time
        whole.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = rocks.createDataFrame([(-1, -1, span[1] + datetime.timedelta(days=4000))], "user_id long, event_id long, ts timestamp")
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rate = stateful.sliding_rate(stream, "user_id", "event_id", "ts", 86_400, 2, "3000 days")
    run(rate, tmp_path, "out")
    assert rocks.read.parquet(f"{tmp_path}/out").count() == 0  # all still wait
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(rate, tmp_path, "out")
    got = sorted((int(r["key"]), r["event"], r["n"], r["limited"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r["user_id"], r["event_id"], r["n"], r["limited"]) for r in windows.sliding_rate(rows, "user_id", "ts", 86_400, 2).collect())
    assert got == want and any(r[3] for r in got) and any(r[2] > 1 for r in got)


def test_texts_pass_once_over_files_restarts_and_runs(rocks, tmp_path):
    docs = rocks.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)).unionByName(rocks.createDataFrame([(-1, None)], "doc_id long, text_hash string")).persist()
    stored = docs.select("text_hash").where("text_hash < '4'")

    def add(k):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    (tmp_path / "in").mkdir()
    stream = rocks.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.first_texts(stream, stored)
    for k in range(4):
        add(k)
        if k != 1:  # a run of two files too
            run(out, tmp_path, "one")
    run(out, tmp_path, "one")  # nothing new
    first = [r["text_hash"] for r in rocks.read.parquet(f"{tmp_path}/one").collect()]
    want = {r["text_hash"] for r in docs.where("text_hash >= '4'").collect()}
    assert sorted(first) == sorted(want)
    # Another run, with a checkpoint of its own, begins with what is stored by now.
    again = stateful.first_texts(stream, stored.unionByName(rocks.read.parquet(f"{tmp_path}/one").select("text_hash")))
    run(again, tmp_path, "two")
    assert rocks.read.schema(docs.schema).parquet(f"{tmp_path}/two").count() == 0
