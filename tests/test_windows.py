"""Tumbling rates of a stream against the same rows as a batch."""

from __future__ import annotations

from lodestrata.streaming import windows

SF = "/root/testdata/sf0.001"


def test_stream_counts_as_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "cast(ts as timestamp) as ts")
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = (
        windows.tumbling_rate(stream, "user_id", "ts", "1 hour", "10 days")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("tumbling")
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("tumbling").collect())
    assert got == sorted(tuple(r) for r in windows.tumbling_rate(rows, "user_id", "ts", "1 hour", "10 days").collect()) and got
