"""Files that arrive one after the other: checked as they come, good rows and refused ones kept apart, repeated texts dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import ingest


def deduplicated(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; on a stream, a key is remembered until the watermark, `late` behind the newest row, has passed it."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def cells(spark: SparkSession, folder: str, headers: list[str], files_a_batch: int = 100) -> DataFrame:
    """CSV files of a folder as a stream of text cells with their file and row (the line's place in it is not kept: row is a hash of the line)."""
    schema = ", ".join(f"`{h}` string" for h in headers)
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_a_batch).csv(folder)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.xxhash64(*(f"`{h}`" for h in headers)).alias("row"), *(f"`{h}`" for h in headers))


def start(stream: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Runs the checks on every batch that is there, then stops; a batch that is run again overwrites its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        rows = ingest.checked(ingest.mapped(batch)).persist()
        ingest.coerced(rows).write.mode("overwrite").parquet(f"{good}/batch={number}")
        ingest.refused(rows).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
