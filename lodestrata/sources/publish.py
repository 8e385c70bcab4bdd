"""A dictionary in storage, a folder for each type, of which only types whose contents differ are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types in a dictionary at most; the names of those that differ come to the driver.
MOST_TYPES = 10_000


def contents(terms: DataFrame) -> DataFrame:
    """type with an order-free digest of its entries."""
    entry = F.xxhash64("standard_term", F.array_sort("aliases"))
    return terms.groupBy("type").agg(F.count("*").alias("n"), F.sum(entry.cast("decimal(38,0)")).alias("h"))


def stale_types(stored: DataFrame, new: DataFrame) -> list[str]:
    """Types of new that stored lacks or has otherwise."""
    old = contents(stored).withColumnsRenamed({"n": "n0", "h": "h0"})
    rows = contents(new).join(old, "type", "left").where(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")))).select("type").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types differ")
    return sorted(r["type"] for r in rows)


def publish(new: DataFrame, path: str) -> list[str]:
    """Writes new (type, standard_term, aliases) to path; returns the types that were written.

    Folders of types that are as they were, or that new lacks, keep their files: the write overwrites the partitions
    that it has rows for and no other.
    """
    spark = new.sparkSession
    new = new.select("standard_term", "aliases", "type")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        types = stale_types(stored(spark, path), new)
    else:
        types = stale_types(new.limit(0), new)
    if types:
        new.where(F.col("type").isin(types)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(path)
    return types


def stored(spark, path: str) -> DataFrame:
    """The dictionary at path."""
    return spark.read.schema("standard_term string, aliases array<string>, type string").parquet(path)
