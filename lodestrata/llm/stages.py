"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate as decontamination
from lodestrata.llm import line_dedup, ngram_join, packing, quality
from lodestrata.llm.common import hidden


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls of low quality or toxic go.

    A null or empty text is judged as such, repeated rows alike, columns stay as they are; no documents, no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(spark, docs, labels).where("keep").select(*docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars follows the new text.

    A null text becomes an empty one, repeated rows count and lose lines each, other columns stay; no documents, no rows.
    """
    out = line_dedup.dedup_corpus(spark, docs, min_docs=10)
    return out.select(*(F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest doc_id (rows without one come last), then text hash.

    Rows are told apart by doc_id and text, so another text under the same doc_id stays; of equal rows one
    stays. Texts without words are in no group and all stay. No documents give no rows.
    """
    docs, names = hidden(docs)
    key = ["__id", "__h"]
    found = ngram_join.groups(spark, docs).select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("h").alias("__h"), "n_shingles", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "__id", "__h")).alias("first")
    stay = found.where("n_shingles > 0").groupBy("root").agg(first).select("first.__id", "first.__h")
    twice = found.where("n_shingles > 0").groupBy(*key).count().where("count > 1").select(*key).join(stay, key, "left_semi")
    rows = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.xxhash64("text").alias("__h"))
    kept = rows.join(stay.unionByName(found.where("n_shingles = 0").select(*key)), key, "left_semi")
    if not twice.isEmpty():
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns).withColumnsRenamed(names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or empty text holds none, equal rows go or stay together, columns stay as they are; an empty benchmark
    leaves all documents, no documents give no rows.
    """
    found = decontamination.matches(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens.

    A null or empty text is its end id, repeated rows are packed each, other columns are ignored; no documents, no rows.
    """
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", 0, 2048)
