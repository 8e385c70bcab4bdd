"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import SPACES, drop_dir, hidden, lower_ascii, stored, work_dir


def lines_of(text):
    """The lines of a text, split at \\n; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Counts of documents per line hash in levelled runs, each dealt into the same buckets by hash and sorted in them.

    A batch of documents adds one run to level 0. When a level holds `fanout` runs they are merged into one
    run of the next, so a hash is rewritten once a level and a lookup meets few runs. A run is a bucketed table
    whose files are below folder: two runs merge by a join of their sorted buckets without a shuffle, and a
    batch's hashes are dealt once to meet them. close() takes the tables out of the catalogue.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2, min_chars: int = 1, buckets: int | None = None):
        self.spark, self.folder, self.fanout, self.min_chars = spark, folder, fanout, min_chars
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _hashes(self, docs: DataFrame) -> DataFrame:
        keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
        return docs.select(F.explode(F.filter(keys, lambda k: F.length(k) >= self.min_chars)).alias("key")).select(F.unhex(F.md5("key")).alias("hash"))

    def _counted(self, docs: DataFrame) -> DataFrame:
        return self._hashes(docs).groupBy("hash").agg(F.count("*").alias("docs"))

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        run.sortWithinPartitions("hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_dir(self.spark, f"{self.folder}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """Two runs meet bucket by bucket in a merge join that shuffles nothing; each further one joins the result."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.join(self.spark.table(name).withColumnRenamed("docs", "more"), "hash", "full_outer")
            rows = rows.select("hash", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return rows

    def add(self, docs: DataFrame) -> None:
        """Adds the run of one batch (each document counts once for a key), then compacts full levels.

        A task sums its lines before they are dealt, so a line of all documents is one row a task.
        """
        counts = self._counted(docs)
        self._write(counts if self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions")) else counts.repartition(self.buckets, "hash"), 0)
        self.compact()

    def compact(self) -> None:
        """Merges every level that holds `fanout` runs or more into one run of the next."""
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fanout:
                self._write(self._merged(old), level + 1)
                self.levels[level] = []
                for name in old:
                    self._drop(name)
            level += 1

    def close(self) -> None:
        """Ends the runs: their tables and files go."""
        for name in (n for level in self.levels for n in level):
            self._drop(name)
        self.levels = [[]]

    def counts(self) -> DataFrame:
        """Documents per hash over all live runs."""
        live = [n for level in self.levels for n in level]
        return self._merged(live) if live else self.spark.createDataFrame([], "hash binary, docs long")

    def common(self, min_docs: int) -> DataFrame:
        """Hashes found in at least min_docs documents."""
        return self.counts().where(F.col("docs") >= min_docs).select("hash")


def drop_common(docs: DataFrame, common: DataFrame, min_chars: int = 1) -> DataFrame:
    """Drops the lines whose hash is in `common` from docs (doc_id, text and any other columns).

    Returns docs with text (lines left, joined by \\n), n_lines (before) and n_dropped. Only the line hashes
    travel to the merge join; rows that lose lines meet their text again by a key of the row's content.
    Repeated rows lose the same lines; a null doc_id is kept; no documents give no rows. Columns that are named
    n_lines or n_dropped before are replaced.
    """
    docs, names = hidden(docs)
    rows = docs.select("*", F.xxhash64("doc_id", "text").alias("__row"), F.md5(F.coalesce("text", F.lit(""))).alias("__md"))
    keyed = rows.select("__row", "__md", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("__at", "__key")).where(F.length("__key") >= min_chars)
    hit = keyed.select("__row", "__md", "__at", F.unhex(F.md5("__key")).alias("hash")).join(common, "hash", "left_semi")
    gone = hit.groupBy("__row", "__md").agg(F.collect_set("__at").alias("__gone"))
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    # The text is split once: an array of one binds its lines for all the places that stay.
    left = F.element_at(F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n")), 1)
    text = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("text")
    return rows.join(gone, ["__row", "__md"], "left").select(
        *(text if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    ).withColumnsRenamed(names)


def dedup_batch(runs: LineRuns, docs: DataFrame, min_docs: int = 1) -> DataFrame:
    """One step of a stream of batches: drops lines that the runs already hold, then adds the batch's own."""
    out = drop_common(docs, runs.common(min_docs), runs.min_chars)
    path = f"{runs.folder}/out/{uuid.uuid4().hex}"
    out.write.parquet(path)
    runs.add(docs)
    return runs.spark.read.schema(out.schema).parquet(path)


def dedup_corpus(spark: SparkSession, docs: DataFrame, min_docs: int = 10, batches: int = 4, min_chars: int = 1) -> DataFrame:
    """Drops every line whose key is in at least min_docs documents of docs (doc_id, text and any other columns).

    The corpus comes in `batches`, dealt by the hash of the text, each of which adds a run; all runs together
    tell which lines are common. A null or empty text is one empty line, repeated rows count each and lose the
    same lines, other columns stay as they are, and no documents give no rows; see drop_common.
    """
    folder = work_dir(spark, "lines")
    runs = LineRuns(spark, folder, min_chars=min_chars)
    try:
        for k in range(batches):
            runs.add(docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k))
        common = stored(runs.common(min_docs), f"{folder}/common")
    finally:
        runs.close()
    return drop_common(docs, common, min_chars)
