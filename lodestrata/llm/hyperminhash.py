"""Near duplicates by HyperMinHash registers in bands, estimated similarities and exact confirmation.

1. `signatures`: a text's shingle set as a class (equal sets share one) with REGISTERS buckets. A bucket keeps of its
   least hash the number of leading zeros and the bits after them, 16 bits together. An empty bucket takes the
   register of another one, drawn alike for all sets, so that two sets' registers agree with the chance of their
   Jaccard similarity, however small the sets are.
2. `bands`: classes that agree in all registers of a band meet. At a similarity of 0.85 all bands differ with a chance
   of 1e-8, as 32 bands of 5 registers are independent draws.
3. `estimated`: of those that meet, pairs whose estimate (agreements less those that colliding registers give) lies
   more than MARGIN deviations below the threshold go.
4. What is left are clusters, in which links are confirmed on full sets by the block searches of `ngram_join`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import mix64, parts_for, stored, tidy, work_dir
from lodestrata.llm.components import components
from lodestrata.llm.ngram_join import BROADCAST_ROWS, LONG_LIST, TASK_MEMBERS, _sets, candidates, class_of, links

WORDS, PERCENT = 3, 85
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Bits of a register for leading zeros, and for the mantissa.
ZEROS, MANTISSA = 6, 10
#: Lists of a band with up to one member more give all their pairs; a longer one's members meet in one task.
SHORT_LIST = 3
#: Standard deviations by which an estimate may be too low: of 10**8 links one is missed at most.
MARGIN = 5.7
#: Draws for an empty bucket, before the nearest full one to its right is taken.
DRAWS = 64
_PLACES = (mix64(np.arange(REGISTERS * DRAWS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64).reshape(DRAWS, REGISTERS)


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS numbers of 16 bits for a set that isn't empty."""
    h = mix64(shingles + np.uint64(0x9E3779B97F4A7C15))
    bucket = (h % np.uint64(REGISTERS)).astype(np.int64)
    rest = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, bucket, rest)
    full = np.zeros(REGISTERS, bool)
    full[bucket] = True
    # Leading zeros, at most 63, and the bits after the first one.
    zeros = np.zeros(REGISTERS, np.uint64)
    top = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = top < (np.uint64(1) << np.uint64(64 - step))
        zeros[high] += np.uint64(step)
        top[high] <<= np.uint64(step)
    mantissa = (top << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~full)
    source = np.arange(REGISTERS)
    for draw in _PLACES:
        if not len(empty):
            break
        hit = full[draw[empty]]
        source[empty[hit]] = draw[empty[hit]]
        empty = empty[~hit]
    if len(empty):
        some = np.flatnonzero(full)
        source[empty] = some[np.searchsorted(some, empty) % len(some)]
    return out[source]


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that a bucket's registers agree though the least hashes differ, for sets of n and m shingles.

    Least hashes of buckets with x and y shingles fall in the same cell (a number of leading zeros and a mantissa) of
    width w at height t with a chance of about x * y * exp(-t * (x + y)) * w * w; the sum over all cells follows.
    """
    x, y = np.maximum(np.asarray(n, float) / REGISTERS, 1), np.maximum(np.asarray(m, float) / REGISTERS, 1)
    z = np.arange(1, 64)[:, None]
    low = 0.5**z
    width = low / (1 << MANTISSA)
    middle = 1.5 * low
    return np.sum(x * y * np.exp(-middle * (x + y)) * width * width * (1 << MANTISSA), axis=0)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of registers that agree, corrected for collisions."""
    chance = collisions(n, m)
    return np.clip((agree / REGISTERS - chance) / (1 - chance), 0, 1)


def may_link(agree: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n and m shingles with so many registers in common may reach the similarity.

    The deviation counts the shingles or buckets, whichever are fewer: a small set's registers are drawn from few.
    """
    n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
    least = percent / 100
    free = np.minimum(np.maximum(np.maximum(n, m), 1) / 2, REGISTERS / 2)
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & (estimate(agree, n, m) >= least - MARGIN * np.sqrt(least * (1 - least) / free))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, class (c), text hash (h), set size (n) and registers (m; null for an empty set) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n, m = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, s in _sets(batch, words):
                if len(s):
                    c[i], n[i], m[i] = class_of(s), len(s), registers(s).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c), batch.column(2), pa.array(n), pa.array(m, pa.binary())], ["doc_id", "c", "h", "n", "m"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, c long, h long, n long, m binary")


def bands(classes: DataFrame) -> DataFrame:
    """Band keys (t) of classes (c, n, m), with n and p = 0, as lists that candidates() takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            wide = r[:, :, 0] | (r[:, :, 1] << np.uint64(16)) | (r[:, :, 2] << np.uint64(32)) | (r[:, :, 3] << np.uint64(48))
            keys = mix64(mix64(wide + seed) + r[:, :, 4]).view(np.int64).ravel()
            c, n = (np.repeat(batch.column(k).to_numpy(), BANDS) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c), pa.array(n.astype(np.int32)), pa.array(np.zeros(len(c), np.int32))], ["t", "c", "n", "p"])

    return classes.select("c", "n", "m").mapInArrow(run, "t long, c long, n int, p int")


def _matrix(maps) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(m) for m in maps), np.uint16).reshape(-1, REGISTERS)


def forest_of(classes: np.ndarray, sizes: np.ndarray, maps: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that span the parts of a band's list between which estimates rule out every link."""
    by = np.lexsort((classes, sizes))
    classes, sizes, maps = classes[by], sizes[by].astype(np.int64), maps[by]
    label, out = np.arange(len(classes)), []
    for k in range(1, len(classes)):
        i = np.flatnonzero((label[:-k] != label[k:]) & (100 * sizes[:-k] >= percent * sizes[k:]))
        if not len(i):
            if (label == label[0]).all():
                break
            continue
        agree = (maps[i] == maps[i + k]).sum(axis=1)
        for x in i[may_link(agree, sizes[i], sizes[i + k], percent)]:
            if label[x] != label[x + k]:
                out.append((int(classes[x]), int(classes[x + k])))
                label[label == label[x + k]] = label[x]
    return out


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT, most: int = LONG_LIST) -> DataFrame:
    """Pairs (a, b) that connect all that may link by their estimates; classes: c, n and registers m.

    Pairs of short lists (t is null) are tested one by one. A long list of up to `most` members meets in one task,
    a longer one stays tied to its first member: its members' links are then told apart by the exact test alone.
    """
    x, y = (classes.select(F.col("c").alias(k), F.col("n").alias("n" + k), F.col("m").alias("m" + k)) for k in "ab")
    short = pairs.where("t is null").select("a", "b").distinct().join(x, "a").join(y, "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n, m = (batch.column(k).to_numpy() for k in range(4))
                agree = (_matrix(batch.column(4).to_pylist()) == _matrix(batch.column(5).to_pylist())).sum(axis=1)
                stay = may_link(agree, n, m, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[stay]), pa.array(b[stay])], ["a", "b"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest_of(part["c"].to_numpy(), part["n"].to_numpy(), _matrix(part["m"]), percent), columns=["a", "b"], dtype=np.int64)

    short = short.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(test, "a long, b long")
    ties = pairs.where("t is not null").distinct()
    total = ties.count()
    if not total:
        return short
    ties = ties.join(ties.groupBy("t").agg(F.count("*").alias("k")), "t")
    inside = ties.where(F.col("k") < most)
    members = inside.select("t", F.col("b").alias("c")).unionByName(inside.select("t", F.col("a").alias("c")).distinct()).join(classes, "c")
    parts = parts_for(pairs.sparkSession, total, TASK_MEMBERS)
    return short.unionByName(members.repartition(parts, "t").groupBy("t").applyInPandas(run, "a long, b long")).unionByName(ties.where(F.col("k") >= most).select("a", "b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id) for docs (doc_id, text).

    Two texts link when 100 * common >= percent * union of their shingle sets, confirmed on the full sets; fewer words
    make one shingle. A text without words or a null has no shingles and links with nothing. Repeated rows give a row
    each. A null doc_id never names a component unless all its members lack one, and its row is kept if it does. Other
    columns are ignored; no documents, no rows.
    """
    folder = work_dir(spark, "hyperminhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(signatures(docs, words), folder + "/signatures")
    classes = stored(found.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("m").alias("m")), folder + "/classes")
    met = stored(candidates(bands(classes), percent, SHORT_LIST), folder + "/met")
    pairs = stored(estimated(met, classes, percent), folder + "/pairs")
    tied = components(spark, pairs, folder + "/clusters")
    clusters = stored(tied.select(F.col("node").alias("c"), F.col("root").alias("cluster")).unionByName(tied.select(F.col("root").alias("c"), F.col("root").alias("cluster")).distinct()), folder + "/members")

    # One row's text stands for each class in a cluster.
    lowest = F.lit(-(1 << 63))
    stand = found.where("n > 0").join(clusters.select("c"), "c", "left_semi").groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", lowest).alias("doc_id"), "h")).alias("r"))
    stand = stored(stand.select("c", "r.doc_id", "r.h"), folder + "/stand")
    total = stand.count()
    texts = docs.select(F.coalesce("doc_id", lowest).alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    texts = texts.join(F.broadcast(stand) if total <= BROADCAST_ROWS else stand, ["doc_id", "h"]).select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in _sets(batch, words)], pa.binary())], ["c", "s"])

    sets = stored(texts.mapInArrow(run, "c long, s binary"), folder + "/sets")
    if sets.count() > total:  # repeated rows
        sets = sets.dropDuplicates(["c"])
    roots = components(spark, links(spark, sets, clusters, folder + "/blocks", percent), folder + "/roots")

    named = found.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "c"), "c", "left")
    named = named.select("c", "least", F.coalesce("root", "c").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("c", "component_id")
    size = F.col("n").alias("n_shingles")
    out = found.where("n > 0").join(named, "c").select("doc_id", size, "component_id").unionByName(found.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id")))
    return tidy(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), folder)
