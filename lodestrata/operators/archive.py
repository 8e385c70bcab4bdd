"""Archived dictionary versions with their terms, kept as intervals: a term is stored once for all the versions that have it alike.

store: org_id, type, standard_term, aliases, begin_no and end_no (the first version without it, null while it lives).
versions: org_id, type, version_no and any columns that tell of it; they stay when a snapshot is pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["org_id", "type"]
TERM = [*KEYS, "standard_term", "aliases"]
KEPT = 5


def next_numbers(versions: DataFrame, terms: DataFrame) -> DataFrame:
    """The number that the next version of each (org_id, type) of terms gets; numbers are never used again."""
    last = versions.groupBy(*KEYS).agg(F.max("version_no").alias("last"))
    return terms.select(*KEYS).distinct().join(last, KEYS, "left").select(*KEYS, (F.coalesce("last", F.lit(0)) + 1).alias("version_no"))


def archived(store: DataFrame, versions: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """store and versions with one more version of each (org_id, type) that terms (TERM) hold; a term that comes twice counts once.

    Rows that live on unchanged are not touched, those that are gone or have other aliases end, new ones begin. The
    order of aliases is part of a term. Types that terms don't hold keep their versions.
    """
    number = next_numbers(versions, terms)
    new = terms.select(*TERM).distinct()
    live = store.where("end_no is null").join(number, KEYS, "left_semi")
    same = [*KEYS, "standard_term", "aliases"]
    ended = live.join(new, same, "left_anti").join(number, KEYS).withColumn("end_no", F.col("version_no"))
    begun = new.join(live.select(*same), same, "left_anti").join(number, KEYS).select(*TERM, F.col("version_no").alias("begin_no"), F.lit(None).cast("long").alias("end_no"))
    stay = store.join(ended.select(*same, "begin_no"), [*same, "begin_no"], "left_anti")
    columns = store.columns
    return stay.unionByName(ended.select(*columns)).unionByName(begun.select(*columns)), versions.unionByName(number.select(*KEYS, F.col("version_no").cast("long").alias("version_no")), allowMissingColumns=True)


def history(snapshots: DataFrame) -> DataFrame:
    """The store of many whole snapshots (TERM and version_no, numbered from 1 without a gap): runs of versions that have a term alike.

    A version without any term of its type can't be told from one that isn't there, and ends all runs.
    """
    w = Window.partitionBy(*TERM).orderBy("version_no")
    rows = snapshots.select(*TERM, "version_no").distinct().withColumn("run", F.col("version_no") - F.row_number().over(w))
    last = snapshots.groupBy(*KEYS).agg(F.max("version_no").alias("last"))
    runs = rows.groupBy(*TERM, "run").agg(F.min("version_no").alias("begin_no"), F.max("version_no").alias("to_no")).drop("run").join(last, KEYS)
    return runs.select(*TERM, "begin_no", F.when(F.col("to_no") < F.col("last"), F.col("to_no") + 1).alias("end_no"))


def kept_versions(versions: DataFrame, keep: int = KEPT) -> DataFrame:
    """The newest versions of each (org_id, type), whose snapshots are kept."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("version_no")))
    return versions.withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__rank")


def as_of(store: DataFrame, versions: DataFrame, keep: int = KEPT) -> DataFrame:
    """TERM and version_no of every version whose snapshot is kept."""
    kept = kept_versions(versions, keep).select(*KEYS, "version_no")
    return store.join(kept, KEYS).where((F.col("begin_no") <= F.col("version_no")) & (F.col("end_no").isNull() | (F.col("end_no") > F.col("version_no")))).select(*TERM, "version_no")


def pruned(store: DataFrame, versions: DataFrame, keep: int = KEPT) -> DataFrame:
    """store without the rows that only pruned versions have."""
    oldest = kept_versions(versions, keep).groupBy(*KEYS).agg(F.min("version_no").alias("__oldest"))
    return store.join(oldest, KEYS, "left").where(F.col("end_no").isNull() | F.col("__oldest").isNull() | (F.col("end_no") > F.col("__oldest"))).select(*store.columns)


def listed(store: DataFrame, versions: DataFrame, keep: int = KEPT) -> DataFrame:
    """versions with term_count and snapshot_present (whether there is a snapshot to go back to)."""
    counts = as_of(store, versions, keep).groupBy(*KEYS, "version_no").agg(F.count("*").alias("term_count"))
    out = versions.join(counts, [*KEYS, "version_no"], "left").withColumn("term_count", F.coalesce("term_count", F.lit(0)))
    return out.withColumn("snapshot_present", F.col("term_count") > 0)


def rolled_back(store: DataFrame, versions: DataFrame, org_id: str, kind: str, version_no: int, keep: int = KEPT) -> DataFrame:
    """TERM of an archived version, to be imported again as the next one; a version that isn't there or was pruned is refused."""
    wanted = (F.col("org_id") == org_id) & (F.col("type") == kind)
    rows = as_of(store.where(wanted), versions.where(wanted), keep).where(F.col("version_no") == version_no).select(*TERM)
    if rows.isEmpty():
        raise ValueError(f"no snapshot of version {version_no} of {kind}")
    return rows


def imported(stored: DataFrame, store: DataFrame, versions: DataFrame, new: DataFrame, org_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An import that archives itself: the dictionary (org_id, type, standard_term, aliases) with an organisation's types replaced by
    those of new, and store and versions with what it has for them now, with the oldest snapshots pruned."""
    from lodestrata.operators.dictionary import replaced

    out = replaced(stored, new, org_id)
    changed = out.where(F.col("org_id") == org_id).join(new.select("type").distinct(), "type", "left_semi")
    store, versions = archived(store, versions, changed)
    return out, pruned(store, versions), versions
