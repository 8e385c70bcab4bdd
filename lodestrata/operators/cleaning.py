"""Cleaning of records: what happens to each, why, and in numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null, trim_change
from lodestrata.operators.entities import unparsable
from lodestrata.schema import INVALID, QUALIFIED

TRIMMED = ("gender", "age", "pattern", "prescription")
NARRATIVE = ("chief_complaint", "tcm_diagnosis", "present_illness", "self_report")


def first_of(df: DataFrame, key: str) -> DataFrame:
    """key and the id that comes first in (visit_time desc, id) among its rows; by partial aggregation, so a hot key is no sort."""
    order = F.struct(F.col("visit_time").isNull().alias("none"), (-F.unix_micros(F.col("visit_time").cast("timestamp"))).alias("t"), "id")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order)["id"].alias("__first"))


def later_copies(df: DataFrame, key: str) -> Column:
    return F.col("__first").isNotNull() & (F.col("id") != F.col("__first"))


def with_actions(df: DataFrame, skip_normalize: bool = False, document: str = "structured_data") -> DataFrame:
    """df (id, visit_time, status, grade, text_hash, manually_edited and the text columns) with action, repaired and cleared.

    skipped: invalid before, its text isn't remembered; deduped: a later copy of a text; isolated: no narrative, or
    a document that is no JSON; marked: qualified and only marked as governed (edited by hand, or normalising is
    off); normalized: qualified with a document; kept: all others. repaired counts columns that trimming changes,
    cleared those that held blanks alone; a skipped or deduped row has the latter two only as far as it is written.
    """
    live = F.col("status") != "invalid"
    rows = df.join(first_of(df.where(live), "text_hash"), "text_hash", "left")
    copy = later_copies(rows, "text_hash")
    changes = [trim_change(c) for c in TRIMMED]
    count = lambda kinds: reduce(lambda a, b: a + b, (F.when(c.isin(*kinds), 1).otherwise(0) for c in changes))
    blank = reduce(lambda a, b: a & b, (blank_to_null(c).isNull() for c in NARRATIVE))
    parsed = F.col(document).isNotNull()
    good = (F.col("grade") == QUALIFIED) & parsed
    action = (
        F.when(~live, "skipped")
        .when(copy, "deduped")
        .when(blank | unparsable(F.col(document)), "isolated")
        .when(F.coalesce(good, F.lit(False)), F.when(F.lit(skip_normalize) | F.col("manually_edited"), "marked").otherwise("normalized"))
        .otherwise("kept")
    )
    out = rows.withColumn("action", action).drop("__first")
    touched = ~F.col("action").isin("skipped", "deduped")
    return out.withColumn("repaired", F.when(touched, count(("trimmed", "cleared"))).otherwise(0)).withColumn("cleared", F.when(touched, count(("cleared",))).otherwise(0))


def cleaned(actions: DataFrame) -> DataFrame:
    """The table after cleaning: trimmed columns, and grade, status and governed as the action tells. Applying it again changes nothing."""
    gone = F.col("action").isin("deduped", "isolated")
    out = actions
    for c in TRIMMED:
        out = out.withColumn(c, F.when(F.col("action") == "skipped", F.col(c)).otherwise(blank_to_null(c)))
    return out.withColumn("status", F.when(gone, "invalid").otherwise(F.col("status"))).withColumn("grade", F.when(gone, INVALID).otherwise(F.col("grade"))).withColumn("governed", F.when(F.col("action").isin("marked", "normalized"), True).otherwise(F.col("governed") & ~gone))


def closed_reviews(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks (record_id, is_obsolete, ...) after cleaning: those of deduped and isolated records are obsolete."""
    gone = actions.where(F.col("action").isin("deduped", "isolated")).select(F.col("id").alias("record_id"), F.lit(True).alias("__gone"))
    return tasks.join(gone, "record_id", "left").withColumn("is_obsolete", F.col("is_obsolete") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def counts(actions: DataFrame) -> DataFrame:
    """Rows of each action, and what trimming repaired and cleared in them."""
    return actions.groupBy("action").agg(F.count("*").alias("n"), F.sum("repaired").alias("repaired"), F.sum("cleared").alias("cleared"))


ACTIONS = ("skipped", "deduped", "isolated", "marked", "normalized", "kept")


def observed(actions: DataFrame) -> tuple[DataFrame, Observation]:
    """actions and their figures (action_n, action_repaired and action_cleared for each action), to be read after any action on
    the rows; they equal counts() without another pass."""
    figures, own = Observation(), lambda a: F.col("action") == a
    each = [x for a in ACTIONS for x in (F.count_if(own(a)).alias(f"{a}_n"), F.sum(F.when(own(a), F.col("repaired")).otherwise(0)).alias(f"{a}_repaired"), F.sum(F.when(own(a), F.col("cleared")).otherwise(0)).alias(f"{a}_cleared"))]
    return actions.observe(figures, *each), figures


def write_back(records: DataFrame, changed: DataFrame, columns: tuple[str, ...] = ("structured_data", "qc_results", "score", "grade", "status", "governed")) -> DataFrame:
    """records with the derived columns of changed (by id); original columns can't be written, whatever changed holds."""
    given = [c for c in columns if c in changed.columns]
    new = changed.select("id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in given))
    both = records.join(new, "id", "left")
    return both.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in records.columns))
