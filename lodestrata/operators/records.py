"""Record lists, lookups and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null, composed, first_filled
from lodestrata.operators.filters import page, page_size

#: Lookup tables up to this many rows are broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it, behind a check of its size."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def summaries(records: DataFrame) -> DataFrame:
    """id and one line about each record: the first filled of complaint and diagnoses, cut to 40 characters."""
    return records.select("id", first_filled("chief_complaint", "tcm_diagnosis", "western_diagnosis").alias("summary"))


def nlp_text(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """id and the text that extraction reads: all filled columns, each ended by a full stop."""
    return records.select("id", composed(*columns).alias("text"))


def completeness(records: DataFrame, labels: dict[str, str]) -> DataFrame:
    """id, how many of the labelled columns are filled, and the labels of those that aren't."""
    filled = {c: blank_to_null(F.col(c).cast("string")).isNotNull() for c in labels}
    present = sum((F.when(f, 1).otherwise(0) for f in filled.values()), F.lit(0))
    missing = F.array_compact(F.array(*(F.when(~f, F.lit(labels[c])) for c, f in filled.items())))
    return records.select("id", present.alias("present"), F.array_join(missing, "、").alias("missing"))


def looked_up(df: DataFrame, names: DataFrame, key: str, name: str, default: str = "—") -> DataFrame:
    """df with the name of its key from a lookup table (key, name); unknown keys get the default."""
    return df.join(small(names.select(key, name)), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def primary_org(members: DataFrame, orgs: DataFrame) -> DataFrame:
    """The active primary organisation of each user (members: user_id, org_id, is_primary; orgs: org_id, status): the smallest id where there are several."""
    live = members.where("is_primary").join(small(orgs.where("status = 'active'").select("org_id")), "org_id")
    return live.groupBy("user_id").agg(F.min("org_id").alias("org_id"))


def prefix_list(users: DataFrame, column: str, text: str, most: int = 20) -> DataFrame:
    """Users whose name holds the text (of two characters or more; a shorter one finds nothing), by name."""
    hit = F.col(column).contains(text) if len(text.strip()) >= 2 else F.lit(False)
    return users.where(hit).orderBy(column).limit(most)


def truncated_list(df: DataFrame, order: list[Column], most: int = 50) -> DataFrame:
    """The first `most` rows and whether there are more; one row more than these is read."""
    some = df.orderBy(*order).limit(most + 1)
    more = some.agg((F.count("*") > most).alias("truncated"))
    return some.orderBy(*order).limit(most).crossJoin(more)  # one row


def counted_page(df: DataFrame, order: list[Column], number: int = 1, size: int | None = None, default: int | None = None) -> DataFrame:
    """A page with the total of all rows. default: the size where none is given (record search: 20); else the clamp decides."""
    size = default if default is not None and (size is None or size <= 0) else page_size(size)
    return page(df, order, number, size).crossJoin(df.agg(F.count("*").alias("total")))  # one row
