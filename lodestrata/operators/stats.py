"""Dashboard aggregates: counts, trends, rates, histograms, frequencies and deductions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null, month_of, percent
from lodestrata.schema import INVALID, PENDING, QUALIFIED, SCORE_BUCKETS, UNGRADED, UNKNOWN_DEPARTMENT


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def grade_counts(df: DataFrame, *keys: Column | str) -> DataFrame:
    """total, qualified, pending and invalid, whole or by key."""
    grade = F.col("grade")
    return df.groupBy(*keys).agg(F.count("*").alias("total"), count_where(grade == QUALIFIED).alias("qualified"), count_where(grade == PENDING).alias("pending"), count_where(grade == INVALID).alias("invalid"))


def overview(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """Counts of the filtered rows, and what waits for review in all rows in scope (`pending_global`)."""
    waiting = everything.agg(count_where(F.col("grade") == PENDING).alias("pending_global"))
    both = grade_counts(filtered).crossJoin(waiting)  # one row each
    return both.withColumn("rate", percent(F.col("qualified"), F.col("total")))


def governance_counts(df: DataFrame) -> DataFrame:
    good, done = F.col("grade") == QUALIFIED, F.col("governed")
    return df.agg(count_where(good).alias("qualified"), count_where(good & done).alias("governed"), count_where(good & ~done).alias("pending_govern"))


def month_trend(df: DataFrame) -> DataFrame:
    """Graded rows by month; months in which nothing is graded are left out."""
    out = df.groupBy(month_of("visit_time").alias("month")).agg(F.count("*").alias("total"), count_where(F.col("grade") == QUALIFIED).alias("qualified"), F.count("grade").alias("graded"))
    return out.where("graded > 0").drop("graded")


def last_months(trend: DataFrame, n: int = 12) -> DataFrame:
    """The latest n months with a flag that tells whether there are more. Months are few, so one window holds them."""
    known = trend.where("month is not null")
    ranked = known.withColumn("rn", F.row_number().over(Window.orderBy(F.col("month").desc()))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > n)
    return ranked.where(F.col("rn") <= n).drop("rn")


def department_rates(df: DataFrame) -> DataFrame:
    """Counts and share of qualified rows by department; a blank one has a name of its own."""
    name = F.coalesce(blank_to_null("department"), F.lit(UNKNOWN_DEPARTMENT))
    out = df.groupBy(name.alias("department")).agg(F.count("*").alias("total"), count_where(F.col("grade") == QUALIFIED).alias("qualified"))
    return out.withColumn("rate", percent(F.col("qualified"), F.col("total")))


def score_histogram(df: DataFrame) -> DataFrame:
    """All five score bands in order, also those without rows; a null score is in none."""
    names = F.array(*(F.lit(f"{a}-{b}") for a, b in SCORE_BUCKETS))
    bands = df.sparkSession.range(1).select(F.posexplode(names).alias("position", "bucket"))
    band = reduce(lambda c, x: c.when(F.col("score").between(*x[1]), x[0]), enumerate(SCORE_BUCKETS), F.when(F.lit(False), -1))
    counts = df.where("score is not null").groupBy(band.alias("position")).agg(F.count("*").alias("n"))
    return bands.join(F.broadcast(counts), "position", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def term_frequency(entities: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent terms of each kind, ties by term (kind, content)."""
    term = F.trim("content")
    counts = entities.where(F.coalesce(term, F.lit("")) != "").groupBy("kind", term.alias("term")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), F.asc("term")))
    return counts.withColumn("rn", rank).where(F.col("rn") <= top)


def pattern_frequency(entities: DataFrame, records: DataFrame, top: int = 10) -> DataFrame:
    """Pattern terms of the structured list, or, for records without any, pieces of the raw column."""
    listed = entities.where("kind = 'pattern'")
    raw = records.join(listed.select(F.col("record_id").alias("id")).distinct(), "id", "left_anti").select(F.explode(F.split("pattern", "[、，；;,]")).alias("content"))
    terms = listed.select("content").unionByName(raw).select(F.trim("content").alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("term")).limit(top)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(blank_to_null(column).alias("value")).where("value is not null").distinct()


def deduction_stats(deductions: DataFrame, top: int = 20) -> DataFrame:
    """Counts and points by type, by (type, item) and in all, in one pass; the items of most points are kept.

    deductions: type, item, points. grouping: 0 a pair, 1 a type, 3 everything.
    """
    sums = deductions.groupingSets([("type", "item"), ("type",), ()], "type", "item")
    out = sums.agg(F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("n"), F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("points"))
    rank = F.row_number().over(Window.partitionBy("grouping").orderBy(F.desc("points"), F.asc_nulls_last("type"), F.asc_nulls_last("item")))
    return out.withColumn("rn", rank).where((F.col("grouping") > 0) | (F.col("rn") <= top)).drop("rn")


def grade_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("grade", F.lit(UNGRADED)).alias("grade")).agg(F.count("*").alias("n"))


def review_counts(tasks: DataFrame, now: Column) -> DataFrame:
    live = tasks.where(~F.col("is_obsolete"))
    pending = F.col("status") == "pending"
    return live.agg(count_where(pending).alias("pending"), count_where(F.col("status") == "completed").alias("done"), count_where(pending & (F.col("deadline_time") < now)).alias("overdue"))


def worst_field(coverage: DataFrame) -> DataFrame:
    """Overall share of normalised entities and the kind with the lowest one (kind, total, normalized)."""
    some = coverage.where("total > 0")
    return some.agg(percent(F.sum("normalized"), F.sum("total")).alias("rate"), F.min(F.struct((F.col("normalized") / F.col("total")).alias("r"), "kind")).getField("kind").alias("worst"))
