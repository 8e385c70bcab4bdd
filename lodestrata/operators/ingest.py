"""Rows of text cells as records: header mapping, checks with reasons, coercion, deduplication and what was refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null, lenient_int, normalized_datetime
from lodestrata.operators.records import small
from lodestrata.schema import HEADERS

NO_OUTPATIENT, BAD_TIME, TOO_MANY = "门诊号为空", "接诊时间无法识别", "超过单次导入行数上限"
MOST_ROWS = 50_000


def mapped(df: DataFrame, keep: tuple[str, ...] = ("file", "row")) -> DataFrame:
    """Columns by known headers as fields, cells trimmed and blank ones null; the first of two headers of one field wins, unknown ones are left out."""
    fields: dict[str, str] = {}
    for c in df.columns:
        if (field := HEADERS.get(c.strip())) and field not in fields:
            fields[field] = c
    missing = {"registration_no", "visit_time"} - fields.keys()
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return df.select(*keep, *(blank_to_null(F.col(f"`{c}`").cast("string")).alias(f) for f, c in fields.items()))


def checked(rows: DataFrame) -> DataFrame:
    """rows with reason, null for good ones. Rows without a registration number are no rows at all."""
    time = F.col("visit_time").isNotNull() & normalized_datetime(F.col("visit_time")).isNull()
    return rows.where("registration_no is not null").withColumn("reason", F.when(F.col("outpatient_no").isNull(), NO_OUTPATIENT).when(time, BAD_TIME))


def limited(rows: DataFrame, most: int = MOST_ROWS, block: int = 65_536) -> DataFrame:
    """rows (checked: file, row) with a reason for those beyond the import's limit, in file and row order.

    Rows are counted by blocks of a file first; only the blocks' counts, which are few, meet in one window, and rows
    are ranked inside their block, so one large file is many tasks.
    """
    dealt = rows.withColumn("__block", F.floor(F.col("row") / block))
    before = Window.orderBy("file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("file", "__block").agg(F.count("*").alias("__n")).select("file", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("file", "__block").orderBy("row"))).join(small(sizes), ["file", "__block"])
    return placed.withColumn("reason", F.when(F.col("__at") + F.col("__before") > most, TOO_MANY).otherwise(F.col("reason"))).drop("__at", "__before", "__block")


def coerced(rows: DataFrame) -> DataFrame:
    """Good rows with typed visit_time and visit_count."""
    out = rows.where("reason is null").drop("reason").withColumn("visit_time", normalized_datetime(F.col("visit_time")))
    return out.withColumn("visit_count", lenient_int(F.col("visit_count"))) if "visit_count" in rows.columns else out


def refused(rows: DataFrame) -> DataFrame:
    """Refused rows with their filled cells by header, ready to be corrected and read again: file, row, reason, cells."""
    labels = {v: k for k, v in reversed(HEADERS.items())}
    fields = [c for c in rows.columns if c in labels]
    cells = F.create_map(*(x for c in fields for x in (F.lit(labels[c]), F.col(c))))
    return rows.where("reason is not null").select("file", "row", "reason", F.map_filter(cells, lambda _, v: v.isNotNull()).alias("cells"))


def again(rejects: DataFrame) -> DataFrame:
    """Refused rows as a table of cells again, for another pass through mapped()."""
    return rejects.select("file", "row", *(F.col("cells")[h].alias(h) for h in HEADERS))


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (org_id, text_hash, file, row) that existing doesn't hold, the first of each text in file and row order.

    Rows without a hash are never copies. The first is found by partial aggregation, so one text in very many
    rows is no sort, and only its place joins back.
    """
    fresh = rows.join(existing.select("org_id", "text_hash").where("text_hash is not null").distinct(), ["org_id", "text_hash"], "left_anti")
    first = fresh.where("text_hash is not null").groupBy("org_id", "text_hash").agg(F.min(F.struct("file", "row")).alias("f")).select("org_id", "text_hash", "f.file", "f.row")
    kept = fresh.join(first, ["org_id", "text_hash", "file", "row"], "left_semi")
    return kept.unionByName(fresh.where("text_hash is null"))


def summary(rows: DataFrame) -> DataFrame:
    """Rows in all, taken and refused."""
    bad = F.col("reason").isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed"))


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows (checked) and what summary() says of them, to be read after any action on the rows: the job that writes them counts them too."""
    bad = F.col("reason").isNotNull()
    figures = Observation()
    return rows.observe(figures, F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed")), figures
