"""Dictionary files in, dataset and log files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null, decoded, mask_pii
from lodestrata.operators.dictionary import clean_aliases

ALIAS_BREAK, HEADER = "[、,，;；|]", "标准术语"
BOM = "﻿"


def dictionary_csv(spark: SparkSession, path: str, term_type: str) -> DataFrame:
    """Terms of CSV or TSV files: the term up to the first comma or tab, then aliases; blank lines and the header are skipped.

    Files are UTF-8, or GBK where they are no UTF-8; each is a row on its own, so charsets may differ.
    """
    text = spark.read.format("binaryFile").load(path).select(F.explode(F.split(decoded(F.col("content")), "\r?\n")).alias("line"))
    line = text.select(F.regexp_replace("line", f"^{BOM}", "").alias("line")).where((F.trim("line") != "") & ~F.col("line").startswith(HEADER))
    cells = F.split("line", "[,\t]", 2)
    return _entries(line.select(F.get(cells, F.lit(0)).alias("term"), F.split(F.coalesce(F.get(cells, F.lit(1)), F.lit("")), ALIAS_BREAK).alias("aliases")), term_type)


def dictionary_json(spark: SparkSession, path: str, term_type: str) -> DataFrame:
    """Terms of JSON files [{standardTerm, aliases[]}]; entries without a term are left out."""
    rows = spark.read.schema("standardTerm string, aliases array<string>").option("multiLine", True).json(path)
    return _entries(rows.select(F.col("standardTerm").alias("term"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")), term_type)


def _entries(rows: DataFrame, term_type: str) -> DataFrame:
    term = F.trim("term")
    return rows.where(blank_to_null("term").isNotNull()).select(F.lit(term_type).alias("type"), term.alias("standard_term"), clean_aliases(F.col("aliases"), term).alias("aliases"))


def reconciled(stored: DataFrame, files: DataFrame, org_id: str = "") -> DataFrame:
    """The stored dictionary with a layer's types taken from files wherever their contents differ; other types stay.

    Contents are compared by an order-free hash of entries for each type; only types that differ are replaced.
    """

    def version(df: DataFrame, name: str) -> DataFrame:
        entry = F.xxhash64("standard_term", F.array_sort("aliases"))
        return df.groupBy("type").agg(F.struct(F.count("*").alias("n"), F.sum(entry.cast("decimal(38,0)")).alias("h")).alias(name))

    layer = stored.where(F.col("org_id") == org_id)
    stale = version(files, "new").join(version(layer, "old"), "type", "left").where(~F.col("new").eqNullSafe(F.col("old"))).select("type")
    kept = stored.join(stale.withColumn("org_id", F.lit(org_id)), ["org_id", "type"], "left_anti")
    return kept.unionByName(files.join(stale, "type", "left_semi").withColumn("org_id", F.lit(org_id)).select(*stored.columns))


def quoted(c: Column | str) -> Column:
    """A cell in quotes, with its quotes doubled and line breaks as blanks; null is empty."""
    text = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, "[\r\n]+", " "), '"', '""'), F.lit('"'))


def quoted_if_needed(c: Column | str) -> Column:
    text = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.when(text.rlike('[,\n"]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def csv_rows(df: DataFrame, columns: dict[str, str], masked: tuple[str, ...] = (), day: tuple[str, ...] = ("visit_time",)) -> DataFrame:
    """id and line: every cell quoted, times as their day, personal numbers masked. columns: field to header."""
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        text = F.substring(text, 1, 10) if c in day else text
        cells.append(quoted(mask_pii(text) if c in masked else text))
    return df.select("id", F.concat_ws(",", *cells).alias("line"))


def log_rows(logs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """event_id and line: cells quoted only where they must be."""
    return logs.select("event_id", F.concat_ws(",", *map(quoted_if_needed, columns)).alias("line"))


def report_rows(df: DataFrame, columns: tuple[str, ...], order: str = "id") -> DataFrame:
    """order and line: every cell quoted with its quotes doubled, line breaks kept; null is empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return df.select(order, F.concat_ws(",", *map(cell, columns)).alias("line"))


def write_csv(lines: DataFrame, headers: list[str], path: str, order: str = "id", line_end: str = "\n") -> None:
    """Lines as text files, in order over all files; the first line of each file is the header behind a byte order mark. Reports end lines by CR and LF."""
    head = BOM + ",".join(f'"{h}"' for h in headers)
    ranged = lines.repartitionByRange(order).sortWithinPartitions(order).select("line")

    def with_head(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    ranged.mapInArrow(with_head, "line string").write.mode("overwrite").option("lineSep", line_end).text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, masked by the caller; a file a partition."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: str = "id") -> None:
    """Records as one JSON array over all files, which are read one after the other: order is unique and not null; no records are an empty array."""
    first, last = df.agg(F.min(order), F.max(order)).first()
    if first is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    key = F.col(order)
    line = F.concat(F.when(key == F.lit(first), "[").otherwise(","), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), F.when(key == F.lit(last), "]").otherwise(""))
    df.select(key, line.alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def preview(df: DataFrame, masked: tuple[str, ...], rows: int = 10) -> DataFrame:
    """The first rows in (visit_time desc, id) order, masked, each with the total."""
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(F.col("visit_time").desc_nulls_last(), "id").limit(rows)
    return top.select(*(mask_pii(F.col(c)).alias(c) if c in masked else F.col(c) for c in df.columns)).crossJoin(total)  # one row
