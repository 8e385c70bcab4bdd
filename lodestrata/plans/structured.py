"""Queries over structured documents and the standardization report, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import entities as ent
from lodestrata.operators import report, stats
from lodestrata.operators.dictionary import effective_counts
from lodestrata.plans import views
from lodestrata.schema import QUALIFIED

_R, _M, _C = views.RECORDS_SQL, views.MENTIONS_SQL, views.CHARTS_SQL
#: An entity's term as the lists give it.
_TERM = "CASE WHEN trim(content) <> '' THEN trim(content) END"
_ALL = f"all_ents AS (SELECT record_id AS id, kind, field, place, form, plain, source_text, norm_level, dosage, {_TERM} AS term FROM ents)"
_GOOD = "good AS (SELECT e.* FROM all_ents e JOIN records USING (id) WHERE grade = '合格')"


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.charts(spark, sf_dir)


def _entities(spark: SparkSession, sf_dir: str, qualified: bool = False) -> DataFrame:
    rows = _charts(spark, sf_dir)
    return ent.exploded(rows.where(F.col("grade") == QUALIFIED) if qualified else rows)


def _terms_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary terms of the first four kinds, from the types of parts."""
    counts = effective_counts(views.dictionary(spark, sf_dir), "")
    kind = F.element_at(F.array(*map(F.lit, views.KINDS[:4])), (F.length("type") % 4 + 1).cast("int"))
    return counts.groupBy(kind.alias("kind")).agg(F.sum("terms").alias("terms"))


def term_freq_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.term_top(_entities(spark, sf_dir), "symptom")


def term_freq_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir).where(F.col("kind").isin("disease", "symptom", "formula", "herb"))
    return stats.term_frequency(rows.withColumnRenamed("term", "content"))


def pattern_freq_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _charts(spark, sf_dir)
    return ent.pattern_top(rows, ent.exploded(rows))


def representative_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.representatives(_entities(spark, sf_dir)).select("id", "field", "term", "source_text", "norm_level")


def coverage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_by_type(_entities(spark, sf_dir, True), _terms_by_kind(spark, sf_dir))


def worst_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.worst_field(coverage_by_type(spark, sf_dir))


def unmatched_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unmatched_counts(report.classified_symptoms(_entities(spark, sf_dir, True)))


def unmatched_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unmatched_top(report.classified_symptoms(_entities(spark, sf_dir, True)))


def normalizable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.normalizable_rate(report.classified_symptoms(_entities(spark, sf_dir, True)))


def report_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = (F.col("l_quantity") / 5).cast("int")
    cuts = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "术语未标准化").otherwise("格式错误").alias("type"), points.alias("points"))
    return report.score_report(views.records(spark, sf_dir), cuts)


def qc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir)
    return report.qc_coverage(rows.withColumn("qc_score", F.when(F.col("id") % 3 != 0, F.col("score"))).withColumn("qc_time", F.col("visit_time")))


def report_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _charts(spark, sf_dir)
    undated = F.when(F.col("id") % 37 != 0, F.col("visit_time"))
    return report.monthly(rows.withColumn("visit_time", undated), report.classified_symptoms(ent.exploded(rows)))


def range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.col("visit_time").between(F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1996-12-31 23:59:59")))
    return report.range_summary(views.records(spark, sf_dir), picked)


def chart_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _charts(spark, sf_dir)
    good = ent.exploded(rows.where(F.col("grade") == QUALIFIED))
    return report.dataset_shape(rows, report.classified_symptoms(good))


def norm_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.hits_by_level(ent.counted(_charts(spark, sf_dir)))


def missed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.missed_terms(ent.counted(_charts(spark, sf_dir)))


def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _charts(spark, sf_dir)
    document = F.col("structured_data")
    return rows.groupBy(ent.manually_edited(document).alias("manual"), ent.unparsable(document).alias("bad"), document.isNull().alias("none")).agg(F.count("*").alias("n"))


def _class_sql(term: str) -> str:
    starts = lambda c, words: "(" + " OR ".join(f"starts_with({c}, '{w}')" for w in words) + ")"
    holds = lambda words: "(" + " OR ".join(f"contains({term}, '{w}')" for w in words) + ")"
    core = f"regexp_replace({term}, '^[左右双两]', '')"
    wrong = f"({starts(core, report.MISROUTED_PREFIX)} AND NOT {starts(term, report.MISROUTED_EXCLUDE)} AND NOT {starts(core, report.MISROUTED_EXCLUDE)} AND regexp_matches({term}, '^[\\x{{4e00}}-\\x{{9fff}}]+$'))"
    return f"""CASE WHEN {holds(report.PHYSICAL_SIGN)} THEN 'physicalSign' WHEN {wrong} THEN 'misrouted' WHEN {holds(report.MISTYPE_MARKERS)} THEN 'mistypeMarker'
  WHEN {starts(term, report.INQUIRY_LEAD)} OR {holds(report.INQUIRY_MARKERS)} THEN 'inquiryFragment' WHEN {starts(term, report.PROCESS_LEAD)} THEN 'processDesc' WHEN length({term}) <= 2 THEN 'fragment' ELSE 'dictionaryGap' END"""


def _classes(source: str) -> str:
    return f"""t AS (SELECT id, coalesce(term, trim(source_text)) AS term, norm_level FROM {source} WHERE kind = 'symptom' AND NOT plain AND coalesce(term, trim(source_text)) IS NOT NULL),
classes AS (SELECT id, term, CASE WHEN norm_level IN (2, 3) THEN 'inferred' WHEN norm_level IS NOT NULL THEN 'matched' ELSE {_class_sql('term')} END AS class FROM t)"""


_STANDARD = "(length(term) < 4 OR NOT regexp_matches(term, '[偏略较尚欠]'))"
_COVER = f"""kinds AS (SELECT {views._sql_pick(views.KINDS[:4], 'length(p_type)')} AS kind, count(*) AS terms FROM (SELECT DISTINCT p_type, p_name FROM part) GROUP BY 1),
n AS (SELECT kind, count(*) AS total, count(*) FILTER (WHERE norm_level BETWEEN 1 AND 3) AS normalized FROM good WHERE term IS NOT NULL GROUP BY 1),
cover AS (SELECT kind, total, normalized, coalesce(CAST(terms AS BIGINT), 0) AS terms, coalesce(terms, 0) > 0 AND total >= 10 AND normalized = 0 AS stale FROM n LEFT JOIN kinds USING (kind))"""
_TENTH = "CASE WHEN {n} > 0 THEN floor({s}::DOUBLE * 10.0::DOUBLE / {n}::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE END"

ORACLE: dict[str, str] = {
    "term_freq_topn": f"WITH {_M}, {_ALL} SELECT term, count(*) AS n FROM all_ents WHERE kind = 'symptom' AND term IS NOT NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 10",
    "term_freq_lists": f"""WITH {_M}, {_ALL}, c AS (SELECT kind, term, count(*) AS n FROM all_ents WHERE kind IN ('disease', 'symptom', 'formula', 'herb') AND term IS NOT NULL GROUP BY 1, 2)
SELECT kind, term, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS INTEGER) AS rn FROM c QUALIFY rn <= 10""",
    "pattern_freq_union": f"""WITH {_R}, {_M}, {_ALL}, {_C}, listed AS (SELECT id, term FROM all_ents WHERE kind = 'pattern'),
x AS (SELECT term FROM listed UNION ALL SELECT trim(unnest(regexp_split_to_array(pattern, '[、，；;,]'))) FROM charts WHERE id NOT IN (SELECT id FROM listed))
SELECT term, count(*) AS n FROM x WHERE term <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 10""",
    "representative_entity": f"""WITH {_M}, {_ALL} SELECT id, field, term, trim(source_text) AS source_text, norm_level FROM all_ents WHERE term IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id, field, term ORDER BY length(coalesce(source_text, '')) DESC, coalesce(norm_level, 4), place) = 1""",
    "coverage_by_type": f"WITH {_R}, {_M}, {_ALL}, {_GOOD}, {_COVER} SELECT * FROM cover",
    "worst_coverage": f"""WITH {_R}, {_M}, {_ALL}, {_GOOD}, {_COVER} SELECT floor(sum(normalized)::DOUBLE * 1000.0::DOUBLE / sum(total)::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS rate,
  arg_min(kind, (normalized::DOUBLE / total::DOUBLE, kind)) AS worst FROM cover""",
    "unmatched_taxonomy": f"WITH {_R}, {_M}, {_ALL}, {_GOOD}, {_classes('good')} SELECT class, count(*) AS n FROM classes WHERE class NOT IN ('inferred', 'matched') GROUP BY 1",
    "unmatched_top": f"""WITH {_R}, {_M}, {_ALL}, {_GOOD}, {_classes('good')}, c AS (SELECT class, term, count(*) AS n FROM classes WHERE class <> 'matched' AND (class <> 'dictionaryGap' OR {_STANDARD}) GROUP BY 1, 2)
SELECT class, term, n, CAST(row_number() OVER (PARTITION BY class ORDER BY n DESC, term) AS INTEGER) AS rn FROM c QUALIFY rn <= 15""",
    "normalizable_rate": f"""WITH {_R}, {_M}, {_ALL}, {_GOOD}, {_classes('good')} SELECT count(*) FILTER (WHERE class IN ('inferred', 'matched')) AS normalized,
  count(*) FILTER (WHERE class IN ('inferred', 'matched', 'fragment', 'dictionaryGap')) AS normalizable FROM classes""",
    "report_score": f"""WITH {_R}, capped AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND trunc(l_quantity / 5) >= 5)
SELECT count(*) AS total, min(score) AS lowest, max(score) AS highest, floor(avg(score) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS average, count(c.id) AS capped FROM records r LEFT JOIN capped c USING (id) WHERE score IS NOT NULL""",
    "qc_coverage": f"""WITH {_R} SELECT count(*) AS graded, count(*) FILTER (WHERE id % 3 <> 0 AND score IS NOT NULL) AS scored, max(visit_time) FILTER (WHERE id % 3 <> 0 AND score IS NOT NULL) AS last_scored,
  count(*) = count(*) FILTER (WHERE id % 3 <> 0 AND score IS NOT NULL) AS complete FROM records WHERE grade IS NOT NULL""",
    "report_monthly": f"""WITH {_R}, {_M}, {_ALL}, {_classes('all_ents')}, b AS (
  SELECT id, count(*) AS total, count(*) FILTER (WHERE class IN ('inferred', 'matched')) AS met, count(*) FILTER (WHERE class = 'dictionaryGap') AS gaps FROM classes GROUP BY 1), m AS (
  SELECT coalesce(strftime(CASE WHEN id % 37 <> 0 THEN visit_time END, '%Y-%m'), '未知') AS month, coalesce(sum(total), 0) AS total, coalesce(sum(met), 0) AS met, CAST(coalesce(sum(gaps), 0) AS BIGINT) AS gaps,
    sum(score) AS points, count(score) AS scored, count(*) FILTER (WHERE score <= 10) AS capped FROM records LEFT JOIN b USING (id) GROUP BY 1), s AS (
  SELECT *, CAST(floor(met::DOUBLE * 1000.0::DOUBLE / nullif(total, 0)::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS share FROM m)
SELECT month, CASE WHEN total > 0 THEN CAST(share // 10 AS VARCHAR) || '.' || CAST(share % 10 AS VARCHAR) || '%' ELSE '0.0%' END AS symptom_rate, {_TENTH.format(n='scored', s='points')} AS average, capped, gaps FROM s""",
    "range_summary": f"WITH {_R}, p AS (SELECT coalesce(visit_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31 23:59:59', FALSE) AS hit FROM records) SELECT count(*) FILTER (WHERE hit) AS picked, count(*) FILTER (WHERE NOT hit) AS excluded FROM p",
    "chart_shape": rf"""WITH {_R}, {_M}, {_ALL}, {_GOOD}, {_C}, {_classes('good')} SELECT count(*) AS n, count(DISTINCT regexp_replace(chief_complaint, '\d+', 'N', 'g')) AS templates,
  (SELECT count(DISTINCT id) FROM classes WHERE class = 'dictionaryGap' AND NOT {_STANDARD}) AS colloquial FROM charts""",
    "norm_hits": f"WITH {_M}, {_ALL} SELECT kind, coalesce(norm_level, 0) AS level, count(*) AS n FROM all_ents WHERE term IS NOT NULL GROUP BY 1, 2",
    "missed_terms": f"WITH {_M}, {_ALL} SELECT kind, term, count(*) AS n FROM all_ents WHERE term IS NOT NULL AND coalesce(norm_level, 0) = 0 GROUP BY 1, 2",
    "manual_edits": f"""WITH {_R}, {_M}, d AS (SELECT DISTINCT record_id FROM mentions), x AS (
  SELECT id, d.record_id IS NOT NULL AS whole, id % 19 <> 0 AND id % 23 = 0 AS bad FROM records LEFT JOIN d ON record_id = id)
SELECT whole AND id % 10 = 0 AS manual, bad, NOT whole AND NOT bad AND (id % 19 = 0 OR (id % 29 <> 0 AND id % 31 <> 0)) AS "none", count(*) AS n FROM x GROUP BY 1, 2, 3""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
