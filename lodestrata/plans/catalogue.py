"""Registered queries over the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import add_workdays, digits_template, mask_pii
from lodestrata.operators import dictionary as dic
from lodestrata.operators import filters, normalize, qc, stats
from lodestrata.plans import documents, lifecycle, rules, structured, views
from lodestrata.schema import PENDING
from lodestrata.streaming import windows


def month_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_months(stats.month_trend(filters.Scope(view_all=True).apply(views.records(spark, sf_dir))))


def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir)
    return stats.overview(filters.RecordFilter(department="1-URGENT").apply(rows), rows)


def scope_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three askers see, in one pass over the records."""
    scopes = {"all": filters.Scope(view_all=True), "one": filters.Scope(" BUILDING "), "none": filters.Scope("")}
    return _counts(views.records(spark, sf_dir), {k: s.predicate() for k, s in scopes.items()}, "scope")


def _counts(df: DataFrame, conditions: dict, name: str) -> DataFrame:
    """A row for each named condition with how many rows meet it."""
    one = df.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias(name), F.col(k).alias("n")) for k in conditions))).alias("x")).select("x.*")


def search_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.RecordFilter(grade="合格", visit_range=("1994-01-01", "1996-12-31")).apply(views.records(spark, sf_dir))
    return filters.page(rows, filters.sort_order("score", "desc"), 2, 20).select("id", "department", "score")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = (F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00")), F.lit(100))
    return filters.keyset_page(views.records(spark, sf_dir), cursor, 50).select("id", "visit_time")


def governance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.governance_counts(views.records(spark, sf_dir))


def department_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.department_rates(views.records(spark, sf_dir))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_histogram(views.records(spark, sf_dir))


def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grade_distribution(views.records(spark, sf_dir))


def term_freq_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.term_frequency(views.entities(spark, sf_dir))


def distinct_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_values(views.records(spark, sf_dir), "department")


def dict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dic.overlay(views.dictionary(spark, sf_dir), "org")
    return out.select("type", "standard_term", F.array_join("aliases", ",").alias("aliases"), "own")


def dict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = views.dictionary(spark, sf_dir)
    return dic.diff(terms.where("org_id = ''"), terms.where("org_id = 'org'"))


def dict_merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dic.merge(views.dictionary(spark, sf_dir).drop("org_id"))
    return out.select("type", "standard_term", F.array_join("aliases", ",").alias("aliases"))


def dict_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.collisions(views.dictionary(spark, sf_dir).where("org_id = ''"))


def dict_content_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.versions(views.dictionary(spark, sf_dir))


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text column of the documents, joined and masked."""
    whole = F.concat_ws("\n", F.lit("tel 13812345678"), "lang", "source", "text")
    return views.table(spark, sf_dir, "documents").select("doc_id", mask_pii(whole).alias("masked"))


def pii_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document, masked, behind a sure hit of both patterns."""
    sure = F.lit("tel 13812345678, id 11010519491231002X, ")
    return views.table(spark, sf_dir, "documents").select("doc_id", mask_pii(F.concat(sure, F.coalesce("text", F.lit("")))).alias("masked"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events")
    return rows.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def deduction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.deduction_stats(views.deductions(spark, sf_dir))


def duplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir).withColumn("text_hash", F.md5(F.concat(F.col("department"), F.col("score").cast("string"))))
    return qc.duplicate_flag(rows).select("id", "duplicate")


def review_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir).where((F.col("grade") == PENDING) & F.col("visit_time").isNotNull())
    deadline = rows.select("id", add_workdays(F.col("visit_time").cast("date"), 7).alias("deadline"))
    return deadline.where(F.col("deadline") < F.to_date(F.lit("1998-01-01")))


def log_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(views.logs(spark, sf_dir), {role: filters.log_predicate(role, "7", "1") for role in ("admin", "owner", "member", "other")}, "role")


def log_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keyword(views.logs(spark, sf_dir), "err").unionAll(filters.keyword(views.logs(spark, sf_dir), '": 6')).select("event_id", "target")


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_rate(views.table(spark, sf_dir, "events"), "user_id", "ts", 3600, 1).select("event_id", "n", "limited")


def orphan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def tasks_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = filters.RecordFilter(grade="合格").apply(views.records(spark, sf_dir)).select("id")
    tasks = views.table(spark, sf_dir, "lineitem").join(records, F.col("l_orderkey") == F.col("id"), "left_semi")
    return tasks.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


def dict_snapshot_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.logs(spark, sf_dir).select("org_id", F.col("target").alias("type"), F.col("event_id").alias("version_no"))
    return dic.prune_snapshots(rows)


def dict_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.quality(views.dictionary(spark, sf_dir))


def dict_cross_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.cross_type(views.dictionary(spark, sf_dir))


def dict_effective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.effective_counts(views.dictionary(spark, sf_dir), "org")


def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "supplier")
    return rows.agg(F.count("*").alias("n"), F.count_distinct(digits_template(F.col("s_name"))).alias("templates"))


def term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("standard_term")).distinct()
    terms = words.select(F.lit("word").alias("type"), "standard_term", F.array().cast("array<string>").alias("aliases"))
    return normalize.scan(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), terms)


def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asked against the terms of all parts."""
    part = views.table(spark, sf_dir, "part")
    inputs, terms = part.select(F.col("p_type").alias("type"), F.col("p_name").alias("input")), part.select(F.col("p_type").alias("type"), F.col("p_name").alias("standard_term"))
    out = normalize.suggest(inputs, terms)
    return out.select("type", "input", "standard_term", F.col("overlap").cast("long").alias("overlap"), "rn")


_R, _E, _D = views.RECORDS_SQL, views.ENTITIES_SQL, views.DICTIONARY_SQL
_RATE = "CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE floor(qualified::DOUBLE * 1000.0::DOUBLE / total::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE END AS rate"

ORACLE: dict[str, str] = {
    "month_trend": f"""WITH {_R}, m AS (
  SELECT strftime(visit_time, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE grade = '合格') AS qualified FROM records WHERE visit_time IS NOT NULL GROUP BY 1 HAVING count(grade) > 0)
SELECT month, total, qualified, (SELECT count(*) FROM m) > 12 AS truncated FROM m ORDER BY month DESC LIMIT 12""",
    "overview_counts": f"""WITH {_R}, c AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE grade = '合格') AS qualified, count(*) FILTER (WHERE grade = '待复核') AS pending, count(*) FILTER (WHERE grade = '无效') AS invalid FROM records WHERE department = '1-URGENT')
SELECT *, (SELECT count(*) FROM records WHERE grade = '待复核') AS pending_global, {_RATE} FROM c""",
    "scope_fail_closed": f"""WITH {_R} SELECT 'all' AS scope, count(*) AS n FROM records UNION ALL SELECT 'one', count(*) FROM records WHERE org_id = 'BUILDING' UNION ALL SELECT 'none', count(*) FROM records WHERE FALSE""",
    "search_filter_page": f"""WITH {_R} SELECT id, department, score FROM records WHERE grade = '合格' AND visit_time BETWEEN TIMESTAMP '1994-01-01 00:00:00' AND TIMESTAMP '1996-12-31 23:59:59'
ORDER BY score DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20""",
    "keyset_page": f"""WITH {_R} SELECT id, visit_time FROM records WHERE visit_time < TIMESTAMP '1996-06-01' OR (visit_time = TIMESTAMP '1996-06-01' AND id > 100) OR visit_time IS NULL
ORDER BY visit_time DESC NULLS LAST, id LIMIT 50""",
    "governance_counts": f"""WITH {_R} SELECT count(*) FILTER (WHERE grade = '合格') AS qualified, count(*) FILTER (WHERE grade = '合格' AND governed) AS governed, count(*) FILTER (WHERE grade = '合格' AND NOT governed) AS pending_govern FROM records""",
    "department_rates": f"""WITH {_R}, c AS (SELECT coalesce(nullif(trim(department), ''), '未填科室') AS department, count(*) AS total, count(*) FILTER (WHERE grade = '合格') AS qualified FROM records GROUP BY 1)
SELECT *, {_RATE} FROM c""",
    "score_histogram": f"""WITH {_R}, b(position, bucket, low, high) AS (VALUES (0, '0-59', 0, 59), (1, '60-69', 60, 69), (2, '70-79', 70, 79), (3, '80-89', 80, 89), (4, '90-100', 90, 100))
SELECT position, bucket, count(id) AS n FROM b LEFT JOIN records ON score BETWEEN low AND high GROUP BY 1, 2""",
    "grade_distribution": f"""WITH {_R} SELECT coalesce(grade, '未评分') AS grade, count(*) AS n FROM records GROUP BY 1""",
    "term_freq_multi": f"""WITH {_E}, c AS (SELECT kind, trim(content) AS term, count(*) AS n FROM entities WHERE trim(content) <> '' GROUP BY 1, 2)
SELECT kind, term, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS INTEGER) AS rn FROM c QUALIFY rn <= 10""",
    "distinct_departments": f"""WITH {_R} SELECT DISTINCT trim(department) AS value FROM records WHERE trim(department) <> ''""",
    "dict_overlay": f"""WITH {_D} SELECT type, trim(standard_term) AS standard_term, array_to_string(arg_max(aliases, org_id <> ''), ',') AS aliases, max(org_id <> '') AS own FROM dictionary GROUP BY 1, 2""",
    "dict_diff": f"""WITH {_D}, o AS (SELECT type, lower(trim(standard_term)) AS key, list_sort(list_distinct(flatten(list(aliases)))) AS a FROM dictionary WHERE org_id = '' GROUP BY 1, 2),
n AS (SELECT type, lower(trim(standard_term)) AS key, list_sort(list_distinct(flatten(list(aliases)))) AS b FROM dictionary WHERE org_id = 'org' GROUP BY 1, 2)
SELECT type, key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n USING (type, key) WHERE a IS DISTINCT FROM b""",
    "dict_merge_aliases": f"""WITH {_D} SELECT type, trim(standard_term) AS standard_term, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') AS aliases FROM dictionary GROUP BY 1, 2""",
    "dict_collisions": f"""WITH {_D}, w AS (SELECT type, standard_term, unnest(list_append(aliases, standard_term)) AS word FROM dictionary WHERE org_id = '')
SELECT type, word, count(DISTINCT standard_term) AS owners FROM w GROUP BY 1, 2 HAVING count(DISTINCT standard_term) > 1""",
    "dict_content_version": f"""WITH {_D} SELECT org_id, type, substr(sha256(string_agg(e, chr(1) ORDER BY e)), 1, 32) AS version
FROM (SELECT org_id, type, standard_term || chr(2) || array_to_string(aliases, ',') AS e FROM dictionary) GROUP BY 1, 2""",
    # No look-around in SQL: the characters beside a number are given back; the second pass finds numbers that share one.
    "pii_mask_text": r"""WITH t AS (SELECT doc_id, 'tel 13812345678, id 11010519491231002X, ' || coalesce(text, '') AS x FROM documents),
p AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1***\2', 'g'), '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1***\2', 'g') AS x FROM t)
SELECT doc_id, regexp_replace(regexp_replace(x, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1***\2', 'g'), '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1***\2', 'g') AS masked FROM p""",
    "deduction_stats": f"""WITH {views.DEDUCTIONS_SQL}, g AS (
  SELECT type, item, CAST(grouping(type, item) AS INTEGER) AS "grouping", count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM deductions GROUP BY GROUPING SETS ((type, item), (type), ()))
SELECT * FROM g QUALIFY "grouping" > 0 OR row_number() OVER (PARTITION BY "grouping" ORDER BY points DESC, type, item) <= 20""",
    "duplicate_flag": f"""WITH {_R}, h AS (SELECT *, md5(department || CAST(score AS VARCHAR)) AS k FROM records)
SELECT id, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY visit_time DESC NULLS LAST, id) > 1 AS duplicate FROM h""",
    "review_overdue": f"""WITH {_R}, d AS (SELECT id, list_filter(list_transform(range(1, 12), lambda i: CAST(visit_time AS DATE) + CAST(i AS INTEGER)), lambda d: dayofweek(d) NOT IN (0, 6))[7] AS deadline
  FROM records WHERE grade = '待复核' AND visit_time IS NOT NULL) SELECT id, deadline FROM d WHERE deadline < DATE '1998-01-01'""",
    "log_visibility": f"""WITH {views.LOGS_SQL} SELECT 'admin' AS role, count(*) AS n FROM logs UNION ALL SELECT 'owner', count(*) FROM logs WHERE org_id = '1'
UNION ALL SELECT 'member', count(*) FROM logs WHERE org_id = '1' AND operator = '7' UNION ALL SELECT 'other', count(*) FROM logs WHERE operator = '7'""",
    "log_keyword": f"""WITH {views.LOGS_SQL} SELECT event_id, target FROM logs WHERE contains(operator, 'err') OR contains(target, 'err') OR contains(detail, 'err')
UNION ALL SELECT event_id, target FROM logs WHERE contains(operator, '": 6') OR contains(target, '": 6') OR contains(detail, '": 6')""",
    "rate_limit_window": """SELECT event_id, n, n > 1 AS limited FROM (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events)""",
    "orphan_tasks": """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "tasks_in_scope": f"""WITH {_R} SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT id FROM records WHERE grade = '合格') GROUP BY 1""",
    "dict_snapshot_prune": f"""WITH {views.LOGS_SQL} SELECT org_id, target AS type, event_id AS version_no FROM logs QUALIFY row_number() OVER (PARTITION BY org_id, target ORDER BY event_id DESC) <= 5""",
    "dict_quality": f"""WITH {_D} SELECT type, count(*) AS terms, count(*) FILTER (WHERE len(aliases) > 0) AS aliased, count(*) FILTER (WHERE list_contains(aliases, standard_term)) AS self_aliased FROM dictionary GROUP BY 1""",
    "dict_cross_type": f"""WITH {_D} SELECT standard_term, count(DISTINCT type) AS types FROM dictionary GROUP BY 1 HAVING count(DISTINCT type) > 1""",
    "dict_effective_counts": f"""WITH {_D}, c AS (SELECT type, count(*) FILTER (WHERE org_id = 'org') AS own, count(*) FILTER (WHERE org_id = '') AS base FROM dictionary GROUP BY 1)
SELECT type, CASE WHEN own > 0 THEN own ELSE base END AS terms FROM c""",
    "dataset_shape": r"""SELECT count(*) AS n, count(DISTINCT regexp_replace(s_name, '\d+', 'N', 'g')) AS templates FROM supplier""",
    "term_scan": """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS standard_term FROM part)
SELECT p_partkey AS id, 'word' AS type, standard_term FROM part JOIN w ON contains(p_name, standard_term) AND p_name <> standard_term AND length(standard_term) >= 2""",
    "candidate_topk": """WITH i AS (SELECT DISTINCT p_type AS type, p_name AS input FROM part), t AS (SELECT DISTINCT p_type AS type, p_name AS standard_term FROM part),
c AS (SELECT type, input, standard_term, unnest(list_distinct(string_split(input, ''))) AS ch FROM i JOIN t USING (type)),
o AS (SELECT type, input, standard_term, CAST(sum(least(length(input) - length(replace(input, ch, '')), length(standard_term) - length(replace(standard_term, ch, '')))) AS BIGINT) AS overlap FROM c GROUP BY 1, 2, 3)
SELECT type, input, standard_term, overlap, CAST(row_number() OVER (PARTITION BY type, input ORDER BY overlap DESC, standard_term) AS INTEGER) AS rn FROM o WHERE overlap >= 2 QUALIFY rn <= 5""",
    "json_props": """SELECT event_type, props ->> '$.k' AS k, count(*) AS n FROM events GROUP BY 1, 2""",
}


ORACLE["pii_mask"] = ORACLE["pii_mask_text"].replace("'tel 13812345678, id 11010519491231002X, ' || coalesce(text, '')", "concat_ws(chr(10), 'tel 13812345678', lang, source, text)")
#: Second names of queries that read a part of the table once and read all of it now.
WHOLE = {f"{f.__name__}_whole": f for f in (dict_overlay, dict_diff, dict_merge_aliases, dict_collisions, dict_content_version, dict_quality, dict_cross_type, dict_effective_counts, candidate_topk)}
ORACLE |= {name: ORACLE[f.__name__] for name, f in WHOLE.items()}
for _module in (structured, rules, lifecycle, documents):
    ORACLE |= _module.ORACLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = globals() | WHOLE | structured.QUERIES | rules.QUERIES | lifecycle.QUERIES | documents.QUERIES
    return {name: found[name] for name in (*ORACLE, "text_windows", "decomposed_terms", "normalize_chain", "placed_entities", "normalized_records")}
