"""Queries over ingest, cleaning, export, record lists and dictionary upkeep, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import cut, edge_stripped, number_text, text_hash, trim_change
from lodestrata.operators import cleaning, filters, ingest, records
from lodestrata.operators import dictionary as dic
from lodestrata.operators import entities as ent
from lodestrata.operators.lineage import cut as cut_plan
from lodestrata.plans import views
from lodestrata.plans.structured import _ALL, _C, _M, _R
from lodestrata.schema import QUALIFIED
from lodestrata.sources import files


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a spreadsheet: blank numbers, times in many forms, and two headers for one field."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    time = (
        F.when(key % 6 == 0, F.date_format(day, "yyyyMMdd")).when(key % 6 == 1, F.date_format(day, "yyyy/M/d H:m")).when(key % 6 == 2, F.date_format(day, "yyyy年M月d日"))
        .when(key % 6 == 3, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).when(key % 12 == 4, "  ").when(key % 12 == 10, "soon").otherwise(F.date_format(day, "yyyyMMddHHmmss"))
    )
    return views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file"),
        key.alias("row"),
        F.when(key % 9 != 0, F.concat(F.lit(" R"), key.cast("string"))).otherwise(" ").alias("登记号"),
        F.when(key % 5 != 0, F.concat(F.lit("O"), (key % 50).cast("string"))).alias("门诊号"),
        time.alias("接诊时间"),
        number_text(F.when(key % 4 == 0, key.cast("double")).otherwise(key / F.lit(4.0))).alias("就诊次数"),
        F.col("o_orderpriority").alias("开单科室"),
        F.lit("first").alias("辨证结论"),
        F.lit("second").alias("证型"),
        F.lit("x").alias("unknown"),
    )


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.refused(ingest.checked(ingest.mapped(_cells(spark, sf_dir))))
    return rows.select("file", "row", "reason", F.size("cells").cast("long").alias("cells"), F.col("cells")["登记号"].alias("registration_no"))


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.coerced(ingest.checked(ingest.mapped(_cells(spark, sf_dir)))).select("file", "row", "registration_no", "pattern", "visit_time", "visit_count")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(ingest.limited(ingest.checked(ingest.mapped(_cells(spark, sf_dir))), 1000))


def ingest_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused rows with their outpatient number filled in, read again."""
    rejects = ingest.refused(ingest.checked(ingest.mapped(_cells(spark, sf_dir))))
    fixed = ingest.again(rejects).withColumn("门诊号", F.coalesce("门诊号", F.lit("O")))
    return ingest.summary(ingest.checked(ingest.mapped(fixed)))


def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.coerced(ingest.checked(ingest.mapped(_cells(spark, sf_dir))))
    hashed = rows.select("file", "row", F.lit("o").alias("org_id"), F.when(F.col("visit_count") % 7 != 0, F.md5(F.concat("outpatient_no", "department"))).alias("text_hash"))
    existing = views.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("o").alias("org_id"), F.md5(F.concat(F.lit("O"), (F.col("o_orderkey") % 20).cast("string"), "o_orderpriority")).alias("text_hash"))
    return ingest.new_rows(hashed, existing)


def _actions(spark: SparkSession, sf_dir: str, skip: bool = False) -> DataFrame:
    rows = views.charts(spark, sf_dir)
    rows = rows.withColumn("status", F.when(F.col("id") % 41 == 0, "invalid").otherwise("completed")).withColumn("text_hash", F.when(F.col("id") % 3 != 0, F.md5(F.concat("department", F.col("score").cast("string")))))
    return cleaning.with_actions(rows.withColumn("manually_edited", ent.manually_edited(F.col("structured_data"))), skip)


def clean_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("id", "action", "repaired", "cleared")


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.counts(_actions(spark, sf_dir, skip=True))


def clean_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cleaned(_actions(spark, sf_dir)).select("id", "grade", "status", "governed", "gender", "prescription")


def clean_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = views.records(spark, sf_dir).select(F.col("id").alias("record_id"), (F.col("id") % 10 == 0).alias("is_obsolete"))
    return cleaning.closed_reviews(_actions(spark, sf_dir), tasks)


def clean_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir)
    changed = rows.where("id % 2 = 0").select("id", F.lit(1).alias("score"), F.lit("changed").alias("department"))
    return cleaning.write_back(rows, changed).select("id", "score", "department")


def replacement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut_plan(ent.exploded(views.charts(spark, sf_dir)).select("id", "field", "kind", "pos", "term", "source_text"))
    changed = e.where("term is not null").select("kind", "term").distinct().withColumn("standard_term", F.when(F.length("term") > 3, F.concat("term", F.lit("*"))).otherwise(F.col("term")))
    return ent.replacement_pairs(e, changed).select("id", "source_text", "standard_term", "rank")


def effective_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.charts(spark, sf_dir)
    e = cut_plan(ent.exploded(rows).select("id", "field", "kind", "pos", "term", "source_text"))
    changed = e.where("term is not null").select("kind", "term").distinct().withColumn("standard_term", F.concat("term", F.lit("*")))
    return ent.effective_pairs(ent.replacement_pairs(e, changed), rows, ("chief_complaint", "self_report", "pattern")).select("id", "source_text", "standard_term")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ent.stamped(views.charts(spark, sf_dir), "v9", "2026-01-01", 7)
    d = F.col("structured_data")
    return rows.select("id", F.get_json_object(d, "$._meta.dictVersion").alias("version"), F.get_json_object(d, "$._meta.dictTermCount").alias("terms"), F.size(ent.parsed(d)["symptoms"]).cast("long").alias("symptoms"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.for_export(views.charts(spark, sf_dir).withColumn("doctor_id", F.concat(F.lit('d"'), F.col("score").cast("string"))))
    return files.csv_rows(rows, {"registration_no": "登记号", "chief_complaint": "主诉", "doctor_id": "医生工号", "visit_time": "接诊时间"}, masked=("chief_complaint",))


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.charts(spark, sf_dir).select("id", "visit_time", "chief_complaint")
    return files.preview(rows, ("chief_complaint",))


def log_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.log_rows(views.logs(spark, sf_dir), ("operator", "target", "detail"))


def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summaries(views.charts(spark, sf_dir))


def nlp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.nlp_text(views.charts(spark, sf_dir), ("chief_complaint", "tongue", "pulse", "pattern"))


def record_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.completeness(views.charts(spark, sf_dir), {"gender": "性别", "age": "年龄", "tongue": "舌诊", "pulse": "脉诊", "pattern": "证型", "visit_time": "接诊时间"})


def trim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.charts(spark, sf_dir)
    return rows.groupBy(trim_change("pattern").alias("pattern"), trim_change("prescription").alias("prescription"), trim_change("western_diagnosis").alias("diagnosis")).agg(F.count("*").alias("n"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.charts(spark, sf_dir).select("id", text_hash(("registration_no", "gender", "age", "chief_complaint", "pattern")).alias("text_hash"))


def short_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.charts(spark, sf_dir)
    return rows.select("id", cut(F.col("chief_complaint"), 8).alias("short"), edge_stripped(F.col("chief_complaint")).alias("bare"))


def org_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("org_id"), F.col("n_name").alias("org_name"))
    rows = views.logs(spark, sf_dir).withColumn("org_id", (F.col("org_id").cast("int") * 20).cast("string"))
    return records.looked_up(rows, names, "org_id", "org_name").groupBy("org_id", "org_name").agg(F.count("*").alias("n"))


def primary_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 25).alias("org_id"), (F.col("o_orderstatus") == "F").alias("is_primary"))
    orgs = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("org_id"), F.when(F.col("n_nationkey") % 3 != 0, "active").otherwise("closed").alias("status"))
    return records.primary_org(members, orgs)


def user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return records.prefix_list(users, "c_name", "00").select("c_custkey", "c_name")


def truncated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.truncated_list(views.records(spark, sf_dir).where("grade = '合格'"), filters.sort_order()).select("id", "truncated")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.RecordFilter(registration_no="R1", only_uncleaned=True, only_unparsed=True).apply(views.charts(spark, sf_dir))
    return records.counted_page(rows, filters.sort_order("registration_no", "asc"), 1, None, default=20).select("id", "registration_no", "total")


def ids_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = tuple(range(1, 200, 3))
    return filters.RecordFilter(ids=wanted).apply(views.records(spark, sf_dir)).select("id", "grade")


def scoped_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cleaning, export and an export of unqualified rows see, and those whose organisation is that of the request; one pass."""
    rows = views.records(spark, sf_dir)
    f = filters.RecordFilter(department="2-HIGH", grade="无效", create_range=("1990-01-01", "1990-01-02"))
    c = F.count_if
    good = F.col("grade") == QUALIFIED
    return rows.agg(
        c(filters.cleaning_filter(f).predicate() & good).alias("cleaning"), c(good & F.col("governed")).alias("export"), c(good & F.col("governed") & (F.col("grade") == "无效")).alias("empty"),
        c(filters.same_scope(F.col("org_id"), F.lit(" BUILDING "))).alias("same"), F.max(F.lit(filters.Scope("x", True).may_see("y") and not filters.Scope("x").may_see("y") and not filters.Scope("").may_see(""))).alias("access"),
    )


def overdue_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir).select("id", "org_id", (F.col("id") % 7 == 0).alias("is_obsolete"), F.when(F.col("id") % 2 == 0, "pending").otherwise("completed").alias("status"), F.date_add(F.col("visit_time").cast("date"), 9).alias("deadline_time"))
    return filters.visible_tasks(rows, filters.Scope("BUILDING"), "pending", F.to_date(F.lit("1997-01-01"))).select("id", "deadline_time")


def range_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir)
    tasks = rows.select(F.col("id").alias("record_id"), "score")
    left, open_tasks = filters.delete_by_filter(rows, tasks, filters.Scope("BUILDING"), filters.RecordFilter(grade="合格"))
    return left.agg(F.count("*").alias("records")).crossJoin(open_tasks.agg(F.count("*").alias("tasks"), F.sum("score").alias("points")))  # one row each


def dict_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.lint(_odd_terms(spark, sf_dir))


def dict_lint_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.lint_top(_odd_terms(spark, sf_dir), words=1).select("type", "word", "owners", "rn")


def _odd_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as terms with what a lint should see: repeats, long and short terms, sentences, terms that are their own alias."""
    key = F.col("p_partkey")
    term = F.when(key % 11 == 0, F.concat("p_name", F.lit("，"), "p_name")).when(key % 13 == 0, "x").when(key % 17 == 0, F.concat("p_name", F.lit("明显"))).when(key % 19 == 0, F.concat("p_name", F.lit(" of great length"))).otherwise(F.concat("p_name", key.cast("string")))
    aliases = F.when(key % 7 == 0, F.array("p_brand", term)).otherwise(F.array("p_brand"))
    return views.table(spark, sf_dir, "part").select(F.substring("p_type", 1, 5).alias("type"), term.alias("standard_term"), aliases.alias("aliases"))


def dict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = dic.in_scope(views.dictionary(spark, sf_dir), "effective", "org")
    return dic.search(terms, " BRAND#1", 2, 30).select("type", "standard_term", "total")


def dict_all_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.with_all_chars(dic.in_scope(views.dictionary(spark, sf_dir), "base"), "aeb")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.versions(views.dictionary(spark, sf_dir))


def dict_version_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.version_string(_versions(spark, sf_dir), "org")


def dict_sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = _versions(spark, sf_dir)
    indexed = version.where("length(type) % 3 <> 0").withColumn("version", F.when(F.length("type") % 3 == 1, F.col("version")).otherwise("old"))
    return dic.sync_status(version, indexed)


def dict_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.dictionary(spark, sf_dir)
    new = views.table(spark, sf_dir, "part").where("length(p_type) % 2 = 0").select(F.col("p_type").alias("type"), F.concat(F.lit(" new "), "p_brand").alias("standard_term"), F.array("p_name").alias("aliases"))
    out = dic.replaced(stored, new, "org")
    return out.groupBy("org_id", "type").agg(F.count("*").alias("terms"), F.sum(F.size("aliases")).alias("aliases"))


def dict_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.logs(spark, sf_dir).select(F.col("event_id").alias("id"), "org_id", F.when(F.col("event_id") % 3 == 0, "pending").otherwise("done").alias("status"), F.col("ts").alias("created"))
    last = rows.agg(F.max("created").alias("last")).first()[0]
    return dic.pending_proposals(rows, F.lit(last), most=5, days=7).select("id", "org_id")


def dict_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = views.logs(spark, sf_dir).select("org_id", F.col("target").alias("type"), (F.col("event_id") % 9).alias("version_no")).distinct()
    terms = snapshots.select(F.when(F.col("org_id") == "0", "new").otherwise(F.col("org_id")).alias("org_id"), "type")
    return dic.archived(snapshots, terms)


def dict_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dictionary(spark, sf_dir)
    return dic.merge_report(dic.in_scope(rows, "base"), dic.in_scope(rows, "org", "org"))


def dict_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dictionary(spark, sf_dir)
    out = dic.resolved(dic.in_scope(rows, "base"), dic.in_scope(rows, "org", "org"), "theirs")
    return out.groupBy("type").agg(F.count("*").alias("terms"), F.sum(F.size("aliases")).alias("aliases"))


def dict_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dictionary(spark, sf_dir)
    more = dic.in_scope(rows, "base").select("type", F.concat(F.lit(" "), F.upper("standard_term")).alias("standard_term"), F.array("standard_term", F.concat(F.lit(" x "), "standard_term"), F.lit("")).alias("aliases"))
    return dic.enriched(dic.in_scope(rows, "base"), more).select("type", "standard_term", F.array_join("aliases", ",").alias("aliases"))


_TIME = """CASE WHEN o_orderkey % 6 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN o_orderkey % 6 = 1 THEN date_trunc('minute', o_orderdate) WHEN o_orderkey % 6 = 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
  WHEN o_orderkey % 6 = 3 THEN date_trunc('second', o_orderdate) WHEN o_orderkey % 12 IN (4, 10) THEN NULL ELSE date_trunc('second', o_orderdate) END"""
_ROWS = f"""cells AS (SELECT 'f' || CAST(o_custkey % 3 AS VARCHAR) AS file, o_orderkey AS row, 'R' || CAST(o_orderkey AS VARCHAR) AS registration_no, CASE WHEN o_orderkey % 5 <> 0 THEN 'O' || CAST(o_orderkey % 50 AS VARCHAR) END AS outpatient_no,
  o_orderpriority AS department, {_TIME} AS visit_time, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_orderkey // 4 END AS INTEGER) AS visit_count,
  CASE WHEN o_orderkey % 5 = 0 THEN '门诊号为空' WHEN o_orderkey % 12 = 10 THEN '接诊时间无法识别' END AS reason FROM orders WHERE o_orderkey % 9 <> 0)"""
_ACT = f"""act0 AS (SELECT *, id % 41 = 0 AS gone, CASE WHEN id % 3 <> 0 THEN md5(department || CAST(score AS VARCHAR)) END AS text_hash, EXISTS (SELECT 1 FROM mentions WHERE record_id = id) AND id % 10 = 0 AS manual FROM charts),
act1 AS (SELECT *, NOT gone AND text_hash IS NOT NULL AND row_number() OVER (PARTITION BY text_hash, gone ORDER BY visit_time DESC NULLS LAST, id) > 1 AS copy,
  (CASE WHEN gender <> trim(gender) THEN 1 ELSE 0 END) + (CASE WHEN pattern <> trim(pattern) THEN 1 ELSE 0 END) + (CASE WHEN prescription <> trim(prescription) THEN 1 ELSE 0 END) AS r, CASE WHEN trim(pattern) = '' THEN 1 ELSE 0 END AS c,
  trim(coalesce(chief_complaint, '')) = '' AND trim(coalesce(tcm_diagnosis, '')) = '' AND trim(coalesce(present_illness, '')) = '' AND trim(coalesce(self_report, '')) = '' AS blank,
  NOT (id % 19 = 0) AND (EXISTS (SELECT 1 FROM mentions WHERE record_id = id) OR id % 23 = 0 OR id % 29 = 0 OR id % 31 = 0) AS document FROM act0),
act AS (SELECT *, CASE WHEN gone THEN 'skipped' WHEN copy THEN 'deduped' WHEN blank OR bad_document THEN 'isolated' WHEN grade = '合格' AND document THEN CASE WHEN {{skip}} OR manual THEN 'marked' ELSE 'normalized' END ELSE 'kept' END AS action FROM act1),
acted AS (SELECT *, CASE WHEN action IN ('skipped', 'deduped') THEN 0 ELSE r END AS repaired, CASE WHEN action IN ('skipped', 'deduped') THEN 0 ELSE c END AS cleared FROM act)"""
_CLEAN = f"WITH {_R}, {_M}, {_C}, {_ACT}"
_FIELD_ORDER = "list_position(['diseases', 'patternList', 'symptoms', 'herbs', 'formulaList', 'tongueList', 'pulseList', 'causeList'], field)"
_MASK = r"regexp_replace(chief_complaint, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1***\2', 'g')"
_W = views.DICTIONARY_SQL
_ODD = """odd AS (SELECT p_partkey AS k, substr(p_type, 1, 5) AS type, p_brand, CASE WHEN p_partkey % 11 = 0 THEN p_name || '，' || p_name WHEN p_partkey % 13 = 0 THEN 'x' WHEN p_partkey % 17 = 0 THEN p_name || '明显'
  WHEN p_partkey % 19 = 0 THEN p_name || ' of great length' ELSE p_name || CAST(p_partkey AS VARCHAR) END AS standard_term FROM part), words AS (SELECT type, standard_term, standard_term AS word FROM odd UNION ALL SELECT type, standard_term, p_brand FROM odd),
owners AS (SELECT type, word, count(DISTINCT standard_term) AS owners FROM words GROUP BY 1, 2 HAVING count(DISTINCT standard_term) > 2)"""
_EFF = f"eff AS (SELECT type, trim(standard_term) AS standard_term, arg_max(aliases, org_id <> '') AS aliases FROM dictionary GROUP BY 1, 2)"
_VER = """ver AS (SELECT org_id, type, substr(sha256(string_agg(e, chr(1) ORDER BY e)), 1, 32) AS version FROM (SELECT org_id, type, standard_term || chr(2) || array_to_string(aliases, ',') AS e FROM dictionary) GROUP BY 1, 2)"""

ORACLE: dict[str, str] = {
    "ingest_rejects": f"""WITH {_ROWS} SELECT file, row, reason, CAST(4 + CASE WHEN outpatient_no IS NULL THEN 0 ELSE 1 END + CASE WHEN row % 12 = 4 THEN 0 ELSE 1 END AS BIGINT) AS cells, registration_no FROM cells WHERE reason IS NOT NULL""",
    "ingest_rows": f"WITH {_ROWS} SELECT file, row, registration_no, 'first' AS pattern, visit_time, visit_count FROM cells WHERE reason IS NULL",
    "ingest_summary": f"WITH {_ROWS}, x AS (SELECT reason, row_number() OVER (ORDER BY file, row) AS pos FROM cells) SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL AND pos <= 1000) AS success, count(*) FILTER (WHERE reason IS NOT NULL OR pos > 1000) AS failed FROM x",
    "ingest_retry": f"WITH {_ROWS} SELECT count(*) AS total, count(*) FILTER (WHERE row % 12 <> 10) AS success, count(*) FILTER (WHERE row % 12 = 10) AS failed FROM cells WHERE reason IS NOT NULL",
    "ingest_dedup": f"""WITH {_ROWS}, h AS (SELECT file, row, 'o' AS org_id, CASE WHEN visit_count % 7 <> 0 THEN md5(outpatient_no || department) END AS text_hash FROM cells WHERE reason IS NULL),
e AS (SELECT DISTINCT md5('O' || CAST(o_orderkey % 20 AS VARCHAR) || o_orderpriority) AS x FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT org_id, text_hash, file, row FROM h WHERE text_hash IS NULL OR text_hash NOT IN (SELECT x FROM e) QUALIFY text_hash IS NULL OR row_number() OVER (PARTITION BY text_hash ORDER BY file, row) = 1""",
    "clean_actions": f"{_CLEAN.replace('{skip}', 'FALSE')} SELECT id, action, repaired, cleared FROM acted",
    "clean_counts": f"{_CLEAN.replace('{skip}', 'TRUE')} SELECT action, count(*) AS n, CAST(sum(repaired) AS BIGINT) AS repaired, CAST(sum(cleared) AS BIGINT) AS cleared FROM acted GROUP BY 1",
    "clean_result": f"""{_CLEAN.replace('{skip}', 'FALSE')} SELECT id, CASE WHEN action IN ('deduped', 'isolated') THEN '无效' ELSE grade END AS grade, CASE WHEN gone OR action IN ('deduped', 'isolated') THEN 'invalid' ELSE 'completed' END AS status,
  CASE WHEN action IN ('marked', 'normalized') THEN TRUE ELSE governed AND action NOT IN ('deduped', 'isolated') END AS governed, CASE WHEN gone THEN gender ELSE nullif(trim(gender), '') END AS gender, CASE WHEN gone THEN prescription ELSE nullif(trim(prescription), '') END AS prescription FROM acted""",
    "clean_reviews": f"{_CLEAN.replace('{skip}', 'FALSE')} SELECT id AS record_id, id % 10 = 0 OR action IN ('deduped', 'isolated') AS is_obsolete FROM acted",
    "clean_write_back": f"WITH {_R} SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE score END AS score, department FROM records",
    "replacement_pairs": f"""WITH {_M}, {_ALL}, p AS (SELECT id, trim(source_text) AS source_text, CASE WHEN length(term) > 3 THEN term || '*' ELSE term END AS standard_term, {_FIELD_ORDER} AS o, place FROM all_ents WHERE term IS NOT NULL AND source_text IS NOT NULL),
f AS (SELECT * FROM p WHERE source_text <> standard_term QUALIFY row_number() OVER (PARTITION BY id, source_text ORDER BY o, place) = 1)
SELECT id, source_text, standard_term, CAST(row_number() OVER (PARTITION BY id ORDER BY length(source_text) DESC, source_text) AS INTEGER) AS rank FROM f""",
    "effective_pairs": f"""WITH {_R}, {_M}, {_ALL}, {_C}, p AS (SELECT DISTINCT id, trim(source_text) AS source_text, term || '*' AS standard_term FROM all_ents WHERE term IS NOT NULL AND source_text IS NOT NULL)
SELECT id, source_text, standard_term FROM p JOIN charts USING (id) WHERE contains(coalesce(chief_complaint, ''), source_text) OR contains(coalesce(self_report, ''), source_text) OR contains(coalesce(pattern, ''), source_text)""",
    "provenance": f"""WITH {_R}, {_M}, s AS (SELECT record_id AS id, count(*) FILTER (WHERE kind = 'symptom') AS symptoms FROM mentions GROUP BY 1), x AS (
  SELECT id, s.id IS NOT NULL OR (id % 19 <> 0 AND id % 23 <> 0 AND (id % 29 = 0 OR id % 31 = 0)) AS document, nullif(symptoms, 0) AS symptoms FROM records r LEFT JOIN s USING (id))
SELECT id, CASE WHEN document THEN 'v9' END AS version, CASE WHEN document THEN '7' END AS terms, symptoms FROM x""",
    "export_rows": f"""WITH {_R}, {_C}, x AS (SELECT id, [registration_no, {_MASK}, 'd"' || CAST(score AS VARCHAR), CAST(CAST(visit_time AS DATE) AS VARCHAR)] AS cells FROM charts WHERE grade = '合格' AND governed)
SELECT id, array_to_string(list_transform(cells, lambda c: '"' || replace(coalesce(c, ''), '"', '""') || '"'), ',') AS line FROM x""",
    "preview_rows": f"WITH {_R}, {_C} SELECT id, visit_time, {_MASK} AS chief_complaint, (SELECT count(*) FROM charts) AS total FROM charts ORDER BY visit_time DESC NULLS LAST, id LIMIT 10",
    "log_csv": f"""WITH {views.LOGS_SQL} SELECT event_id, array_to_string(list_transform([operator, target, detail], lambda c: CASE WHEN contains(coalesce(c, ''), ',') OR contains(coalesce(c, ''), '"') OR contains(coalesce(c, ''), chr(10)) THEN '"' || replace(c, '"', '""') || '"' ELSE coalesce(c, '') END), ',') AS line FROM logs""",
    "record_summary": f"""WITH {_R}, {_C}, x AS (SELECT id, coalesce(nullif(trim(chief_complaint), ''), nullif(trim(tcm_diagnosis), ''), nullif(trim(western_diagnosis), '')) AS t FROM charts) SELECT id, CASE WHEN length(t) > 40 THEN left(t, 40) || '…' ELSE t END AS summary FROM x""",
    "nlp_text": f"WITH {_R}, {_C} SELECT id, coalesce(nullif(trim(chief_complaint), '') || '。', '') || coalesce(nullif(trim(tongue), '') || '。', '') || coalesce(nullif(trim(pulse), '') || '。', '') || coalesce(nullif(trim(pattern), '') || '。', '') AS text FROM charts",
    "record_completeness": f"""WITH {_R}, {_C}, x AS (SELECT id, list_filter([CASE WHEN gender IS NULL THEN '性别' END, CASE WHEN age IS NULL THEN '年龄' END, CASE WHEN tongue IS NULL THEN '舌诊' END, CASE WHEN pulse IS NULL THEN '脉诊' END, CASE WHEN trim(coalesce(pattern, '')) = '' THEN '证型' END,
  CASE WHEN visit_time IS NULL THEN '接诊时间' END], lambda v: v IS NOT NULL) AS m FROM charts) SELECT id, CAST(6 - len(m) AS INTEGER) AS present, array_to_string(m, '、') AS missing FROM x""",
    "trim_flags": f"""WITH {_R}, {_C} SELECT {", ".join(f"CASE WHEN {c} IS NULL OR (trim({c}) = {c} AND {c} <> '') THEN 'kept' WHEN trim({c}) = '' THEN 'cleared' ELSE 'trimmed' END AS {n}" for c, n in (("pattern", "pattern"), ("prescription", "prescription"), ("western_diagnosis", "diagnosis")))},
  count(*) AS n FROM charts GROUP BY 1, 2, 3""",
    "text_hashes": f"""WITH {_R}, {_C} SELECT id, md5({" || ".join(f"CAST(length(trim(coalesce({c}, ''))) AS VARCHAR) || ':' || trim(coalesce({c}, '')) || ';'" for c in ("registration_no", "gender", "age", "chief_complaint", "pattern"))}) AS text_hash FROM charts""",
    "short_cells": f"WITH {_R}, {_C} SELECT id, left(trim(chief_complaint), 8) AS short, trim(chief_complaint, '，。、；：！？,.;:!? ') AS bare FROM charts",
    "org_lookup": f"WITH {views.LOGS_SQL} SELECT CAST(CAST(org_id AS INTEGER) * 20 AS VARCHAR) AS org_id, coalesce(n_name, '—') AS org_name, count(*) AS n FROM logs LEFT JOIN nation ON n_nationkey = CAST(org_id AS INTEGER) * 20 GROUP BY 1, 2",
    "primary_org": "SELECT o_custkey AS user_id, min(o_orderkey % 25) AS org_id FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE o_orderstatus = 'F' AND n_nationkey % 3 <> 0 GROUP BY 1",
    "user_search": "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00') ORDER BY c_name LIMIT 20",
    "truncated_tasks": f"WITH {_R} SELECT id, (SELECT count(*) FROM records WHERE grade = '合格') > 50 AS truncated FROM records WHERE grade = '合格' ORDER BY visit_time DESC NULLS LAST, id LIMIT 50",
    "search_page": f"""WITH {_R}, {_M}, {_C}, h AS (SELECT * FROM charts WHERE contains(registration_no, 'R1') AND NOT governed AND (no_document OR (NOT bad_document AND id % 29 <> 0 AND id % 31 <> 0 AND id NOT IN (SELECT record_id FROM mentions))))
SELECT id, registration_no, (SELECT count(*) FROM h) AS total FROM h ORDER BY registration_no, id LIMIT 20""",
    "ids_in": f"WITH {_R} SELECT id, grade FROM records WHERE id < 200 AND id % 3 = 1",
    "scoped_filters": f"""WITH {_R} SELECT count(*) FILTER (WHERE department = '2-HIGH' AND grade = '合格') AS cleaning, count(*) FILTER (WHERE grade = '合格' AND governed) AS export, 0::BIGINT AS empty, count(*) FILTER (WHERE org_id = 'BUILDING') AS same, TRUE AS access FROM records""",
    "overdue_tasks": f"WITH {_R} SELECT id, CAST(visit_time AS DATE) + 9 AS deadline_time FROM records WHERE org_id = 'BUILDING' AND id % 7 <> 0 AND id % 2 = 0 AND CAST(visit_time AS DATE) + 9 < DATE '1997-01-01'",
    "range_delete": f"WITH {_R} SELECT count(*) AS records, count(*) AS tasks, CAST(sum(score) AS BIGINT) AS points FROM records WHERE NOT (org_id = 'BUILDING' AND coalesce(grade, '') = '合格')",
    "dict_lint": f"""WITH {_ODD} SELECT type, standard_term, 'self_alias' AS rule FROM odd WHERE k % 7 = 0 UNION ALL SELECT type, standard_term, 'sentence_like' FROM odd WHERE regexp_matches(standard_term, '[。；;，,、]') OR regexp_matches(standard_term, '反复发作|反复出现|(反复|发作|加重|减轻|明显|持续|多年|数次)$')
UNION ALL SELECT type, standard_term, 'too_short' FROM odd WHERE length(standard_term) < 2 UNION ALL SELECT type, standard_term, 'too_long' FROM odd WHERE length(standard_term) > 20
UNION ALL SELECT type, standard_term, 'duplicate_term' FROM odd GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT type, word, 'shared_alias' FROM owners""",
    "dict_lint_top": f"WITH {_ODD}, many AS (SELECT type FROM owners GROUP BY 1 HAVING count(*) > 1) SELECT type, word, owners, CAST(row_number() OVER (PARTITION BY type ORDER BY owners DESC, word) AS INTEGER) AS rn FROM owners WHERE type IN (SELECT type FROM many) QUALIFY rn <= 12",
    "dict_search": f"""WITH {_W}, {_EFF}, h AS (SELECT * FROM eff WHERE contains(lower(standard_term), 'brand#1') OR len(list_filter(aliases, lambda a: contains(lower(a), 'brand#1'))) > 0)
SELECT type, standard_term, (SELECT count(*) FROM h) AS total FROM h ORDER BY type, standard_term LIMIT 30 OFFSET 30""",
    "dict_all_chars": f"WITH {_W} SELECT type, standard_term FROM dictionary WHERE org_id = '' AND contains(standard_term, 'a') AND contains(standard_term, 'e') AND contains(standard_term, 'b')",
    "dict_version_string": f"WITH {_W}, {_VER}, b AS (SELECT type, arg_max(version, org_id <> '') AS v FROM ver GROUP BY 1) SELECT string_agg(type || ':' || substr(v, 1, 8) || ';', '' ORDER BY type) AS version FROM b",
    "dict_sync_status": f"WITH {_W}, {_VER} SELECT org_id, type, CASE length(type) % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'synced' ELSE 'stale' END AS state FROM ver",
    "dict_replaced": f"""WITH {_W}, n AS (SELECT 'org' AS org_id, p_type AS type, 'new ' || p_brand AS standard_term, count(DISTINCT p_name) AS a FROM part WHERE length(p_type) % 2 = 0 GROUP BY 1, 2, 3),
x AS (SELECT org_id, type, len(aliases) AS a FROM dictionary WHERE org_id = '' OR type NOT IN (SELECT type FROM n) UNION ALL SELECT org_id, type, a FROM n) SELECT org_id, type, count(*) AS terms, CAST(sum(a) AS BIGINT) AS aliases FROM x GROUP BY 1, 2""",
    "dict_proposals": f"WITH {views.LOGS_SQL} SELECT event_id AS id, org_id FROM logs WHERE event_id % 3 = 0 AND ts >= (SELECT max(ts) FROM logs) - INTERVAL 7 DAYS QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY ts, event_id) <= 5",
    "dict_archive": f"""WITH {views.LOGS_SQL}, s AS (SELECT DISTINCT org_id, target AS type, event_id % 9 AS version_no FROM logs), t AS (SELECT DISTINCT CASE WHEN org_id = '0' THEN 'new' ELSE org_id END AS org_id, type FROM s),
n AS (SELECT t.org_id, t.type, coalesce(max(version_no), 0) + 1 AS version_no FROM t LEFT JOIN s USING (org_id, type) GROUP BY 1, 2) SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY org_id, type ORDER BY version_no DESC) <= 5""",
    "dict_merge_report": f"""WITH {_W}, a AS (SELECT * FROM dictionary WHERE org_id = ''), b AS (SELECT * FROM dictionary WHERE org_id = 'org'), wa AS (SELECT DISTINCT type, standard_term, unnest(list_append(aliases, standard_term)) AS word FROM a), wb AS (SELECT DISTINCT type, standard_term, unnest(list_append(aliases, standard_term)) AS word FROM b)
SELECT a.type, a.standard_term AS word, 'sameTermDiff' AS conflict FROM a JOIN b USING (type, standard_term) WHERE a.aliases <> b.aliases
UNION ALL SELECT type, word, 'collision' FROM (SELECT type, word, list(wa.standard_term) AS x, list(wb.standard_term) AS y FROM wa JOIN wb USING (type, word) GROUP BY 1, 2) WHERE len(list_intersect(x, y)) = 0""",
    "dict_resolved": f"WITH {_W}, x AS (SELECT type, standard_term, arg_max(aliases, org_id = 'org') AS a FROM dictionary GROUP BY 1, 2) SELECT type, count(*) AS terms, CAST(sum(len(a)) AS BIGINT) AS aliases FROM x GROUP BY 1",
    "dict_enriched": f"""WITH {_W}, d AS (SELECT type, standard_term, aliases FROM dictionary WHERE org_id = '') SELECT type, standard_term, array_to_string(list_sort(aliases), ',') AS aliases FROM d
UNION ALL SELECT type, upper(standard_term), 'x ' || standard_term FROM d""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
