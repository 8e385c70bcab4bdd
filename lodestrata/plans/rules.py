"""Queries over scoring rules, text extraction and term normalisation, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import entities as ent
from lodestrata.operators import decompose, extraction, normalize, qc, stats
from lodestrata.plans import views
from lodestrata.plans.structured import _ALL, _C, _M, _R

RULES = qc.RuleSet(consistency=(qc.Consistency("表里", "symptom", ("咳嗽", "心悸", "胸闷"), "pulse", ("脉浮",)),))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts with a column of strings for each list, and the number of standardized entities without a level."""
    rows = views.charts(spark, sf_dir).withColumn("doc", ent.parsed(F.col("structured_data")))
    lists = F.map_from_entries(F.array(*(F.struct(x["kind"], x["elements"]) for x in ent.element_lists(F.col("doc"), ent.element_fields))))
    rows = rows.select("*", F.explode(F.array(lists)).alias("lists"))
    texts = F.transform_values("lists", lambda _, l: F.transform(F.filter(l, lambda e: e["term"].isNotNull()), lambda e: e["term"]))
    missed = lambda e: ~e["plain"] & ~F.coalesce(e["norm_level"].between(1, 3), F.lit(False))
    misses = sum((F.coalesce(F.array_size(F.filter(F.col("lists")[k], missed)), F.lit(0)) for k in RULES.standardized), F.lit(0))
    copies = views.records(spark, sf_dir).withColumn("text_hash", F.md5(F.concat("department", F.col("score").cast("string"))))
    flags = qc.duplicate_flag(copies).select("id", "duplicate")
    return rows.select("*", texts.alias("texts"), misses.cast("long").alias("misses")).drop("lists").join(flags, "id").withColumn("gender", F.trim("gender"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir)
    none = F.array().cast("array<string>")
    lists = {t: F.col("doc")[t] for t in ent.FIELDS}
    texts = {k: F.coalesce(F.col("texts")[k], none) for k in ent.FIELDS.values()}
    return qc.scored(rows.withColumnRenamed("score", "old_score").withColumnRenamed("grade", "old_grade"), RULES, lists, texts, F.col("misses"), F.col("duplicate"))


def qc_score_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "score", "grade", "status", F.size("deductions").cast("long").alias("deductions"))


def qc_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("id", F.explode("deductions").alias("d"))
    return rows.groupBy("d.type", "d.item", "d.points").agg(F.count("*").alias("n"))


def qc_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("id", F.explode("deductions").alias("d")).where("d.type = '逻辑冲突'")
    return rows.select("id", "d.reason")


def qc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir)
    return qc.checked(rows, RULES, {t: F.col("doc")[t] for t in ent.FIELDS})


def qc_issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("grade = '待复核'").groupBy(qc.issue_type(F.col("deductions")).alias("issue")).agg(F.count("*").alias("n"))


def qc_fallback_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    computed = _scored(spark, sf_dir).select("id", F.col("score").alias("computed"), F.col("old_score").alias("score"))
    return qc.with_fallback_score(computed, F.col("computed")).select("id", "score", "recomputed")


def qc_governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("id", qc.governed_after(F.col("governed"), F.col("grade")).alias("governed"))
    return rows


def qc_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    own = F.filter("deductions", lambda d: d["type"] == "格式错误")
    return rows.select("id", qc.narrative(own, F.col("score"), F.col("grade")).alias("text"))


def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir).withColumn("structured_data", F.lit(None).cast("string"))
    cut = qc.deduction("重复数据", "重复", 5, "x")
    fresh = qc.deduction("格式错误", "年龄", 5, "y")
    none = F.array().cast("array<struct<type:string,item:string,points:int,reason:string>>")
    rows = rows.withColumn("deductions", F.when(F.col("id") % 4 == 0, F.array(cut)).otherwise(none))
    seen = qc.fingerprint(F.col("structured_data"), F.col("score"), F.col("grade"))
    reviews = rows.select("id", F.when(F.col("id") % 5 == 0, "old").otherwise(seen).alias("fingerprint"), F.array(fresh, cut).alias("deductions"))
    return qc.reviewed(rows, reviews, RULES).select("id", "outcome", "score", "grade")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third record has a review task that began with its visit; a few tasks belong to no record."""
    rows = views.records(spark, sf_dir).where("visit_time is not null")
    kept = rows.select(F.when(F.col("id") % 33 == 0, -F.col("id")).otherwise(F.col("id")).alias("record_id"), F.when(F.col("id") % 2 == 0, "completed").otherwise("pending").alias("status"), F.col("visit_time").cast("date").alias("create_day"))
    return kept.where(F.col("record_id") % 3 == 0).withColumn("deadline", F.date_add("create_day", 9))


def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.merge_reviews(_tasks(spark, sf_dir), views.records(spark, sf_dir), F.to_date(F.lit("1998-08-03")))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).select("status", F.col("deadline").alias("deadline_time"), (F.col("record_id") < 0).alias("is_obsolete"))
    return stats.review_counts(rows, F.to_date(F.lit("1996-01-01")))


def segment_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(views.charts(spark, sf_dir), "chief_complaint").select("id", "field", "term", "dosage")


def reroute_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ent.exploded(views.charts(spark, sf_dir)).where("term is not null")
    return extraction.rerouted(rows).groupBy("field", "moved", "term").agg(F.count("*").alias("n"))


def noise_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.charts(spark, sf_dir).select("id", "chief_complaint", "structured_data")
    e = ent.exploded(rows, keep=("chief_complaint",)).where("term is not null").withColumnRenamed("chief_complaint", "text")
    out = extraction.dropped_noise(e)
    return out.groupBy("field", "term", "reason").agg(F.count("*").alias("n"))


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    spans = line.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("label"), (F.col("l_partkey") % 50).alias("begin"), (F.col("l_partkey") % 50 + 5 + F.col("l_linenumber")).alias("end"), (F.col("l_suppkey") % 8 / F.lit(8.0)).alias("score"))
    return extraction.merged_spans(spans)


def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole texts for a model of bounded input; tested by brute force."""
    rows = views.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.posexplode(extraction.windows(F.col("text"))).alias("at", "window")).select("doc_id", "at", F.length("window").alias("n"))


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Altered names of parts as inputs, and their names as terms with an alias each."""
    names = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("w")).distinct()
    forms = F.array("w", F.expr("left(w, length(w) - 1)"), F.concat("w", F.lit("s")), F.replace("w", F.lit(" "), F.lit("-")), F.replace("w", F.lit("e"), F.lit("a")), F.concat(F.lit("no "), "w"), F.reverse("w"), F.substring("w", 2, 100))
    inputs = names.select(F.lit("word").alias("type"), F.explode(forms).alias("input"))
    return inputs, names.select(F.lit("word").alias("type"), F.col("w").alias("standard_term"), F.array(F.replace("w", F.lit(" "), F.lit("-"))).alias("aliases"))


def fuzzy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, terms = _words(spark, sf_dir)
    return normalize.judge(inputs, terms).select("input", "standard_term", "level")


def dictionary_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, terms = _words(spark, sf_dir)
    out = normalize.impact(inputs, terms.where("standard_term < 'm'"), terms)
    return out.groupBy("change", "old_level", "new_level", "suspect").agg(F.count("*").alias("n"))


def normalized_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a small vocabulary judged against it, negated ones dropped."""
    inputs, terms = _words(spark, sf_dir)
    rows = inputs.withColumn("negated", F.col("input").startswith("w"))
    out = normalize.normalized(rows.select("type", F.col("input").alias("content"), "negated"), terms, F.col("negated"))
    return out.select("content", "term", "level")


def normalize_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "part").select("p_name").distinct()
    words = names.select(F.explode(F.split("p_name", " ")).alias("standard_term")).distinct().select(F.lit("word").alias("type"), "standard_term", F.array().cast("array<string>").alias("aliases"))
    inputs = names.select(F.lit("word").alias("type"), F.explode(F.array("p_name", F.concat("p_name", F.lit("x")), F.concat("p_name", F.lit(" ")))).alias("input"))
    return decompose.covered(inputs, words, skip=" ").select("input", F.array_join("parts", ",").alias("parts"))


def normalize_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, terms = _words(spark, sf_dir)
    return normalize.stripped_match(inputs, terms, ("no ",), ("s",), block="q").select("input", "standard_term")


def reroute_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ent.exploded(views.charts(spark, sf_dir)).where("term is not null").select("id", F.col("kind").alias("type"), F.col("term").alias("content"))
    none = F.array().cast("array<string>")
    terms = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.lit(w).alias("standard_term")) for k, w in _REROUTE))).alias("t")).select("t.type", "t.standard_term", none.alias("aliases"))
    out = normalize.rerouted_types(rows, terms, {"symptom": ("pulse", "tongue"), "disease": ("cause", "symptom", "pattern")})
    return out.groupBy("type", "content", "moved").agg(F.count("*").alias("n"))


_REROUTE = (("pulse", "脉细数"), ("pulse", "尺沉"), ("tongue", "舌下瘀点"), ("symptom", "咳嗽"), ("pulse", "咳嗽"))


def without_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ent.exploded(views.charts(spark, sf_dir)).where("term is not null").select(F.col("kind").alias("type"), F.substring("term", 1, 2).alias("content"))
    short = rows.withColumn("content", F.when(F.col("type") == "herb", F.substring("content", 1, 1)).otherwise(F.col("content")))
    terms = views.table(spark, sf_dir, "part").select(F.lit("herb").alias("type"), F.substring("p_name", 1, 1).alias("standard_term"), F.array().cast("array<string>").alias("aliases")).where("standard_term < 'm'").distinct()
    return normalize.without_fragments(short, terms).groupBy("type", "content").agg(F.count("*").alias("n"))


def herb_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ent.exploded(views.charts(spark, sf_dir)).where("kind = 'herb' and term is not null")
    _, terms = _words(spark, sf_dir)
    herbs = normalize.herb_entities(rows.select("id", F.concat("term", F.lit("s")).alias("name"), F.col("source_text").alias("raw"), "dosage"), terms.withColumn("type", F.lit("herb")))
    return herbs.groupBy("name", "dosage", "level").agg(F.count("*").alias("n"))


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names that lists lack, from the customers' names and parts; levels as the lists have them."""
    rows = ent.exploded(views.charts(spark, sf_dir)).where("kind = 'herb' and term is not null").select("id", F.col("kind").alias("type"), F.col("term").alias("content"), F.col("norm_level").alias("level"))
    raw = views.charts(spark, sf_dir).select("id", F.lit("herb").alias("type"), F.concat_ws(" ", "prescription", "chief_complaint").alias("text"))
    terms = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit("herb").alias("type"), F.lit(w).alias("standard_term")) for w in ("苍术", "黄柏", "当归")))).alias("t")).select("t.type", "t.standard_term", F.array().cast("array<string>").alias("aliases"))
    out = normalize.backfilled(rows, raw, terms)
    return out.groupBy("content", "level").agg(F.count("*").alias("n"))


def suggestion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, terms = _words(spark, sf_dir)
    return normalize.suggestion_text(normalize.suggest(inputs, terms, top=3)).select("input", "text")


_E = "'" + "', '".join(RULES.standardized) + "'"
_LISTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in views.KINDS)
_FILLED = {"symptom": "(trim(coalesce(chief_complaint, '')) <> '' OR trim(coalesce(self_report, '')) <> '' OR trim(coalesce(present_illness, '')) <> '')", "disease": "(trim(coalesce(tcm_diagnosis, '')) <> '' OR trim(coalesce(western_diagnosis, '')) <> '')", "pattern": "trim(coalesce(pattern, '')) <> ''", "tongue": "trim(coalesce(tongue, '')) <> ''", "pulse": "trim(coalesce(pulse, '')) <> ''", "herb": "trim(coalesce(prescription, '')) <> ''"}


def _label(kind: str) -> str:
    return next(e.name for e in RULES.elements if e.field == {v: k for k, v in ent.FIELDS.items()}[kind])


_PARTS = "[" + ", ".join(f"CASE WHEN coalesce(n_{k}, 0) > 0 THEN NULL WHEN {f} THEN ('核心字段缺失', '{_label(k)}', 6) ELSE ('核心字段缺失', '{_label(k)}', 12) END" for k, f in _FILLED.items()) + "]"
_QC = f"""counts AS (SELECT id, {_LISTS}, count(*) FILTER (WHERE kind IN ({_E}) AND NOT plain AND coalesce(norm_level, 0) = 0) AS misses,
    bool_or(kind = 'symptom' AND (contains(term, '咳嗽') OR contains(term, '心悸') OR contains(term, '胸闷'))) AS triggered, bool_or(kind = 'pulse' AND contains(term, '脉浮')) AS met,
    count(term) FILTER (WHERE kind = 'pulse') AS pulses FROM all_ents GROUP BY 1),
dup AS (SELECT id, md5(department || CAST(score AS VARCHAR)) IS NOT NULL AND row_number() OVER (PARTITION BY md5(department || CAST(score AS VARCHAR)) ORDER BY visit_time DESC NULLS LAST, id) > 1 AS duplicate FROM records),
parts AS (SELECT c.*, coalesce(misses, 0) AS misses, duplicate, coalesce(triggered, FALSE) AND coalesce(pulses, 0) > 0 AND NOT coalesce(met, FALSE) AS conflict,
  list_filter({_PARTS}, lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN age IS NOT NULL AND NOT regexp_matches(age, '^(\\d+(\\.\\d+)?(岁|个月|月|天)?)+$') THEN ('格式错误', '年龄', 5) END,
    CASE WHEN gender IS NOT NULL AND trim(gender) NOT IN ('男', '女', '未知的性别') THEN ('格式错误', '性别', 5) END], lambda x: x IS NOT NULL) AS wrong
  FROM charts c LEFT JOIN counts USING (id) JOIN dup USING (id)),
qc AS (SELECT *, list_concat(list_concat(missing, CASE WHEN conflict THEN [('逻辑冲突', '表里', 10)] ELSE [] END), list_concat(wrong, list_concat(
    CASE WHEN misses > 0 THEN [('术语未标准化', '术语', CAST(CASE WHEN misses <= 5 THEN misses ELSE 5 + (misses - 5) // 5 END AS INTEGER))] ELSE [] END, CASE WHEN duplicate THEN [('重复数据', '重复', 5)] ELSE [] END))) AS cuts FROM parts),
pts AS (SELECT *, CAST(greatest(0, 100 - coalesce(list_sum(list_transform(cuts, lambda x: x[3])), 0)) AS INTEGER) AS points FROM qc),
graded AS (SELECT *, CASE WHEN points < 60 THEN '无效' WHEN conflict THEN '待复核' WHEN points >= 80 THEN '合格' ELSE '待复核' END AS new_grade FROM pts)"""
_Q = f"WITH {_R}, {_M}, {_ALL}, {_C}, {_QC}"
_TASKS = """tasks AS (SELECT * FROM (SELECT CASE WHEN id % 33 = 0 THEN -id ELSE id END AS record_id, CASE WHEN id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CAST(visit_time AS DATE) AS create_day,
  CAST(visit_time AS DATE) + 9 AS deadline FROM records WHERE visit_time IS NOT NULL) WHERE record_id % 3 = 0)"""
_SEG = r"list_filter(regexp_split_to_array(coalesce(chief_complaint, ''), '[，。、；;\s]+'), lambda s: s <> '')"
_CJ = r"[\x{4e00}-\x{9fff}]"
_NOT_OURS = "NOT regexp_matches(s, '^(关节|尺肤|苔藓|尖锐|脉下)')"
_SHAPED = rf"((regexp_matches(s, '^[舌苔][^，。、；;\s]{{1,8}}$') AND NOT regexp_matches(s, '^.藓')) OR regexp_matches(s, '^或?({extraction.TONGUE_MORPH})'))"
_WORDS = """names AS (SELECT DISTINCT p_name AS w FROM part), inputs AS (SELECT DISTINCT unnest([w, left(w, length(w) - 1), w || 's', replace(w, ' ', '-'), replace(w, 'e', 'a'), 'no ' || w, reverse(w), substr(w, 2)]) AS input FROM names),
terms AS (SELECT w AS standard_term, replace(w, ' ', '-') AS alias FROM names)"""


def _judge(terms: str, out: str) -> str:
    return f"""{out}_all AS (SELECT input, standard_term, 1 AS level, CASE WHEN input = standard_term THEN 0.0 ELSE 1.0 END AS o FROM inputs JOIN {terms} ON input = standard_term OR input = alias),
{out}_more AS (SELECT input, standard_term, CASE WHEN (contains(input, standard_term) AND length(input) - length(standard_term) <= 1) OR (contains(input, alias) AND length(alias) >= 2 AND length(input) - length(alias) <= 1) THEN 2
    WHEN NOT contains(input, standard_term) AND NOT contains(standard_term, input) AND dice >= 0.8 THEN 3 END AS level, CASE WHEN (contains(input, standard_term) AND length(input) - length(standard_term) <= 1) OR (contains(input, alias) AND length(input) - length(alias) <= 1) THEN 0.0 ELSE -dice END AS o
  FROM (SELECT *, len(list_intersect(a, b)) * 2.0::DOUBLE / (len(a) + len(b)) AS dice FROM (SELECT *, list_distinct(string_split(input, '')) AS a, list_distinct(string_split(standard_term, '')) AS b FROM inputs, {terms})) WHERE length(input) >= 2),
{out}_top AS (SELECT input, standard_term, level FROM (SELECT * FROM {out}_all UNION ALL SELECT * FROM {out}_more WHERE level IS NOT NULL AND input NOT IN (SELECT input FROM {out}_all))
  QUALIFY row_number() OVER (PARTITION BY input ORDER BY level, o, length(standard_term), standard_term) = 1),
{out} AS (SELECT input, standard_term, coalesce(level, 0) AS level FROM inputs LEFT JOIN {out}_top USING (input))"""


_CORE = "regexp_replace(term, '^[左右双两]', '')"
_PT = rf"""(NOT regexp_matches(term, '^(关节|尺肤|苔藓|尖锐|脉下)') AND NOT regexp_matches({_CORE}, '^(关节|尺肤|苔藓|尖锐|脉下)') AND (regexp_matches({_CORE}, '^[脉舌]')
  OR (regexp_matches({_CORE}, '^[尺寸关尖根苔]') AND regexp_matches(term, '^{_CJ}+$')) OR term IN ('动惕', '动剔', '弦滑', '浮滑', '浮数')))"""
_MOVES = f"""moves AS (SELECT id, field, place, term, CASE WHEN field = 'symptoms' AND {_PT} THEN CASE WHEN regexp_matches({_CORE}, '^[舌尖根苔]') THEN 'tongueList' ELSE 'pulseList' END
  WHEN field = 'symptoms' AND regexp_matches(term, '^({'|'.join(extraction.INQUIRY)})') AND NOT regexp_matches(term, '^({'|'.join(extraction.NO_INQUIRY)})') THEN 'inquiry' ELSE field END AS dest FROM all_ents WHERE term IS NOT NULL)"""
_NEG = "(regexp_matches({c}, '无|未|莫|非|否认|排除') OR (contains({c}, '不') AND NOT regexp_matches({c}, '不[寐适安宁固化和利扬仁遂孕消佳畅眠食欲得解知足均能受育明振规思运痛调]')))"

ORACLE: dict[str, str] = {
    "qc_score_grade": f"{_Q} SELECT id, points AS score, new_grade AS grade, CASE new_grade WHEN '合格' THEN 'completed' WHEN '待复核' THEN 'reviewing' ELSE 'invalid' END AS status, len(cuts) AS deductions FROM graded",
    "qc_deductions": f"{_Q}, x AS (SELECT unnest(cuts) AS c FROM graded) SELECT c[1] AS type, c[2] AS item, c[3] AS points, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "qc_conflicts": f"{_Q} SELECT id, '表里：脉象与症状不符' AS reason FROM graded WHERE conflict",
    "qc_check": f"{_Q} SELECT id, array_to_string(list_concat(list_transform(list_filter(missing, lambda x: x[3] = 12), lambda x: x[2]), list_transform(list_filter(missing, lambda x: x[3] = 6), lambda x: x[2])), '、') AS missing, array_to_string(list_transform(wrong, lambda x: x[2]), '、') AS format_errors FROM graded",
    "qc_issue_types": f"{_Q} SELECT CASE WHEN conflict THEN 'conflict' WHEN len(missing) > 0 THEN 'missing' ELSE 'score' END AS issue, count(*) AS n FROM graded WHERE new_grade = '待复核' GROUP BY 1",
    "qc_fallback_score": f"{_Q} SELECT id, coalesce(score, points) AS score, score IS NULL AS recomputed FROM graded",
    "qc_governed": f"{_Q} SELECT id, governed AND new_grade = '合格' AS governed FROM graded",
    "qc_narrative": f"{_Q} SELECT id, '评分 ' || points || '，' || new_grade || CASE WHEN len(wrong) > 0 THEN '。' || array_to_string(list_transform(wrong, lambda x: '格式错误：' || x[2] || ' -5'), '；') ELSE '。无扣分' END AS text FROM graded",
    "review_outcomes": f"""WITH {_R}, o AS (SELECT *, CASE WHEN grade = '无效' THEN 'invalid' WHEN id % 5 = 0 THEN 'stale' ELSE 'accepted' END AS outcome, CASE WHEN id % 4 = 0 THEN 90 ELSE 95 END AS points FROM records)
SELECT id, outcome, CASE WHEN outcome = 'accepted' THEN points ELSE score END AS score, CASE WHEN outcome = 'accepted' THEN '合格' ELSE grade END AS grade FROM o""",
    "review_merge": f"""WITH {_R}, {_TASKS} SELECT coalesce(t.record_id, r.id) AS record_id, CASE WHEN grade = '待复核' THEN 'pending' ELSE status END AS status, CASE WHEN grade = '待复核' THEN DATE '1998-08-03' ELSE create_day END AS create_day,
  CASE WHEN grade = '待复核' THEN DATE '1998-08-12' ELSE deadline END AS deadline, grade IS NOT NULL AND grade <> '待复核' AS is_obsolete FROM tasks t FULL JOIN records r ON r.id = t.record_id WHERE coalesce(grade = '待复核', FALSE) OR status IS NOT NULL""",
    "review_counts": f"WITH {_R}, {_TASKS} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'pending' AND deadline < DATE '1996-01-01') AS overdue FROM tasks WHERE record_id >= 0",
    "segment_extract": rf"""WITH {_R}, {_C}, seg AS (SELECT id, chief_complaint AS text, unnest({_SEG}) AS s FROM charts),
whole AS (SELECT id, s FROM seg WHERE regexp_matches(s, '^脉[^，。、；;\s]{{1,6}}$')),
herb AS (SELECT id, unnest(list_zip(regexp_extract_all(chief_complaint, '(?:^|[，,、;；。\s（(])({_CJ}{{2,6}})\s*(\d+(?:\.\d+)?\s*(?:g|克))', 1), regexp_extract_all(chief_complaint, '(?:^|[，,、;；。\s（(])({_CJ}{{2,6}})\s*(\d+(?:\.\d+)?\s*(?:g|克))', 2))) AS h FROM charts WHERE chief_complaint IS NOT NULL)
SELECT id, 'tongueList' AS field, CASE WHEN {_SHAPED} THEN regexp_replace(s, '^或', '') ELSE s END AS term, CAST(NULL AS VARCHAR) AS dosage FROM seg WHERE {_SHAPED} OR (regexp_matches(s, '^{_CJ}{{1,8}}$') AND regexp_matches(s, '^(尖|根|苔|边|齿痕)') AND {_NOT_OURS})
UNION ALL SELECT id, 'pulseList', s, NULL FROM whole
UNION ALL SELECT * FROM (SELECT DISTINCT id, 'pulseList', s, NULL FROM (SELECT id, s FROM seg WHERE regexp_matches(s, '^{_CJ}{{2,6}}$') AND regexp_matches(s, '^[尺寸关]') AND {_NOT_OURS}
  UNION ALL SELECT id, unnest(regexp_extract_all(chief_complaint, '(?:左|右)(?:寸|关|尺)[^，。、；;\s]{{0,4}}')) FROM charts) WHERE (id, s) NOT IN (SELECT id, s FROM whole))
UNION ALL SELECT id, 'causeList', w, NULL FROM charts, (SELECT unnest(['{"', '".join(extraction.CAUSES)}']) AS w) WHERE contains(chief_complaint, w)
UNION ALL SELECT id, 'treatmentList', unnest(regexp_extract_all(chief_complaint, '{extraction.TREATMENT}')), NULL FROM charts
UNION ALL SELECT id, 'herbs', h[1], first(h[2]) FROM herb WHERE regexp_matches(h[1], '^{_CJ}{{2,5}}$') AND NOT regexp_matches(h[1], '{"|".join(extraction.NO_HERB)}') AND NOT regexp_matches(h[1], '^({"|".join(extraction.PROVINCES)})') GROUP BY id, h[1]""",
    "reroute_entities": f"""WITH {_M}, {_ALL}, {_MOVES}, r AS (SELECT *, row_number() OVER (PARTITION BY id, dest, term ORDER BY dest <> field, place) AS rn FROM moves)
SELECT dest AS field, dest <> field AS moved, term, count(*) AS n FROM r WHERE dest = field OR dest = 'inquiry' OR rn = 1 GROUP BY 1, 2, 3""",
    "noise_reasons": rf"""WITH {_R}, {_M}, {_ALL}, {_C}, x AS (SELECT field, term, coalesce(chief_complaint, '') AS text FROM all_ents JOIN charts USING (id) WHERE term IS NOT NULL),
y AS (SELECT field, term, string_split(text, term) AS cuts FROM x), z AS (SELECT field, term, {_NEG.format(c='term')} OR (len(cuts) > 1 AND list_bool_and(list_transform(cuts[:len(cuts) - 1], lambda c: {_NEG.format(c="right(regexp_extract(c, '[^。；;!？，,：:]*$'), 30)")}))) AS neg FROM y)
SELECT field, term, CASE WHEN field IN ('symptoms', 'diseases', 'patternList', 'causeList') AND length(term) < 2 THEN 'single' WHEN field <> 'herbs' AND neg THEN 'negated'
  WHEN field = 'symptoms' AND (regexp_matches(term, '\d') OR regexp_matches(term, '(为主|消失|好转|达全身)$') OR term IN ('反复发作', '反复出现', '无明显异常', '无特殊') OR regexp_matches(term, '^{_CJ}{{1,3}}(可|正常)$')) THEN 'noise'
  WHEN field = 'herbs' AND NOT regexp_matches(term, '^{_CJ}{{2,5}}$') THEN 'no herb' WHEN field = 'symptoms' AND (regexp_matches(term, '{"|".join(extraction.MISTYPE_MARKERS)}') OR regexp_matches(term, '^({"|".join(extraction.PROCESS_LEAD)})')) THEN 'mistyped'
  WHEN field = 'formulaList' AND starts_with(term, '中草药') THEN 'fragment' END AS reason, count(*) AS n FROM z GROUP BY 1, 2, 3""",
    "merged_spans": """WITH s AS (SELECT l_orderkey AS id, l_returnflag AS label, l_partkey % 50 AS begin, l_partkey % 50 + 5 + l_linenumber AS "end", (l_suppkey % 8) / 8.0::DOUBLE AS score FROM lineitem),
b AS (SELECT *, max("end") OVER (PARTITION BY id, label ORDER BY begin, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR begin >= prev THEN 1 ELSE 0 END) OVER (PARTITION BY id, label ORDER BY begin, "end" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b)
SELECT id, label, min(begin) AS begin, max("end") AS "end", floor(avg(score) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM i GROUP BY id, label, island""",
    "fuzzy_normalize": f"WITH {_WORDS}, {_judge('terms', 'j')} SELECT * FROM j",
    "dictionary_impact": f"""WITH {_WORDS}, few AS (SELECT * FROM terms WHERE standard_term < 'm'), {_judge('few', 'a')}, {_judge('terms', 'b')}
SELECT CASE WHEN a.standard_term IS NULL AND b.standard_term IS NOT NULL THEN 'gained' WHEN b.standard_term IS NULL AND a.standard_term IS NOT NULL THEN 'lost' WHEN a.standard_term <> b.standard_term THEN 'changed' ELSE 'same' END AS change,
  a.level AS old_level, b.level AS new_level, coalesce(2 * length(b.standard_term) < length(input), FALSE) AS suspect, count(*) AS n FROM a JOIN b USING (input) GROUP BY 1, 2, 3, 4""",
    "normalized_lists": f"""WITH {_WORDS.replace('SELECT DISTINCT unnest([w, left', 'SELECT unnest([w, left')}, {_judge('terms', 'j').replace('FROM inputs', 'FROM (SELECT DISTINCT input FROM inputs)').replace('FROM (SELECT DISTINCT input FROM inputs) LEFT', 'FROM inputs LEFT')}
SELECT input AS content, coalesce(standard_term, input) AS term, level FROM j WHERE NOT (starts_with(input, 'w') AND level = 2)""",
    "normalize_covered": """WITH names AS (SELECT DISTINCT p_name AS w FROM part), x AS (SELECT w AS input, w FROM names UNION ALL SELECT w || ' ', w FROM names)
SELECT input, array_to_string(list_filter(string_split(w, ' '), lambda s: s <> ''), ',') AS parts FROM x""",
    "normalize_stripped": f"""WITH {_WORDS}, b AS (SELECT input, 0 AS k, regexp_replace(regexp_replace(input, '^no ', ''), 's$', '') AS word FROM inputs UNION ALL SELECT input, 1, regexp_replace(input, '^no ', '') FROM inputs UNION ALL SELECT input, 2, regexp_replace(input, 's$', '') FROM inputs)
SELECT input, standard_term FROM b JOIN terms ON word = standard_term OR word = alias WHERE word <> input AND NOT contains(input, 'q') QUALIFY row_number() OVER (PARTITION BY input ORDER BY k, word <> standard_term, standard_term) = 1""",
    "reroute_types": f"""WITH {_M}, {_ALL}, x AS (SELECT kind AS type, term AS content, CASE WHEN kind = 'symptom' AND term IN ('脉细数', '尺沉') THEN 'pulse' WHEN kind = 'symptom' AND term = '舌下瘀点' THEN 'tongue' ELSE kind END AS dest FROM all_ents WHERE term IS NOT NULL)
SELECT dest AS type, content, dest <> type AS moved, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "without_fragments": f"""WITH {_M}, {_ALL}, x AS (SELECT kind AS type, CASE WHEN kind = 'herb' THEN left(term, 1) ELSE left(term, 2) END AS content FROM all_ents WHERE term IS NOT NULL)
SELECT type, content, count(*) AS n FROM x WHERE length(content) > 1 OR (type = 'herb' AND content < 'm') GROUP BY 1, 2""",
    "herb_normalize": f"""WITH {_M}, {_ALL}, {_WORDS.replace('inputs AS (SELECT DISTINCT unnest([w, left(w, length(w) - 1), w ||', "inputs AS (SELECT DISTINCT term || 's' AS input FROM all_ents WHERE kind = 'herb' AND term IS NOT NULL), unused AS (SELECT DISTINCT unnest([w, left(w, length(w) - 1), w ||")}, {_judge('terms', 'j')}
SELECT coalesce(standard_term, input) AS name, CASE WHEN NOT plain THEN lower(trim(dosage)) END AS dosage, level, count(*) AS n FROM all_ents JOIN j ON input = term || 's' WHERE kind = 'herb' AND term IS NOT NULL GROUP BY 1, 2, 3""",
    "backfill": f"""WITH {_R}, {_M}, {_ALL}, {_C}, e AS (SELECT id, term AS content, norm_level AS level FROM all_ents WHERE kind = 'herb' AND term IS NOT NULL), done AS (SELECT id FROM e GROUP BY 1 HAVING bool_and(coalesce(level, 0) > 0)),
f AS (SELECT id, w AS content, 1 AS level FROM charts, (SELECT unnest(['苍术', '黄柏', '当归']) AS w) WHERE contains(concat_ws(' ', prescription, chief_complaint), w) AND concat_ws(' ', prescription, chief_complaint) <> w AND id NOT IN (SELECT id FROM done))
SELECT content, level, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM f WHERE (id, content) NOT IN (SELECT id, content FROM e)) GROUP BY 1, 2""",
    "suggestion_text": f"""WITH {_WORDS}, c AS (SELECT input, standard_term, unnest(list_distinct(string_split(input, ''))) AS ch FROM inputs, terms),
o AS (SELECT input, standard_term, sum(least(length(input) - length(replace(input, ch, '')), length(standard_term) - length(replace(standard_term, ch, '')))) AS overlap FROM c GROUP BY 1, 2),
r AS (SELECT input, standard_term, row_number() OVER (PARTITION BY input ORDER BY overlap DESC, standard_term) AS rn FROM o WHERE overlap >= 2 QUALIFY rn <= 3)
SELECT input, input || '：' || string_agg(standard_term, '、' ORDER BY rn) AS text FROM r GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in (*ORACLE, "text_windows")}
