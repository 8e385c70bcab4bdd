"""Record, entity, dictionary and log tables as views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.schema import INVALID, PENDING, QUALIFIED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of a customer stands for a record of an organisation."""
    key = F.col("o_orderkey")
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    grade = F.when(F.col("o_orderstatus") == "F", QUALIFIED).when(F.col("o_orderstatus") == "O", PENDING).when(key % 2 == 0, INVALID)
    return joined.select(
        key.alias("id"),
        F.col("c_mktsegment").alias("org_id"),
        F.col("o_orderpriority").alias("department"),
        F.col("o_orderdate").alias("visit_time"),
        grade.alias("grade"),
        F.when(key % 17 != 0, (key % 101).cast("int")).alias("score"),
        (key % 3 == 0).alias("governed"),
    )


RECORDS_SQL = """records AS (
  SELECT o_orderkey AS id, c_mktsegment AS org_id, o_orderpriority AS department, o_orderdate AS visit_time,
    CASE WHEN o_orderstatus = 'F' THEN '合格' WHEN o_orderstatus = 'O' THEN '待复核' WHEN o_orderkey % 2 = 0 THEN '无效' END AS grade,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 101 AS INTEGER) END AS score, o_orderkey % 3 = 0 AS governed
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item's part stands for an entity of a record."""
    kind = F.when(F.col("l_returnflag") == "R", "disease").when(F.col("l_returnflag") == "A", "symptom").when(F.col("l_linestatus") == "F", "formula").otherwise("herb")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("record_id"), kind.alias("kind"), F.col("p_name").alias("content"), (F.col("l_linenumber") % 4).alias("norm_level"))


ENTITIES_SQL = """entities AS (
  SELECT l_orderkey AS record_id, CASE WHEN l_returnflag = 'R' THEN 'disease' WHEN l_returnflag = 'A' THEN 'symptom' WHEN l_linestatus = 'F' THEN 'formula' ELSE 'herb' END AS kind,
    p_name AS content, l_linenumber % 4 AS norm_level
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary terms in two layers: all parts are the base, those of every fifth size are an organisation's own too."""
    part = table(spark, sf_dir, "part")

    def layer(condition, org: str) -> DataFrame:
        rows = part.where(condition).groupBy(F.col("p_type").alias("type"), F.col("p_name").alias("standard_term"))
        return rows.agg(F.array_sort(F.collect_set("p_brand")).alias("aliases")).select(F.lit(org).alias("org_id"), "type", "standard_term", "aliases")

    return layer(F.lit(True), "").unionByName(layer(F.col("p_size") % 5 == 0, "org"))


DICTIONARY_SQL = """dictionary AS (
  SELECT '' AS org_id, p_type AS type, p_name AS standard_term, list_sort(list_distinct(list(p_brand))) AS aliases FROM part GROUP BY ALL
  UNION ALL
  SELECT 'org', p_type, p_name, list_sort(list_distinct(list(p_brand))) FROM part WHERE p_size % 5 = 0 GROUP BY ALL)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event stands for a line of the operation log."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", "ts", user.cast("string").alias("operator"), (user % 3).cast("string").alias("org_id"), F.col("event_type").alias("target"), F.col("props").alias("detail"))


LOGS_SQL = """logs AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS operator, CAST(user_id % 3 AS VARCHAR) AS org_id, event_type AS target, props AS detail FROM events)"""


def deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item stands for a deduction of a record's score."""
    item = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), item.alias("item"), F.col("l_quantity").cast("int").alias("points"))


DEDUCTIONS_SQL = """deductions AS (
  SELECT l_returnflag AS type, l_linestatus || CAST(l_linenumber AS VARCHAR) AS item, CAST(trunc(l_quantity) AS INTEGER) AS points FROM lineitem)"""


# Words of the made-up charts below: sentences and terms that take every branch of the text rules.
SYMPTOMS = ("压痛明显", "左关弦", "舌下瘀点", "大便干", "活动后气喘", "口干", "头痛三天", "食欲略差", "关节痛", "脉细数", "痛", "咳嗽", "胸闷", "尺沉", "偏头痛", "反复发作", "小便黄", "心悸", "失眠多梦", "腰痛明显", "乏力", "双下肢水肿", "苔藓样皮疹", "夜间明显")
PATTERNS = ("气虚证", "血瘀证", "湿热证", "肝郁证")
TONGUES = ("舌淡红", "苔薄白", "边有齿痕", "舌红")
PULSES = ("脉细", "脉弦滑", "脉浮", "尺沉")
CAUSES = ("风寒", "湿热")
KINDS = ("disease", "pattern", "symptom", "herb", "formula", "tongue", "pulse", "cause")
FIELDS = ("diseases", "patternList", "symptoms", "herbs", "formulaList", "tongueList", "pulseList", "causeList")
SENTENCES = (
    "舌质淡胖，边有齿痕，苔白腻。脉细数，左尺无力。",
    "患者反酸，无腹痛，食欲不振。治以健脾益气。",
    "炒苍术10g,黄柏10g，检查蛋白15g。关节痛，尺沉。",
    "因风寒外感，咳嗽三天；无发热、头痛。舌红少苔，或有裂纹。",
    "苔藓样皮疹，脉弦。寸略旺，右关尤甚。电话13812345678",
    "大便干 ,  小便黄..夜寐可。治法疏肝,当归12g",
    "",
)


def _pick(words: tuple[str, ...], at):
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))


def _sql_pick(words: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][{at} % {len(words)} + 1]"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item stands for an entity of a record's structured document, before it is written as one."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    slot = (F.col("l_partkey") + F.col("l_linenumber")) % 8
    words = {1: PATTERNS, 2: SYMPTOMS, 5: TONGUES, 6: PULSES, 7: CAUSES}
    term = F.col("p_name")
    for k, w in words.items():
        term = F.when(slot == k, _pick(w, F.col("l_partkey"))).otherwise(term)
    form = F.col("l_suppkey") % 7
    level = F.when((F.col("l_partkey") % 3 != 0) & (form != 0), (F.col("l_linenumber") % 4).cast("int"))
    return line.select(
        F.col("l_orderkey").alias("record_id"),
        _pick(KINDS, slot).alias("kind"),
        _pick(FIELDS, slot).alias("field"),
        term.alias("term"),
        form.alias("form"),
        level.alias("norm_level"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("G ")).alias("dosage"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("place"),
    )


MENTIONS_SQL = f"""mentions AS (
  SELECT l_orderkey AS record_id, {_sql_pick(KINDS, '((l_partkey + l_linenumber) % 8)')} AS kind, {_sql_pick(FIELDS, '((l_partkey + l_linenumber) % 8)')} AS field,
    CASE (l_partkey + l_linenumber) % 8 WHEN 1 THEN {_sql_pick(PATTERNS, 'l_partkey')} WHEN 2 THEN {_sql_pick(SYMPTOMS, 'l_partkey')} WHEN 5 THEN {_sql_pick(TONGUES, 'l_partkey')}
      WHEN 6 THEN {_sql_pick(PULSES, 'l_partkey')} WHEN 7 THEN {_sql_pick(CAUSES, 'l_partkey')} ELSE p_name END AS term,
    l_suppkey % 7 AS form, CASE WHEN l_partkey % 3 <> 0 AND l_suppkey % 7 <> 0 THEN CAST(l_linenumber % 4 AS INTEGER) END AS norm_level,
    CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) || 'G ' AS dosage, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey % 19 <> 0 AND l_orderkey % 23 <> 0 AND l_orderkey % 29 <> 0 AND l_orderkey % 31 <> 0), ents AS (
  SELECT *, CASE WHEN form = 1 THEN '' ELSE term END AS content, CASE WHEN form <> 0 THEN term END AS source_text, form = 0 AS plain FROM mentions)"""


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a structured document (some missing, broken, empty or of another shape) and narrative columns."""
    m = mentions(spark, sf_dir)
    content = F.when(F.col("form") == 1, "").otherwise(F.col("term"))
    entity = F.to_json(F.struct(content.alias("content"), F.col("term").alias("sourceText"), F.col("norm_level").alias("normLevel")))
    herb = F.to_json(F.struct(content.alias("name"), "dosage", F.col("term").alias("sourceText"), F.col("norm_level").alias("normLevel")))
    element = F.when(F.col("form") == 0, F.concat(F.lit('"'), "term", F.lit('"'))).when(F.col("kind") == "herb", herb).otherwise(entity)
    # One row a record is gathered once; its lists are told apart in it, in the order of their names.
    whole = m.select("record_id", F.struct("field", "place", element.alias("element")).alias("e")).groupBy("record_id").agg(F.array_sort(F.collect_list("e")).alias("all"))
    meta = F.concat(F.lit('"_meta":{"dictVersion":"v1","manuallyEdited":'), F.when(F.col("record_id") % 10 == 0, "true").otherwise("false"), F.lit("}"))

    def part(f: str) -> Column:
        own = F.filter("all", lambda x: x["field"] == f)
        return F.when(F.exists("all", lambda x: x["field"] == f), F.concat(F.lit(f'"{f}":['), F.array_join(F.transform(own, lambda x: x["element"]), ","), F.lit("]")))

    lists = F.concat_ws(",", *map(part, sorted(FIELDS)))
    documents = whole.select(F.col("record_id").alias("id"), F.concat(F.lit("{"), lists, F.lit(","), meta, F.lit("}")).alias("whole"))
    key = F.col("id")
    odd = F.when(key % 19 == 0, F.lit(None)).when(key % 23 == 0, '{"symptoms": [').when(key % 29 == 0, "{}").when(key % 31 == 0, '{"symptoms":"none"}')
    rows = records(spark, sf_dir).join(documents, "id", "left").withColumn("structured_data", F.when((key % 19 == 0) | (key % 23 == 0) | (key % 29 == 0) | (key % 31 == 0), odd).otherwise(F.col("whole"))).drop("whole")
    blank = key % 13 == 0
    text = _pick(SENTENCES, key)
    return rows.select(
        "*",
        F.when(key % 5 == 0, "男").when(key % 5 == 1, " 女").when(key % 5 == 3, "未知的性别").when(key % 5 == 4, "其他").alias("gender"),
        F.when(key % 4 == 0, "34岁").when(key % 4 == 1, "3个月").when(key % 4 == 2, "多大").alias("age"),
        F.when(~blank, text).alias("chief_complaint"),
        F.when(~blank & (key % 3 == 0), "感冒").alias("tcm_diagnosis"),
        F.when(key % 7 == 0, "  ").alias("western_diagnosis"),
        F.when(key % 26 != 0, F.lit("")).alias("present_illness"),
        F.when(key % 11 == 0, "自述头痛").alias("self_report"),
        F.when(key % 6 == 0, "气虚证、血瘀证，湿热证").when(key % 6 == 1, " ").alias("pattern"),
        F.when(key % 8 == 0, "炒苍术10g,黄柏10g").when(key % 8 == 1, " 当归 ").alias("prescription"),
        F.when(key % 9 == 0, "舌淡").alias("tongue"),
        F.when(key % 10 == 0, "脉细").alias("pulse"),
        F.concat(F.lit("R"), (key % 977).cast("string")).alias("registration_no"),
    )


CHARTS_SQL = f"""charts AS (
  SELECT *, CASE id % 5 WHEN 0 THEN '男' WHEN 1 THEN ' 女' WHEN 3 THEN '未知的性别' WHEN 4 THEN '其他' END AS gender,
    CASE id % 4 WHEN 0 THEN '34岁' WHEN 1 THEN '3个月' WHEN 2 THEN '多大' END AS age, CASE WHEN id % 13 <> 0 THEN {_sql_pick(SENTENCES, 'id')} END AS chief_complaint,
    CASE WHEN id % 13 <> 0 AND id % 3 = 0 THEN '感冒' END AS tcm_diagnosis, CASE WHEN id % 7 = 0 THEN '  ' END AS western_diagnosis, CASE WHEN id % 26 <> 0 THEN '' END AS present_illness,
    CASE WHEN id % 11 = 0 THEN '自述头痛' END AS self_report, CASE id % 6 WHEN 0 THEN '气虚证、血瘀证，湿热证' WHEN 1 THEN ' ' END AS pattern,
    CASE id % 8 WHEN 0 THEN '炒苍术10g,黄柏10g' WHEN 1 THEN ' 当归 ' END AS prescription, CASE WHEN id % 9 = 0 THEN '舌淡' END AS tongue, CASE WHEN id % 10 = 0 THEN '脉细' END AS pulse,
    'R' || CAST(id % 977 AS VARCHAR) AS registration_no,
    id % 19 = 0 AS no_document, id % 19 <> 0 AND id % 23 = 0 AS bad_document
  FROM records)"""
