"""Queries over decomposed terms and documents written back, with DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import archive, chain, decompose, documents
from lodestrata.operators import entities as ent
from lodestrata.operators.lineage import cut
from lodestrata.plans import lifecycle, views
from lodestrata.plans.lifecycle import _ACT
from lodestrata.plans.rules import _PT
from lodestrata.plans.structured import _ALL, _C, _M, _R

TYPES = ("disease", "pattern", "symptom", "herb", "formula", "tongue", "pulse")
#: A small dictionary for the charts' words: some are terms, some aliases, some contain one or resemble one, the rest are missed.
TERMS = (
    ("pattern", "气虚", "气虚证"), ("pattern", "血瘀", "瘀血"), ("pattern", "湿热证", "湿热"), ("symptom", "头痛", "头疼"), ("symptom", "咳", "咳嗽"), ("symptom", "压痛", "压疼"), ("symptom", "关节疼", "关节痛"),
    ("symptom", "失眠", "不寐"), ("symptom", "气喘", "喘"), ("tongue", "淡红", "舌淡"), ("tongue", "薄白苔", "苔薄白"), ("tongue", "齿痕", "齿印"), ("pulse", "左关", ""), ("pulse", "脉弦", "弦脉"), ("pulse", "脉细", "细脉"), ("pulse", "脉滑", "滑脉"), ("pulse", "脉数", "数脉"),
)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of parts as diseases, herbs and formulas, and the small dictionary."""
    names = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("standard_term")).distinct()
    parts = names.select(F.explode(F.array(*map(F.lit, ("disease", "herb", "formula")))).alias("type"), "standard_term", F.array(F.replace("standard_term", F.lit(" "), F.lit("-"))).alias("aliases"))
    few = spark.createDataFrame([(k, t, [a] if a else []) for k, t, a in TERMS], "type string, standard_term string, aliases array<string>")
    return parts.unionByName(few)


def normalize_min_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All longer words of the documents' texts that short ones cover, and by how many at least."""
    words = views.table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    rows = words.select(F.lit("w").alias("type"), F.col("w").alias("input"))
    terms = words.where(F.length("w").between(2, 4)).select(F.lit("w").alias("type"), F.col("w").alias("standard_term"), F.array().cast("array<string>").alias("aliases"))
    text = F.col("input")
    placed = decompose.placed_words(rows.where(F.length("input") > 4).withColumn("text", text), decompose.surfaces(terms))
    own = placed.groupBy("input").agg(F.collect_list(F.struct("at", "n", "standard_term")).alias("words"))
    best = own.select("input", decompose.cover(text, F.col("words"), F.lit("")).alias("c")).where("c is not null")
    return best.select("input", F.size("c.parts").cast("long").alias("n"), (F.array_join("c.parts", "") == text).alias("whole"))


def _composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term of the charts' lists, and each with the next one of its list behind it."""
    rows = ent.exploded(views.charts(spark, sf_dir)).where("term is not null").select("id", F.col("kind").alias("type"), "pos", "term")
    after = F.lead(F.struct("pos", "term")).over(Window.partitionBy("id", "type").orderBy("pos"))
    both = rows.withColumn("after", after).select("type", "term", F.when(F.col("after.pos") == F.col("pos") + 1, F.col("after.term")).otherwise("").alias("next")).distinct()
    return both.select("type", F.explode(F.array("term", F.concat("term", "next"))).alias("input")).distinct()


def decomposed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What composite terms of the charts fall into; tested by brute force."""
    return decompose.decomposed(_composites(spark, sf_dir), _terms(spark, sf_dir)).select("type", "input", F.array_join("parts", ",").alias("parts"))


def normalize_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charts' lists normalised end to end, composite terms taken apart; tested by brute force."""
    rows = ent.exploded(views.charts(spark, sf_dir)).select("id", "field", F.col("kind").alias("type"), "pos", F.col("term").alias("content"), "source_text", "norm_level")
    return decompose.normalized_lists(cut(rows), _terms(spark, sf_dir), TYPES).drop("best_pos")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of records that cleaning normalises, written and read again: their elements in order, and their marks."""
    rows = lifecycle._actions(spark, sf_dir)
    out = documents.normalized_documents(rows, _terms(spark, sf_dir), TYPES, "v9", "2026-01-01", 7, F.col("action") == "normalized")
    done = ent.exploded(out.where("action = 'normalized'").withColumn("version", F.get_json_object("structured_data", "$._meta.dictVersion")), keep=("version",))
    return done.select("id", "field", "pos", "term", "source_text", "norm_level", "dosage", "plain", "version")


def reroute_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with misplaced elements moved, written and read again: their elements in order."""
    out = documents.rerouted_documents(views.charts(spark, sf_dir))
    return ent.exploded(out, keep=("changed",)).select("id", "field", "pos", "term", "norm_level", "changed")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven versions of each type's terms: a part is in those that its size doesn't rule out."""
    rows = views.table(spark, sf_dir, "part").select("p_type", "p_name", "p_brand", "p_size", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).where((F.col("p_size") + F.col("k")) % 5 != 0)
    out = rows.groupBy(F.lit("").alias("org_id"), F.col("p_type").alias("type"), F.col("k").cast("long").alias("version_no"), F.col("p_name").alias("standard_term"))
    return out.agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))


def dict_archive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven versions of the dictionary as intervals."""
    return archive.history(_snapshots(spark, sf_dir)).select("type", "standard_term", F.array_join("aliases", ",").alias("aliases"), "begin_no", "end_no")


def dict_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest versions of each type, read from the intervals."""
    rows = _snapshots(spark, sf_dir)
    versions = rows.select("org_id", "type", "version_no").distinct()
    store = archive.pruned(archive.history(rows), versions)
    return archive.as_of(store, versions).select("type", "version_no", "standard_term", F.array_join("aliases", ",").alias("aliases"))


def fragment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why entities of the charts' lists are no entities, among those without a level."""
    rows = ent.exploded(views.charts(spark, sf_dir)).select("id", F.col("kind").alias("type"), F.col("term").alias("content"), "source_text", "norm_level")
    return chain.dropped_fragments(rows).groupBy("type", "content", "reason").agg(F.count("*").alias("n"))


def placed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that the charts' entities move to, by the small dictionary and what it makes up."""
    rows = ent.exploded(views.charts(spark, sf_dir)).select("id", "field", F.col("kind").alias("type"), "pos", F.col("term").alias("content"), "source_text", "norm_level")
    return chain.placed(cut(rows), _terms(spark, sf_dir)).groupBy("field", "type", "content", "source_text", "moved").agg(F.count("*").alias("n"))


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charts' lists through the whole chain, with terms from their raw columns; tested by cases."""
    charts = views.charts(spark, sf_dir)
    rows = ent.exploded(charts).select("id", "field", F.col("kind").alias("type"), "pos", F.col("term").alias("content"), "source_text", "norm_level")
    columns = {"herb": "prescription", "disease": "tcm_diagnosis", "pattern": "pattern"}
    raw = charts.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).alias("text")) for k, c in columns.items()))).alias("r")).select("id", "r.type", "r.text")
    return chain.normalized_records(rows, raw, _terms(spark, sf_dir), TYPES)


_SNAPSHOTS = """snap AS (SELECT p_type AS type, k AS version_no, p_name AS standard_term, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS aliases
  FROM part, range(1, 8) AS versions(k) WHERE (p_size + k) % 5 <> 0 GROUP BY 1, 2, 3)"""
_TERMS_SQL = f"""terms AS (SELECT DISTINCT unnest(['disease', 'herb', 'formula']) AS type, p_name AS standard_term, replace(p_name, ' ', '-') AS alias FROM part
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{k}', '{t}', '{a}')" for k, t, a in TERMS)}))"""
_DICE = "len(list_intersect(a, b)) * 2.0::DOUBLE / (len(a) + len(b))"
_JUDGED = f"""inputs AS (SELECT DISTINCT kind AS type, raw AS input FROM live WHERE kind IN {TYPES}),
exact AS (SELECT i.type, input, standard_term, 1 AS level, CASE WHEN input = standard_term THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS o FROM inputs i JOIN terms t ON t.type = i.type AND (input = standard_term OR input = nullif(alias, ''))),
near AS (SELECT i.type, input, standard_term, list_distinct(string_split(input, '')) AS a, list_distinct(string_split(standard_term, '')) AS b,
    (contains(input, standard_term) AND length(input) - length(standard_term) <= 1) OR (length(alias) >= 2 AND contains(input, alias) AND length(input) - length(alias) <= 1) AS inside
  FROM inputs i JOIN terms t ON t.type = i.type WHERE length(input) >= 2),
far AS (SELECT type, input, standard_term, CASE WHEN inside THEN 2 WHEN NOT contains(input, standard_term) AND NOT contains(standard_term, input) AND {_DICE} >= 0.8 THEN 3 END AS level, CASE WHEN inside THEN 0.0::DOUBLE ELSE -({_DICE}) END AS o FROM near),
judged AS (SELECT type, input, standard_term, level FROM (SELECT * FROM exact UNION ALL SELECT * FROM far WHERE level IS NOT NULL AND (type, input) NOT IN (SELECT (type, input) FROM exact))
  QUALIFY row_number() OVER (PARTITION BY type, input ORDER BY level, o, length(standard_term), standard_term) = 1)"""
_NO = "(regexp_matches(raw, '[无不未莫非缺寡忌禁欠]') OR regexp_matches(raw, '^[^已]*已(愈|好|干净|退|消|止|解|除|去)'))"



def _holds(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _begins(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with(t, '{w}')" for w in words) + ")"


ORACLE: dict[str, str] = {
    "normalize_min_cover": """WITH RECURSIVE words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), few AS (SELECT w FROM words WHERE length(w) BETWEEN 2 AND 4),
reached AS (SELECT w AS input, 1 AS p, 0 AS n FROM words WHERE length(w) > 4 UNION SELECT input, p + k, n + 1 FROM reached, (VALUES (2), (3), (4)) AS sizes(k) WHERE p + k <= length(input) + 1 AND substr(input, p, k) IN (SELECT w FROM few))
SELECT input, CAST(min(n) AS BIGINT) AS n, TRUE AS whole FROM reached WHERE p = length(input) + 1 GROUP BY input""",
    "dict_archive_terms": f"""WITH {_SNAPSHOTS}, r AS (SELECT *, version_no - row_number() OVER (PARTITION BY type, standard_term, aliases ORDER BY version_no) AS run, max(version_no) OVER (PARTITION BY type) AS last FROM snap)
SELECT type, standard_term, aliases, min(version_no) AS begin_no, CASE WHEN max(version_no) < any_value(last) THEN max(version_no) + 1 END AS end_no FROM r GROUP BY type, standard_term, aliases, run""",
    "dict_as_of": f"""WITH {_SNAPSHOTS}, v AS (SELECT DISTINCT type, version_no FROM snap), k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY type ORDER BY version_no DESC) <= 5)
SELECT type, version_no, standard_term, aliases FROM snap JOIN k USING (type, version_no)""",
    "fragment_reasons": rf"""WITH {_M}, {_ALL}, x AS (SELECT kind AS type, term AS content, norm_level, coalesce(term, trim(source_text)) AS t FROM all_ents),
r AS (SELECT type, content, CASE WHEN norm_level IS NOT NULL OR t IS NULL THEN NULL WHEN regexp_matches(t, '[\s（）()\[\]【】“”"''、，。；;：]') THEN 'punctuation' WHEN t IN {chain.CHANNELS} THEN 'channel'
  WHEN {_holds(chain.PULSE_MANUAL)} THEN 'pulse technique' WHEN {_holds(chain.TONGUE_ELEMENT)} THEN 'tongue element' WHEN {_begins(chain.PROCESS_LEAD)} THEN 'course'
  WHEN type = 'symptom' AND (t IN {chain.BARE} OR regexp_matches(t, '{chain.DESCRIPTION}')) THEN 'description' WHEN type = 'disease' AND regexp_matches(t, '{chain.SEVERITY}') THEN 'severity'
  WHEN type = 'tongue' AND t IN {chain.TONGUE_BARE} THEN 'bare tongue' WHEN type = 'formula' AND regexp_matches(t, '{chain.FORMULA_FRAGMENT}') THEN 'formula fragment' WHEN type = 'herb' AND {_holds(chain.NON_HERB)} THEN 'no herb' END AS reason FROM x)
SELECT type, content, reason, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "clean_documents": f"""WITH {_R}, {_M}, {_ALL}, {_C}, {_ACT.replace('{skip}', 'FALSE')}, {_TERMS_SQL},
e AS (SELECT a.id, a.kind, a.field, a.place, a.plain, a.norm_level, a.dosage, a.term, trim(a.source_text) AS source_text, coalesce(trim(a.source_text), a.term) AS raw FROM all_ents a JOIN acted USING (id) WHERE action = 'normalized'),
live AS (SELECT * FROM e WHERE NOT plain), {_JUDGED},
met AS (SELECT l.*, j.level IS NOT NULL AND NOT ({_NO} AND j.level = 2) AS hit, standard_term, j.level FROM live l LEFT JOIN judged j ON j.type = l.kind AND j.input = l.raw),
made AS (SELECT *, CASE WHEN hit THEN standard_term ELSE raw END AS new_term, CASE WHEN hit THEN level END AS new_level FROM met),
once AS (SELECT *, min(place) OVER (PARTITION BY id, field, new_term) AS first_place FROM made
  QUALIFY row_number() OVER (PARTITION BY id, field, new_term ORDER BY length(raw) DESC, coalesce(new_level, 4), place) = 1),
whole AS (SELECT id, field, first_place AS spot, new_term AS term, raw AS source_text, new_level AS norm_level, CASE WHEN kind = 'herb' THEN lower(trim(dosage)) END AS dosage, FALSE AS plain FROM once
  UNION ALL SELECT id, field, place, term, NULL, NULL, NULL, TRUE FROM e WHERE plain)
SELECT id, field, CAST(row_number() OVER (PARTITION BY id, field ORDER BY spot) - 1 AS INTEGER) AS pos, term, source_text, norm_level, dosage, plain, 'v9' AS version FROM whole""",
    "reroute_documents": f"""WITH {_R}, {_M}, {_ALL}, e AS (SELECT id, field, place, term AS shown, norm_level, plain, CASE WHEN NOT plain THEN coalesce(term, trim(source_text)) END AS term FROM all_ents),
m AS (SELECT *, coalesce(CASE WHEN field = 'symptoms' AND {_PT} THEN CASE WHEN regexp_matches(regexp_replace(term, '^[左右双两]', ''), '^[舌尖根苔]') THEN 'tongueList' ELSE 'pulseList' END
  WHEN field = 'tongueList' AND starts_with(term, '苔藓') THEN 'symptoms' END, field) AS dest FROM e),
k AS (SELECT *, bool_or(dest <> field) OVER (PARTITION BY id) AS changed, row_number() OVER (PARTITION BY id, dest, term ORDER BY dest <> field, place) AS rn FROM m),
kept AS (SELECT * FROM k WHERE dest = field OR rn = 1)
SELECT id, dest AS field, CAST(row_number() OVER (PARTITION BY id, dest ORDER BY dest <> field, place) - 1 AS INTEGER) AS pos, shown AS term, norm_level, changed FROM kept""",
}
QUERIES = {f.__name__: f for f in (normalize_min_cover, decomposed_terms, normalize_chain, clean_documents, reroute_documents, dict_archive_terms, dict_as_of, fragment_reasons, placed_entities, normalized_records)}
