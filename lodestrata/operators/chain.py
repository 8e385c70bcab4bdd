"""All steps that a record's extracted lists go through, in order: misplaced entities, cut-off ones, terms, fragments, what the raw text adds.

Entities are rows (id, field, type, pos, content, source_text, norm_level); terms are (type, standard_term, aliases).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null
from lodestrata.operators.decompose import decomposed, normalized_lists, surfaces
from lodestrata.operators.entities import FIELDS
from lodestrata.operators.extraction import CHANNELS, NON_HERB
from lodestrata.operators.lineage import cut
from lodestrata.operators.normalize import _bounded, scan, without_fragments
from lodestrata.operators.report import PROCESS_LEAD, contains_any, starts_with

# Shapes and words of what is no entity.
BARE = ("大便", "小便", "二便", "食欲", "食量", "疼痛", "口气", "扁桃体", "血块", "月经", "睡眠", "精神", "体力", "饮食", "饮水", "舌", "苔", "脉", "色", "量")
TONGUE_BARE = ("舌质", "舌下", "舌尖", "舌体", "舌面", "苔", "根部", "边界", "中根", "舌")
DESCRIPTION = r"^(色[\x{4e00}-\x{9fa5}]{1,3}|量(少|多|可|中等|一般|正常|偏少|偏多)|偏干|偏稀|偏硬|偏软|成形|成条|干结|尚可|正常|一般|晨起|清晨|夜间|夜里|晚上|平时|平素|近日|近期|偶尔|偶有|时有|经常|持续|反复|睡前|饭后|食后|经前|经期|经后|慢性|急性|亚急性|过敏性|原发性|继发性|轻度|中度|重度)$"
SEVERITY = r"^(慢性|急性|过敏性|原发性|继发性|轻度|中度|重度|亚急性)$"
PULSE_MANUAL, TONGUE_ELEMENT = ("不受按", "中取", "浮取", "沉取", "应指"), ("红点", "瘀点", "齿痕", "裂纹", "边有")
PUNCTUATION = r"[\s（）()\[\]【】“”\"'、，。；;：]"
FORMULA_FRAGMENT = r"^(中草药|中草|中草药处|草药|汤剂|颗粒剂|中成药)$"
LISTS = {k: f for f, k in FIELDS.items()}
#: Places of entities that come to a list from elsewhere, behind its own.
MOVED = 1 << 40


def fragment_reason(kind: Column, term: Column) -> Column:
    """Why a term without a level is no entity of its kind, by the first rule that says so; null: it is one."""
    return (
        F.when(term.rlike(PUNCTUATION), "punctuation")
        .when(term.isin(*CHANNELS), "channel")
        .when(contains_any(term, PULSE_MANUAL), "pulse technique")
        .when(contains_any(term, TONGUE_ELEMENT), "tongue element")
        .when(starts_with(term, PROCESS_LEAD), "course")
        .when((kind == "symptom") & (term.isin(*BARE) | term.rlike(DESCRIPTION)), "description")
        .when((kind == "disease") & term.rlike(SEVERITY), "severity")
        .when((kind == "tongue") & term.isin(*TONGUE_BARE), "bare tongue")
        .when((kind == "formula") & term.rlike(FORMULA_FRAGMENT), "formula fragment")
        .when((kind == "herb") & contains_any(term, NON_HERB), "no herb")
    )


def dropped_fragments(entities: DataFrame) -> DataFrame:
    """entities (type, content, source_text, norm_level) with reason; only those without a level get one, others are what they say they are."""
    term = F.coalesce(blank_to_null("content"), blank_to_null("source_text"))
    return entities.withColumn("reason", F.when(F.col("norm_level").isNull(), fragment_reason(F.col("type"), term)))


def placed(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """entities in the lists that they belong to, with `moved`; those that move come behind a list's own.

    A symptom that its dictionary doesn't know goes to the pulse, else to the tongue, if it is a term there or is made of
    terms. A disease that its dictionary doesn't know goes to causes, symptoms or patterns, the first that has it. An
    inquiry phrase that is a symptom's term or alias becomes a symptom.
    """
    rows = entities.withColumn("__term", F.when(F.col("type") == "inquiry", F.coalesce(blank_to_null("source_text"), blank_to_null("content"))).otherwise(F.coalesce(blank_to_null("content"), blank_to_null("source_text"))))
    tries = {"symptom": ("symptom", "pulse", "tongue"), "disease": ("disease", "cause", "symptom", "pattern"), "inquiry": ("symptom",)}
    wanted = cut(rows.where(F.col("type").isin(*tries) & F.col("__term").isNotNull()).select(F.col("type").alias("from"), F.col("__term").alias("input")).distinct())
    order = F.create_map(*(x for k, to in tries.items() for x in (F.lit(k), F.array(*map(F.lit, to)))))
    asked = wanted.select("from", "input", F.posexplode(order[F.col("from")]).alias("k", "type"))
    known = asked.join(_bounded(surfaces(terms).select("type", F.col("word").alias("input"))), ["type", "input"], "left_semi")
    made = decomposed(asked.where(F.col("type").isin("pulse", "tongue")).select("type", "input"), terms).select("type", "input")
    hit = known.unionByName(asked.join(made, ["type", "input"], "left_semi"))
    to = hit.groupBy("from", "input").agg(F.min(F.struct("k", "type"))["type"].alias("__to")).where(F.col("__to") != F.col("from"))
    both = rows.join(_bounded(to.withColumnsRenamed({"from": "type", "input": "__term"})), ["type", "__term"], "left")
    field = F.create_map(*(F.lit(x) for pair in LISTS.items() for x in pair))
    both = both.withColumn("moved", F.col("__to").isNotNull())
    both = both.withColumn("pos", F.col("pos").cast("long") + F.when(F.col("moved"), MOVED).otherwise(0)).withColumn("field", F.when(F.col("moved"), field[F.col("__to")]).otherwise(F.col("field")))
    return both.withColumn("type", F.coalesce("__to", "type")).drop("__term", "__to").select(*entities.columns, "moved")


def filled_in(entities: DataFrame, raw: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities with the terms that the raw texts (id, type, text) of their records hold, and the ids of records that got some.

    Only lists with an entity without a level, and empty ones, are looked into. An entity without a level that is part
    of a found term goes.
    """
    state = entities.groupBy("id", "type").agg(F.every(F.coalesce(F.col("norm_level").between(1, 3), F.lit(False))).alias("done"))
    texts = raw.where(blank_to_null("text").isNotNull()).join(state, ["id", "type"], "left").where(~F.coalesce("done", F.lit(False)))
    found = scan(texts.select(F.struct("id", F.col("type").alias("own")).alias("id"), "text"), terms).where(F.col("id.own") == F.col("type"))
    found = found.select("id.id", "type", "standard_term").distinct()
    hits = found.groupBy("id", "type").agg(F.array_sort(F.collect_set("standard_term")).alias("__hits"))
    part = F.exists(F.coalesce("__hits", F.array().cast("array<string>")), lambda h: h.contains(F.col("content")) & (h != F.col("content")))
    kept = entities.join(hits, ["id", "type"], "left").where(~(F.col("norm_level").isNull() & F.coalesce(part, F.lit(False)))).drop("__hits")
    field = F.create_map(*(F.lit(x) for pair in LISTS.items() for x in pair))
    new = hits.select("id", field[F.col("type")].alias("field"), "type", F.posexplode("__hits").alias("k", "content"))
    new = new.select("id", "field", "type", (F.col("k") + 2 * MOVED).alias("pos"), "content", F.col("content").alias("source_text"), F.lit(None).cast("int").alias("norm_level"))
    return kept.select(*new.columns).withColumn("pos", F.col("pos").cast("long")).unionByName(new), hits.select("id").distinct()


def normalized_records(entities: DataFrame, raw: DataFrame, terms: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The whole chain: id, field, type, at (place in the list, from 0), term, source_text, norm_level.

    placed(), single characters that no dictionary has, normalized_lists(), fragments, filled_in(); records that got
    terms from their raw text are normalised once more, which changes nothing in what is normalised already.
    """
    kinds = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))
    columns = ["id", "field", "type", "pos", "content", "source_text", "norm_level"]

    def normal(rows: DataFrame) -> DataFrame:
        out = normalized_lists(rows, terms, types)
        place = F.struct(F.col("pos").cast("long").alias("pos"), F.col("part").alias("part"))
        by_list = out.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "term", "source_text", "norm_level"))).alias("l"))
        flat = by_list.select("id", "field", F.posexplode("l").alias("at", "e"))
        done = flat.select("id", "field", F.coalesce(kinds[F.col("field")], F.lit("inquiry")).alias("type"), F.col("at").cast("long").alias("pos"), F.col("e.term").alias("content"), "e.source_text", "e.norm_level")
        return dropped_fragments(done).where("reason is null").select(*columns)

    terms = cut(terms.select("type", "standard_term", "aliases"))
    rows = cut(placed(cut(entities.select(*columns)), terms).select(*columns))
    first = cut(normal(without_fragments(rows.where(F.coalesce(blank_to_null("content"), blank_to_null("source_text")).isNotNull()).withColumn("content", F.coalesce(blank_to_null("content"), blank_to_null("source_text"))), terms).select(*columns)))
    full, touched = filled_in(first, raw, terms)
    full, touched = cut(full), cut(touched)
    again = normal(full.join(touched, "id", "left_semi"))
    out = again.unionByName(full.join(touched, "id", "left_anti"))
    return out.select("id", "field", "type", F.col("pos").alias("at"), F.col("content").alias("term"), "source_text", "norm_level")
