"""The standardization report: coverage, why terms are unmatched, rates, scores and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import digits_template, month_of
from lodestrata.schema import UNKNOWN_MONTH

# Words that tell why a symptom has no dictionary entry.
PHYSICAL_SIGN = ("压痛", "触痛", "叩痛", "反跳痛")
MISROUTED_PREFIX = ("脉", "舌", "尺", "寸", "关", "尖", "根", "苔")
MISROUTED_EXCLUDE = ("关节", "尺肤", "苔藓", "尖锐", "脉下")
MISROUTED_QUALIFIER = ("左", "右", "双", "两")
INQUIRY_LEAD = ("大便", "小便", "二便", "排便", "夜寐", "睡眠", "入睡", "饮食", "食欲", "饮水", "食量", "纳食", "胃口", "精神", "面色", "乏力", "倦怠", "困倦", "晨起", "晨间", "清晨", "夜间", "夜里", "睡前", "醒后", "饭后", "食后", "平素", "喜")
INQUIRY_MARKERS = ("饮水", "饮食", "精力", "体力", "控制", "习惯性")
PROCESS_LEAD = ("活动后", "活动时", "活动则", "休息后", "休息时", "劳累后", "劳累时", "劳则", "遇劳", "遇冷", "遇热", "遇风", "受凉后", "受寒后", "受风后", "进食后", "进餐后", "服药后", "饮水后", "大便后", "小便后", "持续性", "反复发作", "阵发性", "间歇性", "夜间明显", "晨起明显", "午后", "加重", "减轻", "缓解", "好转", "自行缓解")
MISTYPE_MARKERS = ("不受按", "中取", "浮取", "沉取", "应指", "红点", "瘀点", "齿痕", "裂纹", "舌下", "边有")
QUALIFIER_CHARS = "偏略较尚欠"
FRAGMENT_LENGTH, CAPPED_SCORE, CAPPED_POINTS = 2, 10, 5
CJK = "^[一-鿿]+$"


def starts_with(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(f"^({'|'.join(words)})")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def misrouted(c: Column) -> Column:
    """A pulse or tongue element among the symptoms, with at most one word of side or number before it."""
    core = F.regexp_replace(c, f"^({'|'.join(MISROUTED_QUALIFIER)})", "")
    return starts_with(core, MISROUTED_PREFIX) & ~starts_with(c, MISROUTED_EXCLUDE) & ~starts_with(core, MISROUTED_EXCLUDE) & c.rlike(CJK)


def unmatched_class(c: Column) -> Column:
    """The first of seven classes that a term without a level belongs to."""
    return (
        F.when(contains_any(c, PHYSICAL_SIGN), "physicalSign")
        .when(misrouted(c), "misrouted")
        .when(contains_any(c, MISTYPE_MARKERS), "mistypeMarker")
        .when(starts_with(c, INQUIRY_LEAD) | contains_any(c, INQUIRY_MARKERS), "inquiryFragment")
        .when(starts_with(c, PROCESS_LEAD), "processDesc")
        .when(F.length(c) <= FRAGMENT_LENGTH, "fragment")
        .otherwise("dictionaryGap")
    )


def standard_looking(c: Column) -> Column:
    return (F.length(c) < 4) | ~c.rlike(f"[{QUALIFIER_CHARS}]")


def classified_symptoms(entities: DataFrame) -> DataFrame:
    """term and class of symptom objects: "inferred" for levels 2 and 3, "matched" for others with a level, else why it has none."""
    rows = entities.where("kind = 'symptom' and not plain").withColumn("term", F.coalesce("term", "source_text")).where("term is not null")
    level = F.col("norm_level")
    return rows.select("id", "term", F.when(level.isin(2, 3), "inferred").when(level.isNotNull(), "matched").otherwise(unmatched_class(F.col("term"))).alias("class"))


def unmatched_counts(classified: DataFrame) -> DataFrame:
    """Terms in each class of the unmatched; the counts sum to all of them."""
    return classified.where(~F.col("class").isin("inferred", "matched")).groupBy("class").agg(F.count("*").alias("n"))


def unmatched_top(classified: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent terms of each class, inferred ones too; gaps only where they look like standard terms. Ties by term."""
    rows = classified.where((F.col("class") != "matched") & ((F.col("class") != "dictionaryGap") | standard_looking(F.col("term"))))
    counts = rows.groupBy("class", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), F.asc("term")))).where(F.col("rn") <= top)


def normalizable_rate(classified: DataFrame) -> DataFrame:
    """Matched or inferred symptoms over those that a dictionary could meet: five defect classes are left out, fragments stay."""
    met = F.col("class").isin("inferred", "matched")
    able = met | F.col("class").isin("fragment", "dictionaryGap")
    return classified.agg(F.count_if(met).alias("normalized"), F.count_if(able).alias("normalizable"))


def coverage_by_type(entities: DataFrame, dictionary_counts: DataFrame) -> DataFrame:
    """By kind: entities, those with a level of 1 to 3, dictionary terms (kind, terms), and whether the entries look out of date."""
    n = entities.where("term is not null").groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("norm_level").between(1, 3)).alias("normalized"))
    both = n.join(dictionary_counts, "kind", "left").select("kind", "total", "normalized", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    return both.withColumn("stale", (F.col("terms") > 0) & (F.col("total") >= 10) & (F.col("normalized") == 0))


def score_report(records: DataFrame, deductions: DataFrame, kind: str = "术语未标准化") -> DataFrame:
    """Scored records, lowest, highest and mean score (one decimal), and records with a deduction of the kind of CAPPED_POINTS or more.

    deductions: id, type, points. A true score of 0 counts as the lowest.
    """
    capped = deductions.where((F.col("type") == kind) & (F.col("points") >= CAPPED_POINTS)).select("id").distinct()
    rows = records.where("score is not null").join(capped.withColumn("capped", F.lit(True)), "id", "left")
    mean = F.floor(F.avg("score") * F.lit(10.0) + F.lit(0.5)).cast("double") / F.lit(10.0)
    return rows.agg(F.count("*").alias("total"), F.min("score").alias("lowest"), F.max("score").alias("highest"), mean.alias("average"), F.count("capped").alias("capped"))


def qc_coverage(records: DataFrame) -> DataFrame:
    """Among graded records (grade, score, qc_score, qc_time): those whose stored result has their score, and the latest of its times."""
    same = F.col("qc_score").eqNullSafe(F.col("score")) & F.col("score").isNotNull()
    graded = records.where("grade is not null")
    return graded.agg(F.count("*").alias("graded"), F.count_if(same).alias("scored"), F.max(F.when(same, F.col("qc_time"))).alias("last_scored")).withColumn("complete", F.col("graded") == F.col("scored"))


def dataset_shape(records: DataFrame, classified: DataFrame) -> DataFrame:
    """Records, different chief complaints up to their numbers, and records with a gap that doesn't look like a standard term."""
    loose = classified.where((F.col("class") == "dictionaryGap") & ~standard_looking(F.col("term"))).agg(F.count_distinct("id").alias("colloquial"))
    return records.agg(F.count("*").alias("n"), F.count_distinct(digits_template(F.col("chief_complaint"))).alias("templates")).crossJoin(loose)  # one row each


def monthly(records: DataFrame, classified: DataFrame) -> DataFrame:
    """By month, latest first and unknown last: symptom rate as text, mean score, capped records (score up to CAPPED_SCORE), dictionary gaps."""
    month = F.coalesce(month_of("visit_time"), F.lit(UNKNOWN_MONTH)).alias("month")
    met = F.col("class").isin("inferred", "matched")
    by_record = classified.groupBy("id").agg(F.count("*").alias("total"), F.count_if(met).alias("met"), F.count_if(F.col("class") == "dictionaryGap").alias("gaps"))
    rows = records.join(by_record, "id", "left").groupBy(month).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        F.sum("score").alias("points"), F.count("score").alias("scored"), F.count_if(F.col("score") <= CAPPED_SCORE).alias("capped"),
    )
    share = F.floor(F.col("met").cast("double") * F.lit(1000.0) / F.col("total") + F.lit(0.5)).cast("long")
    rate = F.when(F.col("total") > 0, F.concat((share / 10).cast("long").cast("string"), F.lit("."), (share % 10).cast("string"), F.lit("%"))).otherwise(F.lit("0.0%"))
    mean = F.when(F.col("scored") > 0, F.floor(F.col("points").cast("double") * F.lit(10.0) / F.col("scored") + F.lit(0.5)).cast("double") / F.lit(10.0))
    return rows.select("month", rate.alias("symptom_rate"), mean.alias("average"), "capped", "gaps").orderBy((F.col("month") == UNKNOWN_MONTH).asc(), F.desc("month"))


def range_summary(records: DataFrame, picked: Column) -> DataFrame:
    """Records that a range picks and leaves out, in one pass."""
    hit = F.coalesce(picked, F.lit(False))
    return records.agg(F.count_if(hit).alias("picked"), F.count_if(~hit).alias("excluded"))
