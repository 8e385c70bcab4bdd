"""Data-quality rules as data, compiled to column expressions: deductions, score, grade, status and review tasks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import add_workdays, blank_to_null
from lodestrata.operators.cleaning import first_of, later_copies
from lodestrata.schema import AGE_PATTERN, BY_KEY, GENDERS, INVALID, PENDING, QUALIFIED, STATUS


@dataclass(frozen=True)
class Element:
    name: str
    field: str
    fallback: tuple[str, ...] = ()
    full: int = 12
    partial: int = 6


@dataclass(frozen=True)
class Format:
    column: str
    label: str
    reason: str
    pattern: str | None = None
    values: tuple[str, ...] = ()
    weight: int = 5


@dataclass(frozen=True)
class Consistency:
    """Where a trigger list holds a trigger value, some entry of a non-empty expected list must hold an expected one."""

    name: str
    trigger: str
    trigger_values: tuple[str, ...]
    expect: str
    expect_values: tuple[str, ...]
    weight: int = 10


def _elements() -> tuple[Element, ...]:
    return tuple(Element(BY_KEY[k].label, BY_KEY[k].field, BY_KEY[k].fallback) for k in ("symptom", "disease", "pattern", "tongue", "pulse", "herb"))


@dataclass(frozen=True)
class RuleSet:
    elements: tuple[Element, ...] = field(default_factory=_elements)
    formats: tuple[Format, ...] = (Format("age", "年龄", "年龄格式不正确", pattern=AGE_PATTERN), Format("gender", "性别", "性别非 男/女/未知的性别", values=GENDERS))
    consistency: tuple[Consistency, ...] = ()
    standardized: tuple[str, ...] = ("disease", "pattern", "symptom", "herb", "formula")
    weight_each: int = 1
    cap: int = 5
    duplicate: int = 5
    review_upper: int = 80
    invalid: int = 60


def deduction(kind: str, item: Column | str, points: Column | int, reason: Column | str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("type"), as_col(item).alias("item"), as_col(points).cast("int").alias("points"), as_col(reason).alias("reason"))


def completeness(rules: RuleSet, lists: dict[str, Column]) -> Column:
    """Deductions for missing elements; raw text behind a missing list halves them. lists: field to list column."""
    out = []
    for e in rules.elements:
        raw = reduce(lambda a, b: a | b, (blank_to_null(c).isNotNull() for c in e.fallback), F.lit(False))
        there = F.coalesce(F.size(lists[e.field]) > 0, F.lit(False)) if e.field in lists else F.lit(False)
        out.append(F.when(~there & raw, deduction("核心字段缺失", e.name, e.partial, "partial")).when(~there, deduction("核心字段缺失", e.name, e.full, "missing")))
    return F.array_compact(F.array(*out))


def whole_match(c: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole of a text; a pattern that is none lets every text pass."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return F.lit(True)
    return c.rlike(f"\\A(?:{pattern})\\z")


def formats(rules: RuleSet) -> Column:
    """A null value is not judged; see whole_match for patterns."""
    out = []
    for f in rules.formats:
        c = F.col(f.column)
        ok = whole_match(c, f.pattern) if f.pattern else c.isin(*f.values)
        out.append(F.when(c.isNotNull() & ~ok, deduction("格式错误", f.label, f.weight, f.reason)))
    return F.array_compact(F.array(*out))


def conflicts(rules: RuleSet, texts: dict[str, Column]) -> Column:
    """Deductions for broken consistency rules; texts: entity key to its list of strings."""

    def holds(key: str, values: tuple[str, ...]) -> Column:
        return F.exists(texts[key], lambda t: reduce(lambda a, b: a | b, (t.contains(v) for v in values)))

    out = []
    for r in rules.consistency:
        broken = holds(r.trigger, r.trigger_values) & (F.size(texts[r.expect]) > 0) & ~holds(r.expect, r.expect_values)
        out.append(F.when(broken, deduction("逻辑冲突", r.name, r.weight, f"{r.name}：{BY_KEY[r.expect].label}与{BY_KEY[r.trigger].label}不符")))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<type:string,item:string,points:int,reason:string>>")


def standardization_points(rules: RuleSet, misses: Column) -> Column:
    """One point an unnormalised entity up to the cap, then one for each further full cap."""
    m = misses.cast("int")
    beyond = F.lit(rules.cap) + F.expr("1") * F.floor((m - rules.cap) / F.lit(rules.cap))
    return (F.when(m <= rules.cap, m).otherwise(beyond) * rules.weight_each).cast("int")


def score(deductions: Column) -> Column:
    total = F.aggregate(deductions, F.lit(0), lambda s, d: s + d["points"])
    return F.greatest(F.lit(0), 100 - total)


def grade(rules: RuleSet, points: Column, any_conflict: Column) -> Column:
    return F.when(points < rules.invalid, INVALID).when(any_conflict, PENDING).when(points >= rules.review_upper, QUALIFIED).otherwise(PENDING)


def status(g: Column) -> Column:
    return F.when(g == QUALIFIED, STATUS[QUALIFIED]).when(g == PENDING, STATUS[PENDING]).otherwise(STATUS[INVALID])


def duplicate_flag(df: DataFrame, key: str = "text_hash") -> DataFrame:
    """Every row of a text but its latest is a duplicate. The latest is found by partial aggregation, so a hot text is no sort."""
    out = df.join(first_of(df, key), key, "left")
    return out.withColumn("duplicate", F.coalesce(later_copies(out, key), F.lit(False))).drop("__first").select(*df.columns, "duplicate")


def scored(df: DataFrame, rules: RuleSet, lists: dict[str, Column], texts: dict[str, Column], misses: Column, duplicate: Column) -> DataFrame:
    """df with deductions, score, grade and status; all rules are one projection without any shuffle."""
    standard = F.when(misses > 0, deduction("术语未标准化", "术语", standardization_points(rules, misses), F.concat(misses.cast("string"), F.lit(" 个未标准化"))))
    repeated = F.when(duplicate, deduction("重复数据", "重复", rules.duplicate, "重复数据"))
    broken = conflicts(rules, texts)
    all_of = F.concat(completeness(rules, lists), broken, formats(rules), F.array_compact(F.array(standard, repeated)))
    out = df.withColumn("deductions", all_of).withColumn("score", score(F.col("deductions")))
    conflict = F.exists("deductions", lambda d: d["type"] == "逻辑冲突")
    return out.withColumn("grade", grade(rules, F.col("score"), conflict)).withColumn("status", status(F.col("grade")))


def issue_type(deductions: Column) -> Column:
    has = lambda kind: F.exists(deductions, lambda d: d["type"] == kind)
    return F.when(has("逻辑冲突"), "conflict").when(has("核心字段缺失"), "missing").otherwise("score")


def merge_reviews(tasks: DataFrame, records: DataFrame, day: Column, workdays: int = 7) -> DataFrame:
    """The new task table: a pending record has one live task, made or reset today; others' live tasks are obsolete.

    tasks: record_id, status, create_day, deadline; records: id, grade. At most one live task a record comes in.
    """
    r = records.select(F.col("id").alias("record_id"), "grade")
    both = tasks.join(r, "record_id", "full_outer")
    pending = F.col("grade") == PENDING
    kept = both.where(F.coalesce(pending, F.lit(False)) | F.col("status").isNotNull())
    due = add_workdays(day, workdays)
    return kept.select(
        "record_id",
        F.when(pending, "pending").otherwise(F.col("status")).alias("status"),
        F.when(pending, day).otherwise(F.col("create_day")).alias("create_day"),
        F.when(pending, due).otherwise(F.col("deadline")).alias("deadline"),
        (F.col("grade").isNotNull() & ~F.coalesce(pending, F.lit(False))).alias("is_obsolete"),
    )


def missing_lists(rules: RuleSet, lists: dict[str, Column]) -> tuple[Column, Column]:
    """Names of elements that are missing whole, and of those that raw text stands in for."""
    found = completeness(rules, lists)
    pick = lambda kind: F.transform(F.filter(found, lambda d: d["reason"] == kind), lambda d: d["item"])
    return pick("missing"), pick("partial")


def checked(df: DataFrame, rules: RuleSet, lists: dict[str, Column]) -> DataFrame:
    """A record's check alone: missing elements (whole or partial) and format errors, as text, without a score."""
    whole, partial = missing_lists(rules, lists)
    wrong = F.transform(formats(rules), lambda d: d["item"])
    return df.select("id", F.array_join(F.concat(whole, partial), "、").alias("missing"), F.array_join(wrong, "、").alias("format_errors"))


def governed_after(old: Column, new_grade: Column) -> Column:
    """A record stays governed only while it is qualified."""
    return old & F.coalesce(new_grade == QUALIFIED, F.lit(False))


def with_fallback_score(df: DataFrame, computed: Column) -> DataFrame:
    """df with score where one is stored, else the computed one; recomputed tells which."""
    return df.withColumn("recomputed", F.col("score").isNull()).withColumn("score", F.coalesce("score", computed))


def fingerprint(document: Column, points: Column, g: Column) -> Column:
    """What a review was based on: a hash of the document, score and grade."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat(text(document), F.lit("\0"), text(points), F.lit("\0"), text(g)).cast("binary"), 256)


def reviewed(records: DataFrame, reviews: DataFrame, rules: RuleSet) -> DataFrame:
    """Outcome of human reviews (id, fingerprint, deductions after correction): refused for invalid records and stale fingerprints, else re-scored.

    records: id, grade, structured_data, score, deductions. A duplicate's deduction stays whatever the correction says.
    """
    r = reviews.select("id", F.col("fingerprint").alias("seen"), F.col("deductions").alias("new"))
    both = records.join(r, "id")
    now = fingerprint(F.col("structured_data"), F.col("score"), F.col("grade"))
    kept = F.filter("deductions", lambda d: d["type"] == "重复数据")
    merged = F.concat(F.filter("new", lambda d: d["type"] != "重复数据"), kept)
    points = score(merged)
    conflict = F.exists(merged, lambda d: d["type"] == "逻辑冲突")
    outcome = F.when(F.col("grade") == INVALID, "invalid").when(F.col("seen") != now, "stale").otherwise("accepted")
    return both.select("id", outcome.alias("outcome"), F.when(outcome == "accepted", points).otherwise(F.col("score")).alias("score"), F.when(outcome == "accepted", grade(rules, points, conflict)).otherwise(F.col("grade")).alias("grade"))


def rules_of(document: dict | None) -> RuleSet:
    """A rule set from its stored form: unknown keys and values of a wrong type or below 0 fall back to the defaults."""
    given, base = document or {}, RuleSet()
    number = lambda name, most: v if isinstance(v := given.get(name), int) and not isinstance(v, bool) and 0 <= v <= most else getattr(base, name)
    kinds = tuple(k for k in given.get("standardized") or () if k in BY_KEY) if isinstance(given.get("standardized"), list) else base.standardized
    rules = [r for r in given.get("consistency") or () if isinstance(r, dict) and r.get("trigger") in BY_KEY and r.get("expect") in BY_KEY and r.get("name")]
    made = tuple(Consistency(r["name"], r["trigger"], tuple(r.get("trigger_values") or ()), r["expect"], tuple(r.get("expect_values") or ()), r.get("weight", 10)) for r in rules)
    invalid, upper = number("invalid", 100), number("review_upper", 100)
    if invalid > upper:
        invalid, upper = base.invalid, base.review_upper
    return RuleSet(consistency=made, standardized=kinds, weight_each=number("weight_each", 100), cap=max(1, number("cap", 100)), duplicate=number("duplicate", 100), review_upper=upper, invalid=invalid)


def narrative(deductions: Column, points: Column, g: Column) -> Column:
    """The result in a sentence: score, grade, and each deduction with its points."""
    parts = F.transform(deductions, lambda d: F.concat(d["type"], F.lit("："), d["item"], F.lit(" -"), d["points"].cast("string")))
    return F.concat(F.lit("评分 "), points.cast("string"), F.lit("，"), g, F.when(F.size(parts) > 0, F.concat(F.lit("。"), F.array_join(parts, "；"))).otherwise(F.lit("。无扣分")))
