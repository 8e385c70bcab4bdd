"""The whole chain of a record's lists, step by step on cases of each rule."""

from __future__ import annotations

import re

import pytest

from lodestrata.operators import chain
from lodestrata.plans import documents

SF = "/root/testdata/sf0.001"
ENTITY = "id long, field string, type string, pos int, content string, source_text string, norm_level int"
TYPES = ("disease", "pattern", "symptom", "herb", "formula", "tongue", "pulse")
TERMS = [
    ("symptom", "头痛", ["头疼"]), ("symptom", "口干", []), ("pulse", "脉细", []), ("pulse", "脉涩", []), ("pulse", "左关", []), ("tongue", "舌淡", []), ("tongue", "薄苔", ["苔薄"]), ("disease", "感冒", []), ("cause", "风寒", []),
    ("herb", "天麻", []), ("herb", "菊花", ["杭菊"]), ("herb", "姜", []), ("pattern", "气虚", []), ("pattern", "血瘀", []),
]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "type string, standard_term string, aliases array<string>")


def test_fragments_by_plain_rules(spark):
    cases = [
        ("symptom", "头 痛", "punctuation"), ("pulse", "“弦”", "punctuation"), ("formula", "太阴", "channel"), ("pulse", "沉取不足", "pulse technique"), ("symptom", "有齿痕", "tongue element"), ("symptom", "劳则甚", "course"),
        ("symptom", "色黄", "description"), ("symptom", "色黄绿带白", None), ("symptom", "量中等", "description"), ("symptom", "大便", "description"), ("disease", "大便", None), ("disease", "慢性", "severity"), ("disease", "慢性胃炎", None),
        ("tongue", "舌尖", "bare tongue"), ("symptom", "舌尖", None), ("formula", "中草药", "formula fragment"), ("herb", "总胆红", "no herb"), ("herb", "蛇胆", None), ("cause", "风寒", None), ("symptom", None, None), ("symptom", "", None),
    ]
    rows = spark.createDataFrame([(i, k, t, None, None) for i, (k, t, _) in enumerate(cases)] + [(99, "symptom", "大便", None, 2), (100, "symptom", " ", "晨起", None)], "i int, type string, content string, source_text string, norm_level int")
    got = {r["i"]: r["reason"] for r in chain.dropped_fragments(rows).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)} | {99: None, 100: "description"}


def test_placed(spark, terms):
    rows = [
        (1, "symptoms", "symptom", 0, "头疼", None, None), (1, "symptoms", "symptom", 1, "脉细", None, None), (1, "symptoms", "symptom", 2, "左关偏细", None, None), (1, "symptoms", "symptom", 3, "舌淡苔薄", None, None), (1, "symptoms", "symptom", 4, "别的", None, None),
        (1, "diseases", "disease", 0, "风寒", None, None), (1, "diseases", "disease", 1, "感冒", None, None), (1, "diseases", "disease", 2, "头痛", None, None), (1, "diseases", "disease", 3, None, "血瘀", None),
        (1, "inquiry", "inquiry", 0, "x", "口干", None), (1, "inquiry", "inquiry", 1, "口干", "睡眠可", None), (2, "herbs", "herb", 0, "头痛", None, None), (2, "symptoms", "symptom", 0, None, None, None),
    ]
    got = {(r["id"], r["content"], r["source_text"]): (r["field"], r["type"], r["moved"]) for r in chain.placed(spark.createDataFrame(rows, ENTITY), terms).collect()}
    moved = {k: v[:2] for k, v in got.items() if v[2]}
    assert len(got) == len(rows) and moved == {
        (1, "脉细", None): ("pulseList", "pulse"), (1, "左关偏细", None): ("pulseList", "pulse"), (1, "舌淡苔薄", None): ("tongueList", "tongue"), (1, "风寒", None): ("causeList", "cause"),
        (1, "头痛", None): ("symptoms", "symptom"), (1, None, "血瘀"): ("patternList", "pattern"), (1, "x", "口干"): ("symptoms", "symptom"),
    }


def test_whole_chain_with_raw_texts(spark, terms):
    rows = [
        (1, "herbs", "herb", 0, "天", None, None), (1, "herbs", "herb", 1, "姜", None, None), (1, "herbs", "herb", 2, "杭菊", None, None), (2, "herbs", "herb", 0, "天麻", None, None), (3, "patternList", "pattern", 0, "血", "血", None),
        (4, "symptoms", "symptom", 0, "左关偏细", None, None), (4, "pulseList", "pulse", 0, "脉细", None, None), (4, "symptoms", "symptom", 1, "大便", None, None), (4, "symptoms", "symptom", 2, "无头痛", None, None),
        (5, "herbs", "herb", 0, "天 麻根", None, None),  # dropped; its raw text is a term as a whole, which scan() leaves out
    ]
    raw = [(1, "herb", "天麻10g，菊花10g"), (2, "herb", "菊花"), (3, "pattern", "气虚血瘀"), (3, "disease", "感冒三天"), (5, "herb", "天麻"), (6, "herb", "姜,天麻"), (4, "herb", None), (4, "herb", " ")]
    got = chain.normalized_records(spark.createDataFrame(rows, ENTITY), spark.createDataFrame(raw, "id long, type string, text string"), terms, TYPES).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r["id"], r["field"], r["at"])):
        lists.setdefault((r["id"], r["field"]), []).append((r["term"], r["norm_level"]))
    assert lists == {
        (1, "herbs"): [("姜", 1), ("菊花", 1)], (2, "herbs"): [("天麻", 1)], (3, "patternList"): [("气虚", 1), ("血瘀", 1)], (3, "diseases"): [("感冒", 1)],
        (4, "pulseList"): [("脉细", 1), ("左关", 1)], (6, "herbs"): [("天麻", 1)],
    }


def test_queries_run(spark):
    moved = documents.placed_entities(spark, SF).where("moved").collect()
    assert {(r["content"], r["field"]) for r in moved} >= {("左关弦", "pulseList"), ("脉细数", "pulseList")}
    out = documents.normalized_records(spark, SF).collect()
    assert len({(r["id"], r["field"], r["at"]) for r in out}) == len(out) > 1000
    assert not [r for r in out if r["norm_level"] is None and re.search(r"[\s、，。]", r["term"])]
