"""Every registered query against its SQL, and text functions on the rules' own strings."""

from __future__ import annotations

import datetime
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import extraction, normalize, qc
from lodestrata.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key) and rows


def test_every_part_is_asked_and_in_the_dictionary(spark):
    want = {tuple(r) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_type", "p_name").distinct().collect()}
    found = catalogue.queries()
    assert {(r["type"], r["input"]) for r in found["candidate_topk_whole"](spark, SF).collect()} == want
    assert {(r["type"], r["standard_term"]) for r in found["dict_overlay_whole"](spark, SF).collect()} == want


def test_whole_texts_are_masked(spark, tmp_path):
    """Phones and identity numbers anywhere in a text, beside each other and beside letters; longer numbers stay."""
    phone, ident = re.compile(r"(?<!\d)1[3-9]\d{9}(?!\d)", re.A), re.compile(r"(?<!\d)\d{17}[\dXx](?!\d)", re.A)
    texts = ["a 13812345678 b", "13812345678 13912345678,15012345678", "x13812345678y\n11010519491231002x", "1381234567899", "1234567890123456789", "123456789012345678 11010519491231002X", "12345678901", "", None, "long " * 5000 + "13812345678"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: ident.sub("***", phone.sub("***", "tel 13812345678, id 11010519491231002X, " + (t or ""))) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["masked"] for r in catalogue.queries()["pii_mask_text"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute(catalogue.ORACLE["pii_mask_text"]).fetchall()) == want


def test_text_rules():
    assert text.punctuation_of("舌淡 , 苔白.. 脉细") == "舌淡，苔白。脉细"
    assert text.replaced_text("无头疼，头疼三天", {"头疼": "头痛"}) == "无头疼，头痛三天"


def test_negation(spark):
    """A term is negated where each of its places is: by its own clause, up to 30 characters back."""
    cases = [
        ("反酸", "无腹痛反酸", True), ("食欲不振", "食欲不振", False), ("反酸", "无腹痛。反酸", False), ("反酸", "无反酸，有反酸", False), ("反酸", "无反酸，未见反酸", True),
        ("不热", "", True), ("不痛快", "", False), ("无汗", None, True), ("打嗝", "无腹胀、反酸、打嗝", True), ("头痛", "无" + "热" * 40 + "头痛", False), ("头痛", "否认" + "热" * 20 + "头痛", True),
        ("", "无", False), (None, "无", False), ("a.b", "无a.b", True), ("a.b", "无axb", False), ("痛痛", "无痛痛痛", True), ("寐", "不寐", True),
    ]
    rows = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(cases)], "i int, span string, text string")
    got = {r["i"]: r["n"] for r in rows.select("i", text.negated(F.col("span"), F.col("text")).alias("n")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
    assert text.replaced_text("不发头疼，不适头疼", {"头疼": "头痛", "疼": "x"}) == "不发头疼，不适头痛"


def test_terms_are_quoted_whatever_they_hold(spark):
    odd = ["a\\E(", "\\E", "(", "[", "\\Q", "x\\Ey\\E", "a.b*", "", None]
    rows = spark.createDataFrame([(t, f"无{t or ''} 3g，{t or ''}") for t in odd], "t string, text string")
    got = rows.select("t", text.negated(F.col("t"), F.col("text")).alias("n"), extraction.with_dose(F.col("t"), F.col("text")).alias("d"), F.rlike("text", text.quoted(F.coalesce("t", F.lit("")))).alias("r")).collect()
    assert all(r["r"] for r in got)
    assert [(r["n"], r["d"]) for r in got] == [(False, bool(t)) if t else (False, t == "") for t in odd]


def test_columns(spark):
    one = spark.range(1)
    row = one.select(
        text.normalized_datetime(F.lit("2024年1月5日 8:30")).alias("a"),
        text.normalized_datetime(F.lit("20240105")).alias("b"),
        text.normalized_datetime(F.lit("bad")).alias("c"),
        text.add_workdays(F.lit(datetime.date(2024, 1, 5)), 7).alias("d"),
        text.polarity_only(F.lit("食欲不振"), F.lit("食欲振")).alias("e"),
        text.mask_pii(F.lit("电话13812345678。")).alias("f"),
        text.negated_context(F.lit("咳嗽已愈")).alias("g"),
        text.lenient_int(F.lit(" 3.7 ")).alias("h"),
    ).first()
    assert row["a"] == datetime.datetime(2024, 1, 5, 8, 30) and row["b"] == datetime.datetime(2024, 1, 5) and row["c"] is None
    assert row["d"] == datetime.date(2024, 1, 16) and row["e"] and row["f"] == "电话***。" and row["g"] and row["h"] == 3


def test_standardization_points(spark):
    rows = spark.createDataFrame([(m,) for m in (0, 5, 9, 10, 15)], "m int").select(qc.standardization_points(qc.RuleSet(), F.col("m")).alias("p")).collect()
    assert [r["p"] for r in rows] == [0, 5, 5, 6, 7]


def test_judge(spark):
    terms = spark.createDataFrame([("symptom", "头痛", ["头疼"]), ("symptom", "食欲不振", []), ("symptom", "咽喉肿痛", [])], "type string, standard_term string, aliases array<string>")
    words = ["头痛", "头疼", "大头痛", "食欲振", "喉咽肿痛", "无关", "痛", None]
    got = {r["input"]: (r["standard_term"], r["level"]) for r in normalize.judge(spark.createDataFrame([("symptom", w) for w in words], "type string, input string"), terms).collect()}
    assert got == {"头痛": ("头痛", 1), "头疼": ("头痛", 1), "大头痛": ("头痛", 2), "食欲振": (None, 0), "喉咽肿痛": ("咽喉肿痛", 3), "无关": (None, 0), "痛": (None, 0)}
