"""Files in and out, streams, and text rules that SQL can't say."""

from __future__ import annotations

import csv
import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import dictionary, entities, extraction, filters, ingest, qc
from lodestrata.plans import catalogue
from lodestrata.sources import files
from lodestrata.streaming import ingest as stream

SF = "/root/testdata/sf0.001"


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("标准术语,别名\r\n头痛,头疼、 脑袋疼|头痛\r\n\r\n 咳嗽 \t咳；呛咳\r\n".encode())
    (tmp_path / "b.csv").write_bytes("心悸,心慌".encode("gbk"))
    got = {r["standard_term"]: r["aliases"] for r in files.dictionary_csv(spark, f"{tmp_path}/*.csv", "symptom").collect()}
    assert got == {"头痛": ["头疼", "脑袋疼"], "咳嗽": ["咳", "呛咳"], "心悸": ["心慌"]}
    (tmp_path / "c.json").write_text(json.dumps([{"standardTerm": " 风寒 ", "aliases": ["寒邪", "", "风寒"]}, {"standardTerm": " "}, {"standardTerm": "湿热"}]))
    rows = files.dictionary_json(spark, f"{tmp_path}/c.json", "cause")
    assert {(r["type"], r["standard_term"], tuple(r["aliases"])) for r in rows.collect()} == {("cause", "风寒", ("寒邪",)), ("cause", "湿热", ())}
    stored = spark.createDataFrame([("", "cause", "旧", []), ("", "herb", "甘草", ["草"]), ("o", "cause", "own", [])], "org_id string, type string, standard_term string, aliases array<string>")
    more = rows.unionByName(spark.createDataFrame([("herb", "甘草", ["草"])], rows.schema))
    assert {(r["org_id"], r["standard_term"]) for r in files.reconciled(stored, more).collect()} == {("", "风寒"), ("", "湿热"), ("", "甘草"), ("o", "own")}


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi"\nthere', datetime.datetime(2024, 1, 5, 8, 30)), (1, "tel 13812345678", None)], "id int, chief_complaint string, visit_time timestamp_ntz")
    files.write_csv(files.csv_rows(df, {"chief_complaint": "主诉", "visit_time": "接诊时间"}, masked=("chief_complaint",)), ["主诉", "接诊时间"], f"{tmp_path}/out")
    parts = sorted(Path(tmp_path, "out").glob("part-*"))
    rows = [r for p in parts for r in csv.reader(p.read_text("utf-8-sig").splitlines())]
    assert [r for r in rows if r != ["主诉", "接诊时间"]] == [["tel ***", ""], ['say "hi" there', "2024-01-05"]]
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in parts if p.stat().st_size)
    files.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_stream_ingest(spark, tmp_path):
    heads = ["登记号", "门诊号", "接诊时间"]
    (tmp_path / "in").mkdir()
    for k, line in enumerate(["R1,O1,2024/1/5", "R2,,20240105", " ,O3,", "R4,O4,soon", "R5,O5,"]):
        (tmp_path / "in" / f"{k}.csv").write_text(",".join(heads) + "\n" + line + "\n")
    for _ in range(2):  # a second run finds nothing new
        stream.start(stream.cells(spark, f"{tmp_path}/in", heads, 2), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    good = {(r["registration_no"], r["visit_time"]) for r in spark.read.parquet(f"{tmp_path}/good").collect()}
    bad = {(r["cells"]["登记号"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/bad").collect()}
    assert good == {("R1", datetime.datetime(2024, 1, 5)), ("R5", None)} and bad == {("R2", ingest.NO_OUTPATIENT), ("R4", ingest.BAD_TIME)}


def test_stream_drops_repeated_texts(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, datetime.datetime(2024, 1, 1, 0, k)) for k in range(9)], "h int, at timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stream.deduplicated(read, ["h"], "at", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["h"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2]
    assert stream.deduplicated(rows, ["h"], "at", "1 hour").count() == 3


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="visit_time"):
        ingest.mapped(spark.createDataFrame([("f", 1, "R")], "file string, row int, `登记号` string"))


def test_windows_hold_the_whole_text(spark):
    texts = ["", "一句。" * 400, "".join(f"{i:04}" for i in range(500)), "短。" + "".join(f"{i:03}" for i in range(200)) + "。尾", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in rows.select("text", extraction.windows(F.col("text")).alias("w")).collect():
        assert all(0 < len(w) <= 508 for w in r["w"])
        at = 0
        for w in r["w"]:  # each window goes on where the one before ended, or 24 characters back
            at = next(p for p in (at, at - 24) if p >= 0 and r["text"][p : p + len(w)] == w) + len(w)
        assert at == len(r["text"] or "")
    assert catalogue.queries()["text_windows"](spark, SF).agg(F.max("n")).first()[0] <= 508


def test_tagged_spans(spark):
    tags = [(1, 0, 0, 1, "B-a", 0.5), (1, 1, 1, 2, "I-a", 0.7), (1, 2, 2, 3, "O", 1.0), (1, 3, 3, 4, "I-b", 0.9), (1, 4, 4, 5, "B-b", 0.9)]
    rows = spark.createDataFrame(tags, "id int, at int, begin int, end int, tag string, score double")
    assert {(r["label"], r["begin"], r["end"], r["score"]) for r in extraction.tagged_spans(rows).collect()} == {("a", 0, 2, 0.6), ("b", 3, 4, 0.9), ("b", 4, 5, 0.9)}


def test_documents_of_every_shape(spark):
    docs = [None, "", "{}", "no json", '{"symptoms": null}', '{"symptoms": "x"}', '{"symptoms": ["咳", {"content": " ", "sourceText": "痰"}, {"content": "热", "normLevel": 2}, {"name": "n"}, 3]}', '{"_meta": {"manuallyEdited": "TRUE"}}', '{"_meta": {"manuallyEdited": -2.7}}', '{"_meta": {"manuallyEdited": "1"}}', '{"_meta": {"manuallyEdited": 0.5}}']
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, structured_data string")
    got = {(r["id"], r["pos"], r["term"], r["source_text"], r["norm_level"]) for r in entities.exploded(rows).collect()}
    assert got == {(6, 0, "咳", None, None), (6, 1, None, "痰", None), (6, 2, "热", None, 2), (6, 3, "n", None, None), (6, 4, "3", None, None)}
    assert [r["m"] for r in rows.orderBy("id").select(entities.manually_edited(F.col("structured_data")).alias("m")).collect()] == [False] * 7 + [True, True, False, False]
    stamped = entities.stamped(rows.where("id in (5, 6)"), "v", "t", 3).orderBy("id").collect()
    assert json.loads(stamped[0]["structured_data"])["symptoms"] == "x" and json.loads(stamped[1]["structured_data"])["_meta"]["dictVersion"] == "v"


def test_long_id_lists_join(spark):
    rows = spark.range(1000)
    assert filters.RecordFilter(ids=tuple(range(0, 500, 2))).apply(rows).count() == 250
    assert not filters.RecordFilter.from_map({"grade": "null", "gender": " ", "x": 1}).describe() != "all"


def test_rules_from_documents():
    assert qc.rules_of(None) == qc.RuleSet()
    odd = qc.rules_of({"cap": -1, "invalid": 90, "review_upper": 10, "standardized": ["herb", "x"], "duplicate": 7, "consistency": [{"name": "n", "trigger": "herb", "expect": "pulse", "trigger_values": ["a"], "expect_values": ["b"]}, {"trigger": "?"}]})
    assert (odd.cap, odd.invalid, odd.review_upper, odd.standardized, odd.duplicate, len(odd.consistency)) == (5, 60, 80, ("herb",), 7, 1)


def test_report_lines_end_by_cr_and_lf(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x"', None), (1, "a\nb", 1.5)], "id long, t string, v double")
    files.write_csv(files.report_rows(rows, ("t", "v")), ["text", "value"], f"{tmp_path}/r", line_end="\r\n")
    got = b"".join(p.read_bytes() for p in sorted(Path(f"{tmp_path}/r").glob("part-*"))).decode()
    head = '﻿"text","value"\r\n'
    assert got.replace(head, "") == '"a\nb","1.5"\r\n"say ""x""",""\r\n' and got.startswith(head)


def test_records_as_one_array(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit('q"'), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("l"))
    whole = lambda path: json.loads("".join(p.read_text() for p in sorted(Path(path).glob("part-*"))))
    files.write_json_array(rows, f"{tmp_path}/a")
    assert whole(f"{tmp_path}/a") == [{"id": i, "t": f'q"{i}', "l": None if i % 2 else [i]} for i in range(100)]
    for n in (1, 0):
        files.write_json_array(rows.where(F.col("id") < n), f"{tmp_path}/{n}")
        assert len(whole(f"{tmp_path}/{n}")) == n


def test_whole_match_and_invalid_patterns(spark):
    rows = spark.createDataFrame([("34岁",), ("x34岁",), ("34岁\n",), (None,)], "t string")
    got = rows.select(qc.whole_match(F.col("t"), r"\d+岁|a").alias("a"), qc.whole_match(F.col("t"), "(").alias("b")).collect()
    assert [r["a"] for r in got] == [True, False, False, None] and all(r["b"] for r in got)


def test_small_functions(spark):
    """Fenced blocks and replacement by pairs of a record."""
    rows = spark.createDataFrame([("```json\n{\"a\": 1}\n```", "x"), (" plain ", "头疼，无头疼"), (None, None)], "t string, s string")
    got = rows.select(text.code_fence_stripped(F.col("t")).alias("t"), text.safe_replace(F.col("s"), F.create_map(F.lit("头疼"), F.lit("头痛"))).alias("s")).collect()
    assert [tuple(r) for r in got] == [('{"a": 1}', "x"), ("plain", "头痛，无头疼"), (None, None)]


def test_a_replacement_must_not_shrink_the_dictionary(spark):
    dictionary.guard_shrink(spark.range(10), spark.range(8))
    with pytest.raises(ValueError, match="would replace"):
        dictionary.guard_shrink(spark.range(10), spark.range(7))
