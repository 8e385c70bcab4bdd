"""How often a plan reads its tables and documents: what several steps need is worked out once."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import entities as ent
from lodestrata.plans import catalogue, structured, views

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def _scans(df, column: str) -> int:
    leaves = _plan(df).collectLeaves()
    return sum(f"{column}#" in leaves.apply(i).toString() for i in range(leaves.size()))


def test_documents_and_elements_are_parsed_once(spark):
    plan = _plan(ent.exploded(views.charts(spark, SF)).where("kind = 'herb' and term is not null")).toString()
    assert plan.count("from_json(") == 1 + len(ent.FIELDS)


def test_charts_gather_a_record_once(spark):
    assert _plan(views.charts(spark, SF)).toString().count("collect_list(") == 1


@pytest.mark.parametrize("query", [structured.missed_terms, structured.norm_hits])
def test_equal_elements_are_counted_before_they_are_parsed(spark, query):
    lines = _plan(query(spark, SF)).toString().splitlines()
    counting = [i for i, line in enumerate(lines) if re.search(r"Aggregate \[kind#\d+, text#\d+\]", line)]
    parsing = [i for i, line in enumerate(lines) if "from_json(StructField(content" in line]
    assert len(counting) == len(parsing) == 1 and parsing <= counting  # a plan is written from its end; groups are parsed in the line that makes them


def test_counted_elements_are_those_of_the_lists(spark):
    herbs = '"herbs":["a"," a ","a",{"name":"b","normLevel":2},{"name":"b","normLevel":2},{"name":"b","normLevel":"2"},{"content":" ","name":"c","confidence":"x"},null,"",[1],7,{"sourceText":"d"}]'
    documents = ["{" + herbs + "}", "{" + herbs + ',"symptoms":["a"],"_meta":5}', '{"inquiry":{"x":1},"symptoms":["a","{"],"herbs":"none"}', '{"symptoms":["a"],"_meta":{"dictTermCount":"x"}}', '{"symptoms": ["a"', "{}", "[]", "", None]
    df = spark.createDataFrame(list(enumerate(documents)), "id long, structured_data string")
    fields = ["kind", "term", "source_text", "norm_level", "dosage", "plain"]
    want = ent.exploded(df).groupBy(fields).agg(F.count("*").alias("n")).collect()
    got = ent.counted(df).groupBy(fields).agg(F.sum("n").alias("n")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r["kind"], r["term"]): r["n"] for r in ent.missed_terms(ent.counted(df)).collect()}["herb", "a"] == 6


def test_elements_of_every_shape(spark):
    document = '{"herbs":[" a ",{"name":"b","dosage":"1g"},{"content":" ","name":"c","normLevel":2},null,{"sourceText":" d "}],"symptoms":"none"}'
    rows = ent.exploded(spark.createDataFrame([(1, document), (2, "{"), (3, None)], "id long, structured_data string")).orderBy("pos").collect()
    assert [(r["id"], r["pos"], r["term"], r["source_text"], r["norm_level"], r["dosage"], r["plain"]) for r in rows] == [
        (1, 0, "a", None, None, None, True), (1, 1, "b", None, None, "1g", False), (1, 2, "c", None, 2, None, False), (1, 3, None, None, None, None, None), (1, 4, None, "d", None, None, False),
    ]


def test_noise_reads_the_lists_once(spark):
    assert _scans(catalogue.queries()["noise_reasons"](spark, SF), "l_orderkey") == 1


def test_decomposition_keeps_its_inputs(spark):
    assert _scans(catalogue.queries()["decomposed_terms"](spark, SF), "l_orderkey") == 0


def test_scores_read_the_lists_once(spark):
    assert _scans(catalogue.queries()["qc_score_grade"](spark, SF), "l_orderkey") == 1


def test_spans_with_equal_bounds_are_one_run_in_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT range % 3000 AS l_orderkey, 'A' AS l_returnflag, (range // 3000) % 5 * 10 AS l_partkey, 2 AS l_linenumber, range % 7 AS l_suppkey FROM range(900000)")
    runs = con.execute(f"SELECT count(*), min(\"end\" - begin), max(\"end\" - begin) FROM ({catalogue.ORACLE['merged_spans']})").fetchall()
    assert runs == [(15000, 7, 7)]


@pytest.mark.parametrize(("name", "most"), [("replacement_pairs", 0), ("effective_pairs", 1), ("pattern_freq_union", 1), ("backfill", 1), ("herb_normalize", 0), ("reroute_documents", 1), ("clean_documents", 2), ("normalize_chain", 0), ("placed_entities", 0)])
def test_lists_are_kept_for_later_steps(spark, name, most):
    assert _scans(catalogue.queries()[name](spark, SF), "l_orderkey") <= most
