"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from lodestrata.llm import quality, queries, stages
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert 0.5 * before < docs.count() <= before
            before = docs.count()
    left = spark.read.parquet(f"{tmp_path}/3")
    assert docs.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


def test_labelled_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.01").select("doc_id")
    clean, toxic = labels.where("quality = 1 and toxic = 0"), labels.where("toxic = 1")
    assert clean.join(kept, "doc_id").count() > 0.95 * clean.count()
    assert toxic.join(kept, "doc_id").count() <= 0.1 * toxic.count() + 1


def test_near_duplicate_stage_tells_rows_apart(spark):
    """Another text under a copy's doc_id stays, one of equal rows stays, texts without words all stay."""
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a.replace("w59", "x"), " ".join(f"o{i}" for i in range(30))
    rows = [(3, a), (5, near), (5, other), (8, "one text of some words here"), (8, "one text of some words here"), (None, a), (None, "alone without a number it is"), (9, None), (9, None), (10, ""), (2, "  ")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, __id int, root int")
    got = stages.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(3, a), (5, other), (8, rows[3][1]), (None, rows[6][1]), (9, None), (9, None), (10, ""), (2, "  ")], key=str)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edge_and_empty_tables(spark, edge, edge_rows, empty, k):
    """Nulls, repeated rows, clashing columns and no rows at all, in each stage."""
    stage = corpus_pipeline.STAGES[k][1]
    extra = edge.select("*", *(F.lit(1).alias(c) for c in ("n", "h", "root", "hits", "n_lines", "p_low", "keep", "length", "__row", "__id", "component_id")))
    out = stage(spark, extra, SF)
    if k < 4:
        assert out.columns == extra.columns
        assert out.count() <= len(edge_rows)
    else:
        assert out.count() >= len(edge_rows)
    assert stage(spark, empty, SF).count() == 0


def test_held_out_flags(spark):
    for r in queries.op9_language_id(spark, SF).limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_on_the_half_without_labels(spark):
    """Fitted on half of the labels, the classifier finds the other half's toxic documents and leaves clean ones."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    out = quality.classify(spark, spark.read.parquet(f"{d}/documents.parquet"), labels.where(half == 0), carry_text=False)
    met = labels.where(half == 1).join(out.select("doc_id", "keep"), "doc_id")
    rows = met.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept")).collect()
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["kept"] for r in clean) >= 0.98 * sum(r["n"] for r in clean) > 0
    assert sum(r["kept"] for r in toxic) <= 0.1 * sum(r["n"] for r in toxic)


def test_priors_of_real_hosts_and_paths(spark):
    """Hosts and path sections of page addresses, many with one page: every probability by hand from the evidence."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/]*)", 1).alias("section"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "alone", "one.example", "x"), (-2, "nowhere", None, None), (-3, None, None, "x")], docs.schema))
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.length("html") % 2).alias("quality"), F.when(F.col("html").contains("the"), 1).otherwise(0).alias("toxic"))
    model = quality.fit(docs, labels)
    rows = [r.asDict() for r in quality.with_evidence(docs, model).drop("text").collect()]
    got = {r["doc_id"]: r for r in quality.classify(spark, docs, labels, "host", "section", carry_text=False).collect()}
    sizes = Counter((r["host"], r["section"]) for r in rows)
    assert len(got) == len(rows) and 1 in sizes.values() and len(sizes) > 3

    def moments(groups):
        n, s = (sum(g[i] for g in groups) for i in (0, 1))
        mu = min(max(s / n, 1e-6), 1 - 1e-6)
        between = (sum(g[1] ** 2 / g[0] for g in groups) - n * mu * mu - (len(groups) - 1) * mu * (1 - mu)) / max(1e-9, n - sum(g[0] ** 2 for g in groups) / n)
        return min(max(mu * (1 - mu) / max(between, 1e-9) - 1, 2.0), 1e4), mu

    for t, rate in zip(("low", "toxic"), model.rate, strict=True):
        own = {r["doc_id"]: 1 / (1 + math.exp(-(r["__ev"][t] + math.log(rate / (1 - rate))))) for r in rows}
        hosts, paths = {}, {}
        for r in rows:
            for groups, key in ((hosts, r["host"]), (paths, (r["host"], r["section"]))):
                n, total = groups.get(key, (0, 0.0))
                groups[key] = (n + 1, total + own[r["doc_id"]])
        (m, mu), (k, _) = moments(list(hosts.values())), moments(list(paths.values()))
        for r in rows:
            x, (hn, hs), (n, total) = own[r["doc_id"]], hosts[r["host"]], paths[r["host"], r["section"]]
            prior = (total - x + k * (hs - x + m * mu) / (hn - 1 + m)) / (n - 1 + k)
            prior = min(max(prior, 1e-6), 1 - 1e-6)
            want = 1 / (1 + math.exp(-(r["__ev"][t] + math.log(prior / (1 - prior)))))
            assert got[r["doc_id"]][f"p_{t}"] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_model_looks_up_what_it_holds_alone():
    model = quality.QualityModel([{"idiot": 1.0, "réeu~": 2.0, "#words0": 0.5}, {"achli~": 1.0}], [0.0, 0.0], [(1.0, 0.0)] * 2, [0.1, 0.1])
    for text in ("Idiot réeuxpa", "achlichkeit und", "", None, "nothing here"):
        assert model.known(text) & set().union(*model.ratios) == quality.features_of(text) & set().union(*model.ratios)


def test_word_beginnings_are_features():
    found = quality.features_of("Straße straßen")
    assert {"straße", "straßen", "stra~", "straß~", "straße~", "straßen~"} <= found
    assert not any(f.endswith("~") for f in quality.features_of("a bc"))
