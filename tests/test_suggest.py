"""Suggestions against all pairs, and how few pairs the bound leaves."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestrata.operators import dictionary, normalize


def overlap(a: str, b: str) -> int:
    return sum((Counter(a) & Counter(b)).values())


def best(inputs, terms, least: int, top: int) -> set[tuple]:
    """Every input against every term of its type."""
    out = set()
    for kind, x in {r for r in inputs if r[1] is not None}:
        met = sorted((-n, t.encode()) for k, t in {r for r in terms if r[1] is not None} if k == kind and (n := overlap(x, t)) >= least)
        out |= {(kind, x, t.decode(), -n, i + 1) for i, (n, t) in enumerate(met[:top])}
    return out


def rows(df) -> set[tuple]:
    return {(r["type"], r["input"], r["standard_term"], r["overlap"], r["rn"]) for r in df.collect()}


@pytest.mark.parametrize("least, top", [(2, 5), (1, 3), (3, 1)])
def test_suggestions_of_texts_with_ties(spark, least, top):
    """Few characters, so most terms tie; nulls, empty, repeated and unknown texts."""
    r = random.Random(1)
    terms = [("ab"[i % 2], "".join(r.choice("aabbcdefgh无苔😀1") for _ in range(r.randint(1, 12)))) for i in range(300)] + [("a", None), ("a", "")] + [("a", "苔苔苔")] * 3
    asked = [(t, "".join(r.choice("aabbcdefghxy苔😀11") for _ in range(r.randint(0, 9)))) for t in "abc" for _ in range(25)] + [("a", None), ("a", ""), ("b", "zzz"), ("a", terms[4][1]), ("a", terms[4][1])]
    inputs, known = spark.createDataFrame(asked, "type string, input string"), spark.createDataFrame(terms, "type string, standard_term string")
    assert rows(normalize.suggest(inputs, known, least, top)) == best(asked, terms, least, top)


@pytest.mark.parametrize("syllables", [False, True])
def test_few_pairs_are_looked_at(spark, syllables):
    """Of terms of random characters or syllables, a third with one more in common: under a tenth of all pairs are
    candidates, and under 3 in 10 of those that share a character."""
    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(600)]
    units = ["".join(r.choices(letters, k=2)) for _ in range(250)] if syllables else letters
    weight = [1 / (i + 8) for i in range(len(units))]
    word = lambda: "".join(r.choices(units, weight, k=r.randint(1, 4) if syllables else r.randint(2, 8))) + ("病" if r.random() < 0.34 else "")
    terms = [("d", word()) for _ in range(3000)]
    near = lambda t: t[: r.randint(0, len(t))] + r.choice(letters) + t[r.randint(0, len(t)) :]
    asked = [("d", near(r.choice(terms)[1])) for _ in range(150)] + [("d", word()) for _ in range(50)]
    inputs, known = spark.createDataFrame(asked, "type string, input string"), spark.createDataFrame(terms, "type string, standard_term string")
    assert rows(normalize.suggest(inputs, known)) == best(asked, terms, 2, 5)
    met = sum(bool(set(x) & set(t)) for _, x in set(asked) for _, t in set(terms))
    looked = normalize.suggestion_candidates(inputs, known).count()
    assert looked < len(set(asked)) * len(set(terms)) / 10 and looked < 0.3 * met


def test_no_terms_or_inputs(spark):
    none, one = spark.createDataFrame([], "type string, input string"), spark.createDataFrame([("a", "xx")], "type string, input string")
    terms = spark.createDataFrame([("a", "xxx")], "type string, standard_term string")
    assert normalize.suggest(none, terms).count() == 0 and normalize.suggest(one, terms.where("type is null")).count() == 0
    assert rows(normalize.suggest(one, terms)) == {("a", "xx", "xxx", 2, 1)}


def test_version_of_all_types_or_of_those_given(spark):
    v = spark.createDataFrame([("", "b", "11111111x"), ("o", "b", "22222222x"), ("", "a", "33333333x"), ("z", "a", "44444444x")], "org_id string, type string, version string")
    text = lambda *a: dictionary.version_string(v, "o", *a).first()["version"]
    assert text() == "a:33333333;b:22222222;" and text(("b", "c")) == "b:22222222;" and text(("b", "a")) == "b:22222222;a:33333333;"


def test_tongue_segments(spark):
    from pyspark.sql import functions as F

    from lodestrata.operators import extraction

    df = spark.createDataFrame([("苔藓样皮疹，苔薄白，舌红，或有裂纹，舌，苔藓",)], "t string")
    assert df.select(extraction.tongue(F.col("t")).alias("x")).first()["x"] == ["苔薄白", "舌红", "有裂纹"]
