"""Archived dictionaries with their terms, types replaced in storage, figures that a write gives by the way."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import archive, cleaning, ingest
from lodestrata.plans import lifecycle
from lodestrata.sources import publish

SF = "/root/testdata/sf0.001"
TERM = "org_id string, type string, standard_term string, aliases array<string>"


def rows(df):
    return sorted((r["org_id"], r["type"], r["standard_term"], tuple(r["aliases"] or ())) for r in df.collect())


def test_import_archive_prune_and_roll_back(spark):
    """Eight imports; each kept version reads as it was, older ones are refused, a version gone back to reads as it was too."""
    snapshots = [[("", "a", f"t{i}", [f"x{i % k}"] if i % 2 else []) for i in range(12) if (i + k) % 4] for k in range(1, 9)]
    stored = spark.createDataFrame([("", "other", "kept", []), ("org", "a", "own", [])], TERM)
    store = spark.createDataFrame([], TERM + ", begin_no long, end_no long")
    versions = spark.createDataFrame([], "org_id string, type string, version_no long, note string")
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  as a stored table
    for k, snapshot in enumerate(snapshots, 1):
        new = spark.createDataFrame(snapshot, TERM).drop("org_id")
        stored, store, versions = map(cut, archive.imported(stored, store, versions, new, ""))
        read = archive.as_of(store, versions)
        for v in range(max(1, k - 4), k + 1):
            assert rows(read.where(F.col("version_no") == v)) == sorted((o, t, s, tuple(a)) for o, t, s, a in snapshots[v - 1])
    assert rows(stored) == sorted([*((o, t, s, tuple(a)) for o, t, s, a in snapshots[-1]), ("", "other", "kept", ()), ("org", "a", "own", ())])
    listed = {r["version_no"]: (r["term_count"], r["snapshot_present"]) for r in archive.listed(store, versions).collect()}
    assert listed == {v: (len(snapshots[v - 1]), True) if v > 3 else (0, False) for v in range(1, 9)}
    assert store.where("end_no <= 4").isEmpty() and store.count() < sum(map(len, snapshots[3:]))
    for gone in (3, 99):
        with pytest.raises(ValueError, match="no snapshot"):
            archive.rolled_back(store, versions, "", "a", gone)
    back = archive.rolled_back(store, versions, "", "a", 5)
    stored, store, versions = archive.imported(stored, store, versions, back.drop("org_id"), "")
    want = sorted((o, t, s, tuple(a)) for o, t, s, a in snapshots[4])
    assert [r for r in rows(stored) if r[:2] == ("", "a")] == want and rows(archive.as_of(store, versions).where("version_no = 9")) == want


def test_history_equals_step_by_step(spark):
    snapshots = [("", t, f"s{i}", [], v) for t in "ab" for v in range(1, 6) for i in range(8) if (i + v) % 3]
    whole = spark.createDataFrame(snapshots, TERM + ", version_no long")
    store, versions = spark.createDataFrame([], TERM + ", begin_no long, end_no long"), spark.createDataFrame([], "org_id string, type string, version_no long")
    for v in range(1, 6):
        store, versions = (spark.createDataFrame(x.collect(), x.schema) for x in archive.archived(store, versions, whole.where(F.col("version_no") == v)))
    key = lambda df: sorted((r["type"], r["standard_term"], r["begin_no"], r["end_no"] or 0) for r in df.collect())
    assert key(store) == key(archive.history(whole))


def test_only_types_that_differ_are_written(spark, tmp_path):
    path = f"{tmp_path}/dictionary"
    files = lambda: {k: sorted(p.name for p in Path(path).glob(f"type={k}/*.parquet")) for k in "abc"}
    frame = lambda entries: spark.createDataFrame(entries, "type string, standard_term string, aliases array<string>")
    first = [("a", "x", ["1", "2"]), ("a", "y", []), ("b", "z", []), ("c", "w", [])]
    assert publish.publish(frame(first), path) == ["a", "b", "c"]
    before = files()
    assert publish.publish(frame([("a", "y", []), ("a", "x", ["2", "1"]), ("b", "z", ["new"])]), path) == ["b"]
    after = files()
    assert before["a"] == after["a"] and before["c"] == after["c"] and before["b"] != after["b"]
    assert sorted((r["type"], r["standard_term"], len(r["aliases"])) for r in publish.stored(spark, path).collect()) == [("a", "x", 2), ("a", "y", 0), ("b", "z", 1), ("c", "w", 0)]
    assert publish.publish(frame(first[:2]), path) == []


def test_a_write_gives_its_figures(spark, tmp_path):
    checked = ingest.checked(ingest.mapped(lifecycle._cells(spark, SF)))
    rows_, figures = ingest.observed(checked)
    rows_.write.parquet(f"{tmp_path}/rows")
    assert figures.get == ingest.summary(checked).first().asDict()
    actions = lifecycle._actions(spark, SF, skip=True)
    rows_, figures = cleaning.observed(actions)
    rows_.select("id", "action").write.parquet(f"{tmp_path}/actions")
    want = {r["action"]: (r["n"], r["repaired"], r["cleared"]) for r in cleaning.counts(actions).collect()}
    assert {a: tuple(figures.get[f"{a}_{k}"] for k in ("n", "repaired", "cleared")) for a in cleaning.ACTIONS if figures.get[f"{a}_n"]} == want


def test_limit_over_blocks_of_a_file(spark):
    data = spark.createDataFrame([(f, i, None) for f in ("b", "a") for i in range(0, 50, 2)], "file string, row long, reason string").repartition(4)
    got = {(r["file"], r["row"]): r["reason"] for r in ingest.limited(data, most=30, block=8).collect()}
    order = sorted(got)
    assert [got[k] for k in order] == [None] * 30 + [ingest.TOO_MANY] * 20
