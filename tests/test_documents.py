"""Documents written back from rows: round trips, repairs against a plain version, members that the rules don't know."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from lodestrata.operators import documents
from lodestrata.operators import entities as ent
from lodestrata.plans import views

SF = "/root/testdata/sf0.001"
ODD = [
    None, "no json", "{}", '{"symptoms":"none","other":[1,{"a":null}]}', '{"symptoms":[],"x":1.5}', '[1]', '{"symptoms":[null,"plain \\"q\\"",{"content":"头痛","extra":{"k":[1,2]}}],"tongueList":null,"_meta":{"n":1}}',
    '{"symptoms":[{"content":"脉细","score":0.25},{"content":" ","sourceText":"舌红"},"尺沉",{"content":"关节痛"},{"content":"脉细"},{"content":"脉弦"}],"pulseList":[{"content":"脉弦","id":7},"脉细"],"unknown":{"deep":[true]}}',
    '{"tongueList":[{"content":"苔藓样变","z":1},{"content":"苔白"}],"symptoms":[{"content":"痒"}]}',
]


def loaded(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text


def frame(spark):
    charts = views.charts(spark, SF).select("id", "structured_data")
    return charts.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "id long, structured_data string"))


def test_round_trip(spark):
    """Taken apart and written again without a repair, a document says what it said."""
    df = frame(spark)
    out = documents.written(df, documents.elements(df).withColumn("at", F.col("pos")))
    before, after = ({r["id"]: loaded(r["structured_data"]) for r in x.collect()} for x in (df, out))
    assert before == after and len(before) > 1000


def reroute(doc):
    """The repair on one parsed document."""
    if not isinstance(doc, dict):
        return doc
    doc = dict(doc)

    def content(e):
        if not isinstance(e, dict):
            return None
        return next((v.strip() for k in ("content", "name", "sourceText") if isinstance(v := e.get(k), str) and v.strip()), None)

    def target(c):
        core = re.sub("^[左右双两]", "", c)
        if re.match("关节|尺肤|苔藓|尖锐|脉下", c) or re.match("关节|尺肤|苔藓|尖锐|脉下", core):
            return None
        if not (re.match("[脉舌]", core) or (re.match("[尺寸关尖根苔]", core) and re.fullmatch("[一-鿿]+", c)) or c in ("动惕", "动剔", "弦滑", "浮滑", "浮数")):
            return None
        return "tongueList" if re.match("[舌尖根苔]", core) else "pulseList"

    lists = {f: doc.get(f) if isinstance(doc.get(f), list) else [] for f in ("symptoms", "tongueList", "pulseList")}
    moves = {f: [] for f in lists}
    kept = {f: [] for f in lists}
    for f, items in lists.items():
        for e in items:
            c = content(e)
            to = None if c is None else target(c) if f == "symptoms" else "symptoms" if f == "tongueList" and c.startswith("苔藓") else None
            (moves[to] if to else kept[f]).append(e)
    for f in lists:
        seen = {content(e) for e in kept[f]}
        for e in moves[f]:
            if content(e) not in seen:
                seen.add(content(e))
                kept[f].append(e)
    if any(moves.values()):
        for f in lists:
            if kept[f] or isinstance(doc.get(f), list):
                doc[f] = kept[f]
    return doc


def test_repair_by_a_plain_version_and_twice(spark):
    df = frame(spark)
    once = documents.rerouted_documents(df)
    before, after = ({r["id"]: r["structured_data"] for r in x.collect()} for x in (df, once))
    assert {k: loaded(v) for k, v in after.items()} == {k: reroute(loaded(v)) for k, v in before.items()}
    changed = {r["id"] for r in once.where("changed").collect()}
    assert -8 in changed and -9 in changed and all(before[k] == after[k] for k in before if k not in changed)
    assert not documents.rerouted_documents(once.drop("changed")).where("changed").collect()
    assert loaded(after[-8])["pulseList"] == [{"content": "脉弦", "id": 7}, "脉细", {"content": "脉细", "score": 0.25}] and loaded(after[-8])["unknown"] == {"deep": [True]}


def test_cleaned_documents_keep_what_they_do_not_know(spark):
    doc = '{"symptoms":[{"content":"x","sourceText":"头疼","confidence":0.5,"mine":[1]},{"content":"头痛","sourceText":"偏 头痛"},"头疼",{"content":" "},{"content":"未知","normLevel":3}],"herbs":[{"name":"当归","dosage":" 10G ","code":"c"}],"own":1}'
    rows = spark.createDataFrame([(1, doc, True), (2, doc, False), (3, None, True), (4, "bad", True), (5, "{}", True)], "id long, structured_data string, pick boolean")
    terms = spark.createDataFrame([("symptom", "头痛", ["头疼"]), ("herb", "当归", [])], "type string, standard_term string, aliases array<string>")
    out = documents.normalized_documents(rows, terms, ("symptom", "herb"), "v", "t", 2, F.col("pick"))
    got = {r["id"]: loaded(r["structured_data"]) for r in out.collect()}
    assert got[2] == json.loads(doc) and got[3] is None and got[4] == "bad" and got[5] == {"_meta": {"dictVersion": "v", "dictCapturedAt": "t", "dictTermCount": 2}}
    assert got[1]["own"] == 1 and got[1]["herbs"] == [{"name": "当归", "dosage": "10g", "code": "c", "sourceText": "当归", "normLevel": 1}]
    first = {"content": "头痛", "sourceText": "头疼", "normLevel": 1, "confidence": 0.5, "mine": [1]}
    assert got[1]["symptoms"] == [first, {"content": "偏 头痛", "sourceText": "偏 头痛"}, "头疼", {"content": " "}, {"content": "未知", "sourceText": "未知"}]
    again = documents.normalized_documents(out, terms, ("symptom", "herb"), "v", "t", 2, F.col("pick"))
    assert {r["id"]: loaded(r["structured_data"]) for r in again.collect()} == got


def test_empty(spark):
    none = spark.createDataFrame([], "id long, structured_data string")
    assert not documents.rerouted_documents(none).collect() and not documents.elements(none).collect()
    assert not ent.exploded(documents.written(none, documents.elements(none).withColumn("at", F.col("pos")))).collect()
