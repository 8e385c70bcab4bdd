"""Decomposition of terms: the rules' own cases, brute force over all splits, and lists normalised end to end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import decompose, normalize
from lodestrata.operators import entities as ent
from lodestrata.operators.normalize import owned_words
from lodestrata.plans import documents, views

SF = "/root/testdata/sf0.001"
TERMS = "type string, standard_term string, aliases array<string>"
PULSE = ["左寸", "左关", "左尺", "右寸", "右关", "右尺", *("脉" + q for q in ("浮", "沉", "弱", "弦", "细", "涩", "缓", "滑", "数", "虚细", "弦细"))]
TONGUE = {"舌淡": [], "舌红": [], "舌淡红": [], "薄苔": ["苔薄"], "白腻苔": ["苔白腻"], "白苔": ["苔白"], "薄白苔": ["苔薄白"], "尖红": ["舌尖红"], "苔少": ["少苔"], "齿痕舌": ["齿痕", "齿印"], "舌红点": ["红点"]}
SYMPTOM = {**dict.fromkeys(("口干", "腹痛", "腹胀", "便溏", "汗出", "流涎", "喷嚏", "咳嗽", "干呕", "血块", "心悸", "有痰"), []), "恶寒": ["怕冷"], "夜尿频": ["夜尿"]}
PATTERN = ["太阴", "阳明", "少阳", "厥阴", "风湿", "郁热", "气虚", "血瘀", "脾虚"]
ROWS = [("pulse", t, []) for t in PULSE] + [("tongue", t, a) for t, a in TONGUE.items()] + [("symptom", t, a) for t, a in SYMPTOM.items()] + [("pattern", t, []) for t in PATTERN]
CASES = {
    "pulse": "左关偏浮=左关 脉浮|左尺稍弱=左尺 脉弱|脉细涩=脉细 脉涩|脉弦细数=脉弦细 脉数|右寸关缓滑=右寸 脉缓 脉滑|双寸关略浮尺略沉=脉浮 脉沉|脉欠流利=|左寸沉痛=|右寸后关前浮=右寸 脉浮|关后略沉=脉沉|寸后关前略浮=脉浮|两寸后关前偏浮=脉浮|右尺应指=右尺|左略涩=脉涩|双上略浮下略沉=脉浮 脉沉|左寸沉=左寸 脉沉|脉仍略沉=脉沉|脉尚弦=脉弦|脉弦带滑=脉弦 脉滑|沉取不受按=脉沉|左关略旺=|脉弦有力=|脉不滑=|浮=|脉浮浮=脉浮",
    "tongue": "舌淡苔薄=舌淡 薄苔|舌红苔白腻=舌红 白腻苔|舌淡红尖红=舌淡红 尖红|尖红较甚=尖红|边有齿痕=齿痕舌|边有齿印=齿痕舌|尖有红点=舌红点|边尖红=尖红|苔白底浮黄=|舌淡苔薄白腻满布=|齿痕较深=",
    "symptom": "晨起口干=口干|便前腹痛=腹痛|夜寐汗出=汗出|晨起喷嚏较多=喷嚏|连声咳嗽=咳嗽|刷牙干呕=干呕|寐时流涎=流涎|有少量血块=血块|汗出彻全身=汗出|汗出一般=汗出|有时口干=口干|肛门瘙痒=|全身乏力=|腹胀便溏=腹胀 便溏|无明显口干=|口干已除=|腰部冷痛=|夜尿气味重=|怕冷便溏=恶寒 便溏|口干口干=",
    "pattern": "太阴阳明风湿郁热=太阴 阳明 风湿 郁热|阳明少阳=阳明 少阳|气虚血瘀=气虚 血瘀|阳明兼少阳=阳明 少阳|厥阴兼太阴=厥阴 太阴|少阳及阳明风湿=少阳 阳明 风湿|厥阴为主=厥阴|厥阴为主已除=|里证兼表=|太阴不定=",
    "disease": "口腔溃疡=|太阴阳明=", "herb": "当归=",
}


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(ROWS, TERMS)


def test_rules_own_cases(spark, terms):
    want = {(k, c.split("=")[0]): c.split("=")[1].split() for k, cases in CASES.items() for c in cases.split("|")}
    inputs = spark.createDataFrame([*want, ("pulse", None), ("tongue", ""), ("symptom", " 晨起口干。")], "type string, input string")
    got = {(r["type"], r["input"]): r["parts"] for r in decompose.decomposed(inputs, terms).collect()}
    assert got.pop(("symptom", " 晨起口干。")) == ["口干"]
    assert got == {k: v for k, v in want.items() if v}


def fewest(t, words, skip):
    """Best of all splits: fewest pieces, then the longer word at the first place that differs, then no skip."""
    if not t:
        return ((), (), False)
    best = None
    options = [(len(w), s) for w, s in words.items() if t.startswith(w)] + ([(1, None)] if t[0] in skip else [])
    for n, std in options:
        rest = fewest(t[n:], words, skip)
        if rest is not None:
            found = ((0 if std is None else -n, *rest[0]), ((std, *rest[1]) if std else rest[1]), std is None or rest[2])
            if best is None or (len(found[0]), found[0]) < (len(best[0]), best[0]):
                best = found
    return best


def test_fewest_parts_by_brute_force(spark):
    """All splits of random texts, among them those where the longest word at each place leads nowhere."""
    rng = random.Random(7)
    words = {"甲乙": "甲乙", "甲乙丙": "甲乙丙", "丙丁": "丙丁", "丁甲乙丙丁丙丁": "长词", "乙丙": "x", "丁丁": "y", "丙丙丙": "x"}
    texts = {"".join(rng.choice("甲乙丙丁、") for _ in range(rng.randint(1, 9))) for _ in range(600)} | {"甲乙丙丁", "丁甲乙丙丁丙丁甲乙", "", "甲乙"}
    rows = [("w", t, []) for t in ("甲乙", "甲乙丙", "丙丁")] + [("w", "长词", ["丁甲乙丙丁丙丁"]), ("w", "x", ["乙丙", "丙丙丙"]), ("w", "y", ["丁丁"])]
    found = decompose.covered(spark.createDataFrame([("w", t) for t in texts] + [("w", None), ("v", "甲乙丙丁")], "type string, input string"), spark.createDataFrame(rows, TERMS), skip="、")
    got = {r["input"]: r["parts"] for r in found.collect()}
    want = {}
    for t in texts:
        best = fewest(t, words, "、")
        if best and t:
            parts = list(dict.fromkeys(best[1]))
            if len(parts) >= 2 or (parts and best[2]):
                want[t] = parts
    assert got == want and got["甲乙丙丁"] == ["甲乙", "丙丁"]


ENTITY = "id long, field string, type string, pos int, content string, source_text string, norm_level int"


def test_whole_chain(spark, terms):
    rows = [
        (1, "pulseList", "pulse", 0, "左关偏浮", "左关偏浮", None), (1, "tongueList", "tongue", 0, "舌淡苔薄", None, None), (2, "pulseList", "pulse", 0, "脉细涩", "脉细涩", None),
        (3, "symptoms", "symptom", 0, "无口干", None, None), (3, "symptoms", "symptom", 1, "怕冷", "怕冷", None), (3, "symptoms", "symptom", 2, "很怕冷", "恶寒", 2), (3, "symptoms", "symptom", 3, "不知道", "头晕", 1),
        (3, "symptoms", "symptom", 4, "别的", None, None), (3, "symptoms", "symptom", 5, " ", "", None), (4, "diseases", "disease", 0, "感冒", "感冒病", 2), (4, "diseases", "disease", 1, "湿疮", "湿疹", None), (5, "symptoms", "symptom", 0, "大口干", None, None),
        (6, "pulseList", "pulse", 0, "左关偏浮", None, None), (6, "pulseList", "pulse", 1, "左关", "左关", None),
    ]
    frame = spark.createDataFrame(rows, ENTITY)
    key = lambda r: (r[0], r[1], r[2], r[3])
    got = sorted((tuple(r)[:7] for r in decompose.normalized_lists(frame, terms, decompose.DECOMPOSABLE).collect()), key=key)
    assert got == [
        (1, "pulseList", 0, 0, "左关", "左关偏浮", 1), (1, "pulseList", 0, 1, "脉浮", "左关偏浮", 1), (1, "tongueList", 0, 0, "舌淡", "舌淡苔薄", 1), (1, "tongueList", 0, 1, "薄苔", "舌淡苔薄", 1),
        (2, "pulseList", 0, 0, "脉细", "脉细涩", 1), (2, "pulseList", 0, 1, "脉涩", "脉细涩", 1),
        (3, "symptoms", 1, 0, "恶寒", "怕冷", 1), (3, "symptoms", 3, 0, "头晕", "头晕", None), (3, "symptoms", 4, 0, "别的", "别的", None),
        (4, "diseases", 0, 0, "感冒病", "感冒病", None), (4, "diseases", 1, 0, "湿疮", "湿疹", None), (5, "symptoms", 0, 0, "口干", "大口干", 2),
        (6, "pulseList", 0, 0, "左关", "左关偏浮", 1), (6, "pulseList", 0, 1, "脉浮", "左关偏浮", 1),
    ]
    clean = {key(r): tuple(r)[4:7] for r in decompose.normalized_lists(frame, terms, decompose.DECOMPOSABLE, cleaning=True).collect()}
    assert clean[1, "pulseList", 0, 0] == ("左关偏浮", "左关偏浮", None) and clean[3, "symptoms", 0, 0] == ("无口干", "无口干", None)
    assert clean[2, "pulseList", 0, 0] == ("脉细", "脉细涩", 2) and clean[4, "diseases", 1, 0] == ("湿疹", "湿疹", None) and len(clean) == 12
    again = decompose.normalized_lists(decompose.normalized_lists(frame, terms, decompose.DECOMPOSABLE, cleaning=True).join(frame.select("field", "type").distinct(), "field").withColumnRenamed("term", "content"), terms, decompose.DECOMPOSABLE, cleaning=True)
    assert {tuple(r)[:2] + tuple(r)[4:7] for r in again.collect()} == {k[:2] + v for k, v in clean.items()}


def plain_decompose(kind, text, words, known):
    """decomposed() of one text: words of the type (two characters or more), known: all of them."""
    if len(text) < 2 or kind not in decompose.DECOMPOSABLE or (kind in ("symptom", "pattern") and set(text) & set(decompose.BLOCK)):
        return []
    if kind == "pulse":
        out, i = [], 0
        while i < len(text):
            rest = text[i:]
            if phrase := next((p for p in decompose.PULSE_SKIP if rest.startswith(p)), None):
                i += len(phrase)
            elif len(rest) > 1 and rest[0] in "左右" and rest[1] in "寸关尺":
                out.append(rest[:2])
                i += 2
            elif len(rest) > 1 and rest[0] in "双两" and rest[1] in "寸关尺":
                i += 2
            elif rest[0] in "寸关尺":
                i += 1
            elif rest[0] in decompose.PULSE_BLOCK:
                return []
            elif rest[0] in decompose.PULSE_RELATION + decompose.PULSE_MODIFIERS:
                i += 1
            else:
                run = next((k for k, ch in enumerate(rest) if ch not in decompose.PULSE_QUALITY), len(rest))
                hit = next((k for k in range(run, 0, -1) if "脉" + rest[:k] in known), 0)
                if not hit:
                    return []
                out.append("脉" + rest[:hit])
                i += hit
        return list(dict.fromkeys(out))
    best = fewest(text, words, {"tongue": decompose.TONGUE_SKIP, "pattern": decompose.PATTERN_SKIP}.get(kind, ""))
    parts = list(dict.fromkeys(best[1])) if best else []
    if len(parts) >= 2 or (kind == "tongue" and parts and best[2]):
        return parts
    off = lambda t, ws, end: next((t[: -len(w)] if end else t[len(w) :] for w in ws if len(t) > len(w) and (t.endswith(w) if end else t.startswith(w))), None)
    bodies = []
    if kind == "symptom":
        front = off(text, decompose.SYMPTOM_PREFIX, False)
        bodies = [(off(front, decompose.SYMPTOM_SUFFIX, True) or front) if front else off(text, decompose.SYMPTOM_SUFFIX, True)]
    elif kind == "pattern":
        bodies = [off(text, (w,), True) for w in decompose.PATTERN_SUFFIX]
    return next(([known[b]] for b in bodies if b in known), [])


def dictionary(terms):
    own = {}
    for kind, word, std, is_term in sorted(((r["type"], r["word"], r["standard_term"], r["is_term"]) for r in owned_words(terms).collect()), key=lambda r: (not r[3], r[2])):
        own.setdefault(kind, {}).setdefault(word, std)
    return own


def test_composites_by_brute_force(spark):
    terms = documents._terms(spark, SF)
    own = dictionary(terms)
    want = {}
    for r in documents._composites(spark, SF).collect():
        known = own.get(r["type"], {})
        if parts := plain_decompose(r["type"], r["input"], {w: s for w, s in known.items() if len(w) > 1}, known):
            want[r["type"], r["input"]] = ",".join(parts)
    got = {(r["type"], r["input"]): r["parts"] for r in documents.decomposed_terms(spark, SF).collect()}
    assert got == want and len(got) > 10


def test_chain_by_brute_force(spark):
    """Every list of the charts, entity by entity, with judge() and plain_decompose() for each."""
    terms = documents._terms(spark, SF)
    own = dictionary(terms)
    rows = ent.exploded(views.charts(spark, SF)).collect()
    raws = {(r["kind"], r["source_text"] or r["term"]) for r in rows if r["source_text"] or r["term"]}
    judged = {(r["type"], r["input"]): (r["standard_term"], r["level"]) for r in normalize.judge(spark.createDataFrame([k for k in raws if k[0] in documents.TYPES], "type string, input string"), terms).collect()}
    negated = {r["t"] for r in spark.createDataFrame([(t,) for _, t in raws], "t string").where(text.negated_context(F.col("t"))).collect()}
    lists = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["field"], r["pos"])):
        kind, raw = r["kind"], r["source_text"] or r["term"]
        if not raw:
            continue
        own_term = raw if r["norm_level"] is not None else r["term"] or raw
        std, level = judged.get((kind, raw), (None, None))
        no = level == 2 and raw in negated
        parts = plain_decompose(kind, raw, {w: s for w, s in own.get(kind, {}).items() if len(w) > 1}, own.get(kind, {})) if level == 0 or (level == 2 and not no) else []
        made = [(p, 1) for p in parts] or ([(own_term, None)] if not level else [] if no else [(std, level)])
        for k, (term, lv) in enumerate(made):
            lists.setdefault((r["id"], r["field"], term), []).append((-len(raw), lv or 4, r["pos"], k, raw, lv))
    want = set()
    for (i, f, term), many in lists.items():
        best, first = min(many), min((p, k) for _, _, p, k, _, _ in many)
        want.add((i, f, *first, term, best[4], best[5]))
    got = documents.normalize_chain(spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 1000


def test_no_rows(spark, terms):
    assert not decompose.decomposed(spark.createDataFrame([], "type string, input string"), terms).collect()
    assert not decompose.normalized_lists(spark.createDataFrame([], ENTITY).withColumn("extra", F.lit(1)), terms, decompose.DECOMPOSABLE).collect()


def test_scan_by_automaton_and_by_join(spark):
    """Both ways find what a plain search finds; ids of any type, overlapping words, a term that is the whole text."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("甲乙丙丁 戊") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["甲乙丙", None, "甲乙"]
    rows = [("a", "甲乙", ["乙丙丁"]), ("a", "甲乙丙", ["甲"]), ("b", "丙丁", ["甲乙"]), ("b", "戊戊戊", ["丁 戊", ""])]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select(F.struct("n", F.lit("x").alias("y")).alias("id"), "text")
    words = [(k, std, w) for k, std, aliases in rows for w in (std, *aliases) if len(w) > 1]
    want = {(i, k, std, w) for i, t in enumerate(texts) if t for k, std, w in words if w in t and std != t}
    for most in (normalize.BROADCAST_ROWS, 2):
        got = normalize.scan(frame, spark.createDataFrame(rows, TERMS), words=True, most=most).collect()
        assert {(r["id"]["n"], r["type"], r["standard_term"], r["word"]) for r in got} == want and len(got) == len(want)
    assert not normalize.scan(frame, spark.createDataFrame([], TERMS)).collect()
