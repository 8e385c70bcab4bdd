"""Entities read off free text by patterns: tongue, pulse, causes, treatment and herbs; what is no entity; misplaced ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import negated, quoted
from lodestrata.operators.report import MISTYPE_MARKERS, PROCESS_LEAD, contains_any, starts_with

# Words and shapes of the extraction rules.
SEGMENT = r"[，。、；;\s]+"
INSIDE = r"[^，。、；;\s]"
TONGUE = r"^[舌苔](?!藓)[^，。、；;\s]{1,8}$"
TONGUE_MORPH = "边有|有裂纹|有瘀点|有瘀|有芒刺|剥苔|无苔|少苔"
TONGUE_HEADS, PULSE_HEADS = ("尖", "根", "苔", "边", "齿痕"), ("尺", "寸", "关")
OTHER_DOMAIN = ("关节", "尺肤", "苔藓", "尖锐", "脉下")
SKIN = "苔藓"
COMPOUND_PULSES = ("动惕", "动剔", "弦滑", "浮滑", "浮数")
CAUSES = ("风寒", "风热", "暑湿", "风湿", "湿热", "寒湿", "气虚", "血虚", "阴虚", "阳虚", "情志", "劳倦", "外伤", "痰", "瘀", "外感")
TREATMENT = r"治[以法则宜][^，。；;\s]{1,10}"
HERB_DOSE = r"(?:^|[，,、;；。\s（(])([\x{4e00}-\x{9fff}]{2,6})\s*(\d+(?:\.\d+)?\s*(?:g|克))"
INQUIRY = ("睡眠", "醒后", "排便", "纳食", "进食", "胃口", "饮食", "喜饮", "喜卧", "俯卧", "仰卧", "侧卧", "面黄", "面白", "面萎黄")
NO_INQUIRY = ("便血", "便脓", "便后", "小便痛", "小便涩")
NON_HERB = (
    "甘油三", "胆红", "胆固醇", "肌酐", "尿酸", "尿素", "葡萄糖", "血小板", "谷草", "谷丙转氨", "血红蛋白", "白细胞", "红细胞", "血糖", "血脂", "总蛋白", "白蛋白", "球蛋白", "转氨酶", "尿素氮", "血沉", "血常规", "血常", "潜血", "间胆", "总胆", "总胆汁酸", "甘胆酸", "糖化血红蛋", "血清",
    "扁桃", "淋巴", "甲状腺", "脂肪肝", "肝内",
    "胡萝卜", "苹果", "花菜", "空心菜",
)
NO_HERB = (
    "蛋白", "细胞", "抗原", "抗体", "片段", "细菌", "病毒", "基因", "激素", "免疫", "检验", "检查", "结果", "报告", "医院", "大学", "学院", "研究院", "研究所", "中心", "妇保", "门诊", "科内", "系列", *NON_HERB,
)
PROVINCES = ("北京", "上海", "天津", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "广西", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "内蒙古", "新疆", "西藏", "宁夏", "香港", "澳门", "台湾")
NOISE_WORDS, NOISE_ENDS = ("反复发作", "反复出现", "无明显异常", "无特殊"), ("为主", "消失", "好转", "达全身")
CHANNELS = ("太阳", "阳明", "少阳", "太阴", "少阴", "厥阴")
LONGER_THAN_ONE = ("symptoms", "diseases", "patternList", "causeList", "treatmentList")
CJK = r"[\x{4e00}-\x{9fff}]"


def segments(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEGMENT), lambda s: s != "")


def _ours(seg: Column, heads: tuple[str, ...]) -> Column:
    return starts_with(seg, heads) & ~starts_with(seg, OTHER_DOMAIN)


def tongue(text: Column) -> Column:
    """Segments that describe the tongue, without a leading "or"."""
    shaped = lambda s: s.rlike(TONGUE) | s.rlike(f"^或?({TONGUE_MORPH})")
    named = lambda s: s.rlike(f"^{CJK}{{1,8}}$") & _ours(s, TONGUE_HEADS)
    found = F.filter(segments(text), lambda s: shaped(s) | named(s))
    return F.transform(found, lambda s: F.when(shaped(s), F.regexp_replace(s, "^或", "")).otherwise(s))


def pulse(text: Column) -> Column:
    """Segments that describe the pulse, then bare positions, then positions with a side; each of the latter once."""
    segs = segments(text)
    whole = F.filter(segs, lambda s: s.rlike(f"^脉{INSIDE}{{1,6}}$"))
    bare = F.filter(segs, lambda s: s.rlike(f"^{CJK}{{2,6}}$") & _ours(s, PULSE_HEADS))
    placed = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?:左|右)(?:寸|关|尺){INSIDE}{{0,4}}"), F.lit(0))
    return F.concat(whole, F.array_except(F.concat(bare, placed), whole))


def causes(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, CAUSES)), lambda w: F.coalesce(text, F.lit("")).contains(w))


def treatments(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TREATMENT), F.lit(0))


def plausible_herb(name: Column) -> Column:
    """Two to five Chinese characters without a word of the laboratory, the clinic, the body, the table or a province."""
    name = F.trim(name)
    return name.rlike(f"^{CJK}{{2,5}}$") & ~contains_any(name, NO_HERB) & ~starts_with(name, PROVINCES)


def herbs(text: Column) -> Column:
    """name and dosage of plausible herbs with a dose, the first of each name."""
    text = F.coalesce(text, F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(HERB_DOSE), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(HERB_DOSE), F.lit(2)).alias("dosage"))
    good = F.filter(both, lambda h: plausible_herb(h["name"]))
    names = F.array_distinct(F.transform(good, lambda h: h["name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(good, lambda h: h["name"] == n), 1))


def extracted(df: DataFrame, text: str) -> DataFrame:
    """df's rows (id, text) as entities: id, field, pos, term and dosage, by all rules in one projection."""
    t = F.col(text)
    plain = lambda a: F.transform(a, lambda x: F.struct(x.alias("term"), F.lit(None).cast("string").alias("dosage")))
    lists = [("tongueList", plain(tongue(t))), ("pulseList", plain(pulse(t))), ("causeList", plain(causes(t))), ("treatmentList", plain(treatments(t))), ("herbs", F.transform(herbs(t), lambda h: F.struct(h["name"].alias("term"), h["dosage"].alias("dosage"))))]
    rows = df.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), e.alias("elements")) for f, e in lists))).alias("l"))
    return rows.select("id", "l.field", F.posexplode("l.elements").alias("pos", "e")).select("id", "field", "pos", "e.term", "e.dosage")


def _core(term: Column) -> Column:
    return F.regexp_replace(term, "^[左右双两]", "")


def is_pulse_or_tongue(term: Column) -> Column:
    """A pulse or tongue element, whether or not it names the pulse or tongue; one word of side may come before."""
    core = _core(term)
    named = starts_with(core, ("脉", "舌")) | (starts_with(core, (*PULSE_HEADS, "尖", "根", "苔")) & term.rlike(f"^{CJK}+$"))
    return ~starts_with(term, OTHER_DOMAIN) & ~starts_with(core, OTHER_DOMAIN) & (named | term.isin(*COMPOUND_PULSES))


def is_tongue(term: Column) -> Column:
    """Whether a pulse or tongue element is one of the tongue."""
    return starts_with(_core(term), ("舌", "尖", "根", "苔"))


def rerouted(entities: DataFrame) -> DataFrame:
    """entities (id, field, pos, term) with pulse and tongue elements and inquiry phrases moved out of the symptoms.

    A moved one that its new list already has, or that came before, is not repeated; inquiry phrases are kept each.
    """
    term, symptom = F.col("term"), F.col("field") == "symptoms"
    inquiry = starts_with(term, INQUIRY) & ~starts_with(term, NO_INQUIRY)
    to = F.when(symptom & is_pulse_or_tongue(term), F.when(is_tongue(term), "tongueList").otherwise("pulseList")).when(symptom & inquiry, "inquiry").otherwise(F.col("field"))
    rows = entities.withColumn("to", F.when(term.isNotNull(), to).otherwise(F.col("field"))).withColumn("moved", F.col("to") != F.col("field"))
    once = rows.withColumn("rn", F.row_number().over(Window.partitionBy("id", "to", "term").orderBy("moved", "pos"))).where(~F.col("moved") | (F.col("to") == "inquiry") | (F.col("rn") == 1))
    return once.select("id", F.col("to").alias("field"), "moved", "pos", "term")


def with_dose(name: Column, text: Column) -> Column:
    """Whether the text has the name with a dose right behind it."""
    return F.when(text.contains(name), F.rlike(text, F.concat(quoted(name), F.lit(r"\s*\d+(\.\d+)?\s*(g|克|ml|mg)")))).otherwise(F.lit(False))


def noise_reason(field: Column, term: Column, text: Column) -> Column:
    """Why a term of a list is dropped, by the first rule that says so; null: it stays. Cut-off herbs are found by dropped_noise."""
    symptom = field == "symptoms"
    return (
        F.when(field.isin(*LONGER_THAN_ONE) & (F.length(term) < 2), "single")
        .when((field != "herbs") & negated(term, text), "negated")
        .when(symptom & (term.rlike(r"\d") | term.rlike(f"({'|'.join(NOISE_ENDS)})$") | term.isin(*NOISE_WORDS) | term.rlike(f"^{CJK}{{1,3}}(可|正常)$")), "noise")
        .when((field == "herbs") & ~plausible_herb(term), "no herb")
        .when(symptom & (contains_any(term, MISTYPE_MARKERS) | starts_with(term, PROCESS_LEAD)), "mistyped")
        .when((field == "formulaList") & (term.startswith("中草药") | (term == "中草") | term.isin(*CHANNELS)), "fragment")
    )


def dropped_noise(entities: DataFrame) -> DataFrame:
    """entities (id, field, term, text) with reason, null for those that stay.

    A herb that the text never has with a dose goes if a longer one of the record, which begins with it, has one.
    """
    rows = entities.withColumn("reason", noise_reason(F.col("field"), F.col("term"), F.col("text")))
    herb = (F.col("field") == "herbs") & F.col("reason").isNull()
    rows = rows.withColumn("__dose", F.when(herb, with_dose(F.col("term"), F.col("text"))))
    out = rows.withColumn("__dosed", F.collect_set(F.when(F.col("__dose"), F.col("term"))).over(Window.partitionBy("id")))
    longer = F.exists("__dosed", lambda n: (n != F.col("term")) & n.startswith(F.col("term")))
    short = F.coalesce(~F.col("__dose"), F.lit(False)) & (F.length("term") >= 2) & longer
    return out.withColumn("reason", F.when(short, "cut off").otherwise(F.col("reason"))).drop("__dose", "__dosed")


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping runs (id, label, begin, end, score) joined into one each: outer bounds and mean score to four places."""
    w = Window.partitionBy("id", "label").orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(before.isNull() | (F.col("begin") >= before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mean = (F.floor(F.avg("score") * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)).alias("score")
    return island.groupBy("id", "label", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), mean).drop("island")


def tagged_spans(tokens: DataFrame) -> DataFrame:
    """Runs of begin-inside tags (id, at, begin, end, tag, score): a run starts at B-, or at I- of another label than before."""
    w = Window.partitionBy("id").orderBy("at")
    label = F.when(F.col("tag") != "O", F.substring("tag", 3, 1000))
    rows = tokens.withColumn("label", label)
    starts = F.col("label").isNotNull() & (F.col("tag").startswith("B-") | ~F.col("label").eqNullSafe(F.lag("label").over(w)))
    rows = rows.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("label is not null")
    mean = (F.floor(F.avg("score") * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)).alias("score")
    return rows.groupBy("id", "run", "label").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), mean).drop("run")


def windows(text: Column, most: int = 508, overlap: int = 24) -> Column:
    """Pieces of at most `most` characters: sentences packed together as their running length tells, longer ones cut with an overlap."""
    whole = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[。；;！？!?\n])"), lambda s: s != "")
    cut = F.flatten(F.transform(whole, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - overlap), F.lit(most - overlap)), lambda i: F.substring(s, i, F.lit(most))))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate(cut, empty, lambda acc, s: F.when(F.length(acc["open"]) + F.length(s) <= most, F.struct(acc["done"].alias("done"), F.concat(acc["open"], s).alias("open"))).otherwise(F.struct(F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), s.alias("open"))))
    return F.filter(F.concat(packed["done"], F.array(packed["open"])), lambda s: s != "")
