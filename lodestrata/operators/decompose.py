"""Composite terms taken apart into dictionary terms that cover them from end to end, and whole lists normalised by it.

Words of a dictionary are found at their places in distinct inputs by equal keys alone; what covers an input is then
worked out in one expression over its places, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null, negated_context
from lodestrata.operators.entities import representatives
from lodestrata.operators.lineage import cut
from lodestrata.operators.normalize import CONTAIN, EXACT, _bounded, clean_term, judge, owned_words

# Characters and words of the decomposition rules.
PULSE_MODIFIERS = "偏略稍较微甚尤仍尚"
PULSE_BLOCK = "不无未否欠除减乏兼"
PULSE_RELATION = "脉前后中上及取双两左右下带"
PULSE_SKIP = ("不受按", "不受", "按之", "应指", "按")
PULSE_QUALITY = "浮沉迟数虚实滑涩弦紧细濡微弱洪大促结代疾动牢革散伏长短缓芤旺软小"
PULSE_SIDES, PULSE_BOTH, PULSE_PLACES = "左右", "双两", "寸关尺"
TONGUE_SKIP = "偏略稍较微甚尤质边有部根尖内外前后中底满布仍尚体面"
SYMPTOM_PREFIX = (
    "活动后", "运动后", "劳累后", "晨起", "晨间", "清晨", "夜间", "夜里", "夜寐", "睡前", "醒后", "夜醒", "饭后", "食后", "进食后", "便前", "便后", "经前", "经期", "经后", "平素", "平时", "近日", "近期", "偶有", "时有", "反复", "持续",
    "自觉", "稍有", "稍感", "略有", "轻微", "明显", "连声", "刷牙", "寐时", "蹲起时", "挠抓后", "天热", "有时", "夏季", "冬季", "春季", "秋季", "有少量", "少量",
)
SYMPTOM_SUFFIX = ("明显", "加重", "较多", "较少", "偶有", "反复", "时作", "频作", "不已", "不止", "难忍", "彻全身", "可以下达", "可下达", "一般", "黄染", "湿衣", "作咳")
BLOCK = "不无未否欠除减"
PATTERN_SKIP = "兼夹及为和、，,主略偏稍较甚尤微"
PATTERN_SUFFIX = ("为主兼证", "为主兼", "为主症", "为主证", "偏盛", "为主")
DECOMPOSABLE = ("pulse", "tongue", "symptom", "pattern")
#: Substrings up to this many characters are probed whole; a longer word is met by its first ones.
PROBE = 6


def surfaces(terms: DataFrame) -> DataFrame:
    """One standard term for each (type, word): the term itself before one that has it as an alias, then the first in order."""
    best = F.min(F.struct((~F.col("is_term")).alias("alias"), "standard_term"))["standard_term"]
    return owned_words(terms).groupBy("type", "word").agg(best.alias("standard_term"))


def placed_words(inputs: DataFrame, words: DataFrame, probe: int = PROBE) -> DataFrame:
    """Where words (type, word, standard_term) of two characters or more stand in inputs (type, input, text): at (from 1) and n, their length.

    Each substring of 2 to `probe` characters is a row that meets the words by an equal key; those of `probe`
    characters also meet longer words by their beginning.
    """
    text, length = F.col("text"), F.length("text")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(probe), length - i + 1))), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    probes = inputs.where(length >= 2).select("type", "input", "text", F.explode(spans).alias("s")).select("type", "input", "text", "s.at", F.substring(text, F.col("s.at"), F.col("s.n")).alias("key"))
    known = words.where(F.length("word") >= 2).withColumn("key", F.substring("word", 1, probe))
    met = probes.join(_bounded(known), ["type", "key"])
    size = F.length("word")
    return met.where(F.substring(text, F.col("at"), size) == F.col("word")).select("type", "input", "at", size.alias("n"), "standard_term")


def cover(text: Column, words: Column, skip: Column) -> Column:
    """The fewest words that cover a text: a struct of parts in order and skipped; null where none do.

    words: array of (at, n, standard_term). A character of `skip` may stand between words and counts as one piece;
    ties: the longer word first, a word before a skipped character. Best pieces are kept for every place, last first.
    """
    empty = F.array().cast("array<string>")
    best = "array<struct<cost:int,tie:int,parts:array<string>,skipped:boolean>>"
    start = F.array(F.struct(F.lit(0).alias("cost"), F.lit(0).alias("tie"), empty.alias("parts"), F.lit(False).alias("skipped"))).cast(best)

    def step(held: Column, i: Column) -> Column:
        here = F.filter(words, lambda w: w["at"] == i)

        def with_word(w: Column) -> Column:
            rest = F.get(held, w["n"] - 1)
            return F.when(rest["cost"].isNotNull(), F.struct((rest["cost"] + 1).alias("cost"), (-w["n"]).alias("tie"), F.concat(F.array(w["standard_term"]), rest["parts"]).alias("parts"), rest["skipped"].alias("skipped")))

        rest = F.get(held, F.lit(0))
        over = F.when(F.contains(skip, F.substring(text, i, F.lit(1))) & rest["cost"].isNotNull(), F.struct((rest["cost"] + 1).alias("cost"), F.lit(0).alias("tie"), rest["parts"].alias("parts"), F.lit(True).alias("skipped")))
        return F.concat(F.array(F.array_min(F.array_compact(F.concat(F.transform(here, with_word), F.array(over))))).cast(best), held)

    n = F.length(text)
    done = F.get(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: n + 1 - k), start, step), F.lit(0))
    return F.when((n > 0) & done["cost"].isNotNull(), F.struct(done["parts"].alias("parts"), done["skipped"].alias("skipped")))


def covered(inputs: DataFrame, terms: DataFrame, skip: str = "", least: int = 2) -> DataFrame:
    """Inputs (type, input) that terms cover from end to end, in the fewest pieces: type, input and the terms in order (parts).

    Characters of `skip` may stand between words. An input counts when at least `least` different terms, or one and
    a skipped character, cover it whole. A null or empty input counts never; repeated ones give one row.
    """
    rows = inputs.select("type", "input").where("input is not null").distinct().withColumn("text", F.col("input"))
    own = placed_words(rows, surfaces(terms)).groupBy("type", "input").agg(F.collect_list(F.struct("at", "n", "standard_term")).alias("words"))
    out = own.select("type", "input", cover(F.col("input"), F.col("words"), F.lit(skip)).alias("c"))
    parts = F.array_distinct("c.parts")
    return out.where((F.size(parts) >= least) | ((F.size(parts) >= 1) & F.col("c.skipped"))).select("type", "input", parts.alias("parts"))


def pulse_parts(text: Column, known: Column) -> Column:
    """Pulse positions and qualities of a text, read from left to right; empty where a character has no place in it.

    At each place the first rule that fits: a phrase of how the pulse is felt is passed; a position (with one side it is
    a term; bare, or of both sides, it is passed); a negating character ends all; a relation or degree is passed;
    else the longest known quality, as 脉 with the characters, is a term. known: array of such terms.
    """
    c = lambda i, k=0: F.substring(text, i + k, F.lit(1))
    is_in = lambda chars, x: (x != "") & F.lit(chars).contains(x)
    none = F.array().cast("array<string>")

    def step(s: Column, i: Column) -> Column:
        phrase = F.coalesce(*(F.when(F.substring(text, i, F.lit(len(p))) == p, F.lit(len(p))) for p in PULSE_SKIP))
        placed = is_in(PULSE_PLACES, c(i, 1))
        side = F.when(is_in(PULSE_SIDES, c(i)) & placed, F.substring(text, i, F.lit(2)))
        passed = F.when(is_in(PULSE_BOTH, c(i)) & placed, F.lit(2)).when(is_in(PULSE_PLACES, c(i)), F.lit(1))
        quality = F.filter(known, lambda w: F.substring(text, i, F.length(w) - 1) == F.substring(w, F.lit(2), F.length(w)))
        hit = F.array_max(F.transform(quality, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
        to = lambda n, term=None, ok=True: F.struct((i + n).alias("at"), (s["parts"] if term is None else F.concat(s["parts"], F.array(term))).alias("parts"), F.lit(ok).alias("ok"))
        return (
            F.when(~s["ok"] | (s["at"] > i), s)
            .when(phrase.isNotNull(), to(phrase))
            .when(side.isNotNull(), to(F.lit(2), side))
            .when(passed.isNotNull(), to(passed))
            .when(is_in(PULSE_BLOCK, c(i)), to(F.lit(1), ok=False))
            .when(is_in(PULSE_RELATION + PULSE_MODIFIERS, c(i)), to(F.lit(1)))
            .when(hit["n"].isNotNull(), to(hit["n"] - 1, hit["w"]))
            .otherwise(to(F.lit(1), ok=False))
        )

    start = F.struct(F.lit(1).alias("at"), none.alias("parts"), F.lit(True).alias("ok"))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), start, step)
    return F.when(end["ok"], F.array_distinct(end["parts"])).otherwise(none)


def _without_first(text: Column, words: tuple[str, ...], at_end: bool) -> Column:
    """The text without the first word of a list that it begins (or ends) with; null if there is none, or nothing else."""
    rest = lambda w: F.substring(text, F.lit(1), F.length(text) - len(w)) if at_end else F.substring(text, F.lit(len(w) + 1), F.length(text))
    return F.coalesce(*(F.when((text.endswith(w) if at_end else text.startswith(w)) & (F.length(text) > len(w)), rest(w)) for w in words))


def _bodies(kind: Column, text: Column) -> Column:
    """What is left of a symptom without its context, or of a pattern without each of its endings, in the order in which they are tried."""
    front = _without_first(text, SYMPTOM_PREFIX, False)
    symptom = F.coalesce(_without_first(front, SYMPTOM_SUFFIX, True), front, _without_first(text, SYMPTOM_SUFFIX, True))
    pattern = F.array(*(_without_first(text, (w,), True) for w in PATTERN_SUFFIX))
    return F.array_compact(F.when(kind == "symptom", F.array(symptom)).when(kind == "pattern", pattern))


def decomposed(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that distinct inputs (type, input) fall into: type, input and parts; inputs that can't be taken apart give no row.

    pulse: by pulse_parts(). tongue: two terms that cover it, or one beside skipped characters. symptom and pattern:
    two terms that cover it, else what is left without context, if that is a term; none with a negating character.
    Inputs are cleaned at their ends first; those of one character, of other types or null give no row. Whatever inputs
    are made of is worked out once: each rule reads the distinct inputs from where they are kept.
    """
    rows = inputs.select("type", "input").where(F.col("type").isin(*DECOMPOSABLE)).distinct().withColumn("text", clean_term(F.col("input"))).where(F.length("text") >= 2)
    rows = cut(rows.where(F.col("type").isin("pulse", "tongue") | ~F.col("text").rlike(f"[{BLOCK}]")))
    words = cut(surfaces(terms.where(F.col("type").isin(*DECOMPOSABLE))))
    kind, text = F.col("type"), F.col("text")
    skip = F.when(kind == "tongue", TONGUE_SKIP).when(kind == "pattern", PATTERN_SKIP).otherwise("")
    placed = placed_words(rows.where("type <> 'pulse'"), words).groupBy("type", "input").agg(F.collect_list(F.struct("at", "n", "standard_term")).alias("words"))
    found = rows.join(placed, ["type", "input"]).select("type", "input", cover(text, F.col("words"), skip).alias("c")).select("type", "input", F.array_distinct("c.parts").alias("parts"), "c.skipped")
    whole = found.where((F.size("parts") >= 2) | ((kind == "tongue") & (F.size("parts") >= 1) & F.col("skipped"))).select("type", "input", "parts")

    body = rows.select("type", "input", F.posexplode(_bodies(kind, text)).alias("order", "word")).join(whole.select("type", "input"), ["type", "input"], "left_anti")
    left = body.join(_bounded(words), ["type", "word"]).groupBy("type", "input").agg(F.array(F.min(F.struct("order", "standard_term"))["standard_term"]).alias("parts"))

    qualities = words.where((kind == "pulse") & F.col("word").rlike(f"^脉[{PULSE_QUALITY}]+$")).select("type", "word", F.substring("word", 2, 1).alias("ch"))
    heads = rows.where("type = 'pulse'").select("type", "input", F.explode(F.array_distinct(F.split("text", ""))).alias("ch"))
    known = heads.join(_bounded(qualities), ["type", "ch"]).groupBy("type", "input").agg(F.collect_set("word").alias("known"))
    pulses = rows.where("type = 'pulse'").join(known, ["type", "input"], "left")
    pulses = pulses.select("type", "input", pulse_parts(text, F.coalesce("known", F.array().cast("array<string>"))).alias("parts")).where(F.size("parts") > 0)
    return whole.unionByName(left).unionByName(pulses)


def normalized_lists(entities: DataFrame, terms: DataFrame, types: tuple[str, ...], cleaning: bool = False) -> DataFrame:
    """Lists of entities (id, field, type, pos, content, source_text, norm_level) normalised: id, field, pos, part, term, source_text, norm_level, best_pos.

    An entity is judged by its source text, or its content where it has none, never by what an earlier run made of it;
    each distinct (type, text) is judged once. In order: an exact or similar term takes its place; a missed one, and one
    that only contains a term and isn't negated, is taken apart where terms cover it (part counts its pieces);
    a negated one that contains a term is dropped; another that contains a term becomes it; the rest stay as they are.
    cleaning: nothing is taken apart, a negated one counts as missed and stays, and a missed one gets its source text
    back. Of entities of a list that end as one term the one with the longest source text, then the best level, stays,
    in the first one's place (best_pos is its own). Types other than `types` keep their content; entities without any text are dropped.
    """
    raw = F.coalesce(blank_to_null("source_text"), blank_to_null("content"))
    rows = entities.select("id", "field", "type", "pos", blank_to_null("content").alias("content"), "norm_level", raw.alias("raw")).where("raw is not null")
    wanted = cut(rows.where(F.col("type").isin(*types)).select("type", "raw").distinct().withColumn("input", clean_term(F.col("raw"))))
    plan = cut(wanted.join(judge(wanted.select("type", "input"), terms), ["type", "input"]))
    no = negated_context(F.col("raw")) & (F.col("level") == CONTAIN)
    one = F.array(F.struct(F.col("standard_term").alias("term"), F.col("level").alias("level")))
    none = F.array().cast("array<struct<term:string,level:int>>")
    kept = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("level")))
    if cleaning:
        plan = plan.withColumn("to", F.when((F.col("level") == 0) | no, kept).otherwise(one))
    else:
        parts = decomposed(plan.where((F.col("level") == 0) | ((F.col("level") == CONTAIN) & ~no)).select("type", "input"), terms)
        plan = plan.join(parts, ["type", "input"], "left")
        split = F.transform("parts", lambda p: F.struct(p.alias("term"), F.lit(EXACT).alias("level")))
        plan = plan.withColumn("to", F.when(F.size("parts") > 0, split).when(F.col("level") == 0, kept).when(no, none).otherwise(one))
    # What an earlier run wrote is taken back: with a level, the content is its product.
    own = F.when(F.lit(cleaning) | F.col("norm_level").isNotNull(), F.col("raw")).otherwise(F.coalesce("content", "raw"))
    met = rows.join(_bounded(plan.select("type", "raw", "to")), ["type", "raw"], "left")
    met = met.select("id", "field", "pos", own.alias("own"), "raw", F.posexplode(F.coalesce("to", kept)).alias("part", "t"))
    ends = met.select("id", "field", F.struct("pos", "part").alias("pos"), F.coalesce("t.term", "own").alias("term"), F.col("raw").alias("source_text"), F.col("t.level").alias("norm_level"))
    out = representatives(ends)
    return out.select("id", "field", "first_pos.pos", "first_pos.part", "term", "source_text", "norm_level", F.col("best_pos.pos").alias("best_pos"))

