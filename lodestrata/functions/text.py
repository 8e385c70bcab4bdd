"""Text and scalar functions as columns. Only the position-dependent ones are vectorised Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.schema import HASHED

# Characters and words of the text rules.
HALF_TO_FULL = {",": "，", ".": "。", ";": "；", ":": "：", "!": "！", "?": "？", "(": "（", ")": "）"}
NEGATIONS = "无不未莫非缺寡忌禁欠"
CURED = ("愈", "好", "干净", "退", "消", "止", "解", "除", "去")
NEG_HARD = ("无", "未", "莫", "非", "否认", "未见", "无明显", "排除")
NEG_KEEP_TAIL = "寐适安宁固化和利扬仁遂孕消佳畅眠食欲得解知足均能受育明振规思运痛调"
NEG_BOUNDARY = "。；;！？，,：:\n"
REPLACE_NEG = ("无", "未", "莫", "非", "否", "未见", "无明显", "排除", "否认")
REPLACE_KEEP_TAIL = "寐适安宁固化利扬仁遂孕消佳畅眠食欲得解知足均能受育明振规思运痛"
POLARITY = "不无未否欠除减"
EDGE = "，。、；：！？,.;:!? \t"
SPACING = "，。；：！？、（）"
COLLAPSIBLE = "，。；：！？、"


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; blank is null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c != "", c)


def month_of(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def percent(part: Column, total: Column) -> Column:
    """part / total in per cent with one decimal, half up; 0 where total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.floor(part.cast("double") * F.lit(1000.0) / total.cast("double") + F.lit(0.5)).cast("double") / F.lit(10.0))


def text_hash(columns: tuple[str, ...] = HASHED) -> Column:
    """MD5 of length-prefixed trimmed values: neighbours cannot run together. Null is empty."""

    def part(name: str) -> Column:
        v = F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))
        return F.concat(F.length(v).cast("string"), F.lit(":"), v, F.lit(";"))

    return F.md5(F.concat(*map(part, columns)).cast("binary"))


def mask_pii(c: Column) -> Column:
    """Mobile numbers and identity numbers become ***."""
    phones = F.regexp_replace(c, r"(?<!\d)1[3-9]\d{9}(?!\d)", "***")
    return F.regexp_replace(phones, r"(?<!\d)\d{17}[\dXx](?!\d)", "***")


def digits_template(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "N")


def code_fence_stripped(c: Column) -> Column:
    """The inside of a text that is one fenced block."""
    t = F.trim(c)
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))).otherwise(t)


def edge_stripped(c: Column) -> Column:
    """Without punctuation and blanks at both ends."""
    return F.btrim(c, F.lit(EDGE))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def dice(a: Column, b: Column) -> Column:
    """Twice the common distinct characters over both numbers of distinct characters."""
    x, y = F.array_distinct(chars(a)), F.array_distinct(chars(b))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, F.size(F.array_intersect(x, y)) * F.lit(2.0) / total).otherwise(F.lit(0.0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common characters, each as often as both texts have it."""

    def times(text: Column, ch: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, ch, F.lit("")))

    both = F.transform(F.array_distinct(chars(a)), lambda ch: F.least(times(a, ch), times(b, ch)))
    return F.aggregate(both, F.lit(0), lambda s, v: s + v)


def polarity_only(a: Column, b: Column) -> Column:
    """Whether the texts differ by one negating character alone."""
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)

    def dropped(i: Column) -> Column:
        without = F.concat(F.substring(long, F.lit(1), i - 1), F.substring(long, i + 1, F.length(long)))
        return (without == short) & F.lit(POLARITY).contains(F.substring(long, i, F.lit(1)))

    return (F.length(long) - F.length(short) == 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(long), F.lit(1))), dropped)


def negated_context(c: Column) -> Column:
    """Whether a term's source text negates it or tells that it is over."""
    return F.coalesce(c.rlike(f"[{NEGATIONS}]") | c.rlike(f"^[^已]*已({'|'.join(CURED)})"), F.lit(False))


def add_workdays(day: Column, n: int) -> Column:
    """The n-th day after `day` that is no Saturday or Sunday."""
    span = F.sequence(F.date_add(day, 1), F.date_add(day, n + 2 * (n // 5 + 1)))
    return F.element_at(F.filter(span, lambda d: ~F.dayofweek(d).isin(1, 7)), n)


def number_text(c: Column) -> Column:
    """A number as a spreadsheet shows it: whole numbers without a point."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def lenient_int(c: Column) -> Column:
    """Text as a number cut to an integer; null if it is none."""
    return F.trim(c).try_cast("double").try_cast("int")


def normalized_datetime(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss from the date forms that occur; null if the text is none of them."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, "T", " "), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[年月/.]", "-"), "日", ""), r"-(?=\s|$)", "")
    compact = F.when(t.rlike(r"^\d{8}$|^\d{12}$|^\d{14}$"), F.rpad(t, 14, "0"))
    spelled = F.regexp_extract(t, r"^\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}(?::\d{1,2}(?::\d{1,2})?)?)?", 0)
    parsed = F.coalesce(F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.nullif(spelled, F.lit("")), F.lit("yyyy-M-d[ H[:m[:s]]]")))
    return parsed.cast("timestamp_ntz")


def _is_cjk(ch: str) -> bool:
    return "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿"


def punctuation_of(text: str | None) -> str | None:
    """Half-width punctuation beside Chinese text becomes full-width; blanks around it go; repeats collapse."""
    if not text:
        return text
    near, before = [False] * len(text), False
    for order in (range(len(text)), range(len(text) - 1, -1, -1)):
        before = False
        for i in order:
            near[i] |= before
            if text[i] not in " \t\r\n":
                before = _is_cjk(text[i])
    out: list[str] = []
    for i, ch in enumerate(text):
        if ch in HALF_TO_FULL and (near[i] or (i and text[i - 1] in HALF_TO_FULL)):
            ch = HALF_TO_FULL[ch]
        if ch in SPACING:
            while out and out[-1] in " \t":
                out.pop()
        elif ch in " \t" and out and out[-1] in SPACING:
            continue
        if not (ch in COLLAPSIBLE and out and out[-1] == ch):
            out.append(ch)
    return "".join(out)


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def negating(clause: Column, words: tuple[str, ...] = NEG_HARD, tail: str = NEG_KEEP_TAIL) -> Column:
    """Whether a clause has a negating word, or a 不 while no 不 of it stands before a normative character."""
    return clause.rlike(_any_of(words)) | (clause.contains("不") & ~clause.rlike(f"不[{tail}]"))


def quoted(c: Column) -> Column:
    """A pattern that matches a text as it is, whatever it holds."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def negated(span: Column, text: Column, window: int = 30) -> Column:
    """Whether a term negates itself, or a text has it and negates it wherever it does.

    The clause before each place, up to `window` characters, is read by a look-behind; places may overlap. It is read
    only where the text has a term that doesn't negate itself.
    """
    term, whole = F.trim(F.coalesce(span, F.lit(""))), F.coalesce(text, F.lit(""))
    inside = f"[^{NEG_BOUNDARY}]"
    place = F.concat(F.lit(f"(?<=((?:^|[{NEG_BOUNDARY}]){inside}{{0,{window}}}|{inside}{{{window}}}))(?="), quoted(term), F.lit(")"))
    there = F.forall(F.regexp_extract_all(whole, place, F.lit(1)), lambda clause: negating(clause))
    return F.when(term == "", F.lit(False)).when(negating(term), F.lit(True)).when(whole.contains(term), there).otherwise(F.lit(False))


def replaced_text(text: str | None, pairs: dict[str, str], window: int = 8) -> str | None:
    """Leftmost-longest replacement of terms of two characters or more by their standard form, except where the clause before negates them."""
    terms = sorted((k for k in pairs if len(k) >= 2), key=lambda k: (-len(k), k))
    if not text or not terms:
        return text
    negates = re.compile(f"(?:{_any_of(REPLACE_NEG)}|不(?![{REPLACE_KEEP_TAIL}]))[^{NEG_BOUNDARY}]*$")

    def standard(m: re.Match) -> str:
        return m[0] if negates.search(text[max(0, m.start() - window) : m.start()]) else pairs[m[0]]

    return re.sub(_any_of(tuple(map(re.escape, terms))), standard, text)


@F.pandas_udf(T.StringType())
def normalize_punctuation(text: pd.Series) -> pd.Series:
    return text.map(punctuation_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def safe_replace(text: pd.Series, pairs: pd.Series) -> pd.Series:
    """pairs: map of source text to standard term, as a map column."""
    return pd.Series([replaced_text(t, dict(p or {})) for t, p in zip(text, pairs, strict=True)])


def cut(c: Column, n: int) -> Column:
    """Trimmed text of at most n characters."""
    return F.substring(F.trim(c), 1, n)


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8, or as GBK where they are none (built-in decoding knows no GBK)."""

    def text(raw: bytes) -> str:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("gbk", "replace")

    return content.map(lambda raw: text(bytes(raw)), na_action="ignore")


def first_filled(*columns: Column | str, most: int = 40) -> Column:
    """The first column that isn't blank, cut to `most` characters with an ellipsis."""
    text = F.coalesce(*map(blank_to_null, columns))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def composed(*columns: Column | str) -> Column:
    """All filled columns, each ended by a full stop."""
    parts = F.array_compact(F.array(*map(blank_to_null, columns)))
    return F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("。"))), "")


def trim_change(c: Column | str) -> Column:
    """What trimming does to a value: "kept", "trimmed", or "cleared" where only blanks were there."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (F.trim(c) == c) & (c != ""), "kept").when(F.trim(c) == "", "cleared").otherwise("trimmed")
