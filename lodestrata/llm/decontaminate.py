"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import hidden, lower_ascii, stored, tidy, work_dir

WINDOW = 10
#: Tables of terms up to this many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """Words of a text after A-Z are lower-cased: runs of digits, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK, -1), "")


def _bounded(terms: DataFrame) -> DataFrame:
    """A hint to broadcast a table of terms, behind a check of its size."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms


def _doc_key():
    """Equal rows share a key and the same matches; the identifier and a hash of the text tell others apart."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("__id"), F.xxhash64("text").alias("__h")]


def items_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct items with words: item_id as a string, words, and n, the window's words (fewer for a short item)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("words"))
    return rows.where(F.size("words") > 0).distinct().withColumn("n", F.least(F.size("words"), F.lit(window))).withColumn("item", F.xxhash64("item_id", "words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms is in the whole corpus."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return words.join(_bounded(terms), "term").groupBy("term").agg(F.count("*").alias("df"))


def anchors_of(items: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest places of every window that can occur: item, place, term, and how many must match (need).

    A window with a term that the corpus lacks cannot occur. Windows that share their rarest places give them
    once, so the table is a few rows for each item.
    """
    placed = items.select("item", "n", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))
    placed = placed.join(counts, "term", "left")
    starts = placed.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("n") + 1), F.least(F.col("place"), F.col("size") - F.col("n")))).alias("start"))
    window = Window.partitionBy("item", "start")
    rarest = starts.withColumn("known", F.count("df").over(window)).where("known = n").withColumn("rank", F.row_number().over(window.orderBy("df", "place")))
    return rarest.where("rank <= 2").select("item", "place", "term", F.least("n", F.lit(2)).alias("need")).distinct()


def postings_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, document key and position, for every occurrence of the terms in the corpus."""
    placed = docs.select(*_doc_key(), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return placed.join(_bounded(terms), "term").select("term", "__id", "__h", "pos")


def alignments(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Offset-adjusted intersection of the rarest lists: document key, item and shift (document place minus item place).

    Only shifts at which enough rare places of the item agree are left.
    """
    shifted = postings.join(_bounded(anchors), "term").select("__id", "__h", "item", "need", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = shifted.groupBy("__id", "__h", "item", "shift", "need").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return met.where((F.col("need") == 1) | (F.col("a") < F.col("b"))).select("__id", "__h", "item", "shift")


def rare_terms(items: DataFrame, counts: DataFrame, most: int = 4, least: int = 3) -> DataFrame:
    """The rarest terms of every window of an item, of those that the corpus has: item, term, and how many must meet (need).

    A window with terms that the corpus lacks still has its others. No item needs more terms than it has.
    """
    placed = items.select("item", "n", F.size("words").alias("size"), F.size(F.array_distinct("words")).alias("own"), F.posexplode("words").alias("place", "term")).join(counts, "term")
    starts = placed.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("n") + 1), F.least(F.col("place"), F.col("size") - F.col("n")))).alias("start"))
    ranked = starts.select("item", "own", "start", "term", "df").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("item", "start").orderBy("df", "term")))
    return ranked.where(F.col("rank") <= most).select("item", "term", F.least("own", F.lit(least)).alias("need")).distinct()


def near(postings: DataFrame, terms: DataFrame, span: int = 50) -> DataFrame:
    """Proximity matches: document key and item of which `need` different rare terms are within `span` places of the document."""
    hits = postings.join(_bounded(terms), "term")
    ahead = Window.partitionBy("__id", "__h", "item").orderBy("pos").rangeBetween(0, span - 1)
    met = hits.select("__id", "__h", "item", "need", F.size(F.collect_set("term").over(ahead)).alias("terms"))
    return met.where(F.col("terms") >= F.col("need")).select("__id", "__h", "item").distinct()


def proximity(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = 50, least: int = 3) -> DataFrame:
    """docs (any columns) plus near: the sorted ids of items whose rare terms meet in the text, altered copies among them.

    It is wider than an exact match and says that a text should be looked at; matches() says what is a copy.
    """
    folder = work_dir(spark, "proximity")
    docs, names = hidden(docs)
    items = stored(items_of(benchmark, window), folder + "/items")
    counts = stored(term_counts(docs, items.select(F.explode("words").alias("term")).distinct()), folder + "/counts")
    terms = stored(rare_terms(items, counts, least=least), folder + "/terms")
    found = near(postings_of(docs, terms.select("term").distinct()), terms, span).join(_bounded(items.select("item", "item_id")), "item")
    by_doc = found.groupBy("__id", "__h").agg(F.array_sort(F.collect_set("item_id")).alias("__near"))
    out = docs.select("*", *_doc_key()).join(by_doc, ["__id", "__h"], "left")
    return tidy(out, folder).select(*(c for c in docs.columns if c != "near"), F.coalesce("__near", F.array().cast("array<string>")).alias("near")).withColumnsRenamed(names)


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (any columns) plus n_words, hits (sorted places of words inside an occurring window) and items (sorted ids).

    The index holds every posting of the windows' rarest terms. Shifts at which they agree are compared word by
    word with the item. A null text has no words; an item without words matches nothing; equal rows match alike;
    an empty benchmark leaves every document without hits; no documents give no rows. Columns that are named
    n_words, hits or items before are replaced.
    """
    folder = work_dir(spark, "decontaminate")
    docs, names = hidden(docs)
    items = stored(items_of(benchmark, window), folder + "/items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    counts = stored(term_counts(docs, terms), folder + "/counts")
    anchors = stored(anchors_of(items, counts), folder + "/anchors")
    postings = stored(postings_of(docs, anchors.select("term").distinct()), folder + "/postings")
    # Shifts of an item are gathered first; its words then join once for each document that has it (by broadcast
    # or shuffle, as their count tells), so a document's row grows with its places and items, not with both at once.
    found = alignments(postings, anchors).groupBy("__id", "__h", "item").agg(F.collect_list("shift").alias("shifts")).join(_bounded(items), "item")
    by_doc = found.groupBy("__id", "__h").agg(F.collect_list(F.struct("item_id", "shifts", "words", "n")).alias("__found"))

    keyed = docs.select("*", *_doc_key()).join(by_doc, ["__id", "__h"], "left").withColumn("__words", words_of(F.col("text")))

    def agreed(c, shift):
        """Places where the item's windows that are all there at this shift begin."""
        same = F.transform(c["words"], lambda w, i: F.get(F.col("__words"), shift + i).eqNullSafe(w))
        starts = F.sequence(F.lit(0), F.size(c["words"]) - c["n"])
        # The comparison is bound once, in an array of one, and not made again for each start.
        once = F.transform(F.array(same), lambda m: F.filter(starts, lambda s: F.forall(F.slice(m, s + 1, c["n"]), lambda x: x)))
        return F.transform(F.element_at(once, 1), lambda s: s + shift)

    checked = F.transform(F.col("__found"), lambda c: F.struct(c["item_id"].alias("item_id"), c["n"].alias("n"), F.flatten(F.transform(c["shifts"], lambda x: agreed(c, x))).alias("begins")))
    checked = F.filter(checked, lambda c: F.size(c["begins"]) > 0)
    out = keyed.withColumn("__ok", F.when(F.col("__found").isNotNull(), checked).otherwise(F.array()))
    places = F.flatten(F.transform("__ok", lambda c: F.flatten(F.transform(c["begins"], lambda s: F.sequence(s, s + c["n"] - 1)))))
    return tidy(out, folder).select(
        *(c for c in docs.columns if c not in ("n_words", "hits", "items")),
        F.size("__words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(places)).alias("hits"),
        F.array_sort(F.array_distinct(F.transform("__ok", lambda c: c["item_id"]))).alias("items"),
    ).withColumnsRenamed(names)
