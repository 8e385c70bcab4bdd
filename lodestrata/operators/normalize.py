"""Term normalisation: a dictionary join with exact, containment and set-similarity steps."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import chars, dice, edge_stripped, multiset_overlap, normalize_punctuation, polarity_only
from lodestrata.operators.lineage import cut

EXACT, CONTAIN, FUZZY = 1, 2, 3
THRESHOLD, DELTA = 0.8, 1
#: Dictionaries up to this many (word, term) rows are broadcast.
BROADCAST_ROWS = 200_000


def clean_term(c: Column) -> Column:
    return edge_stripped(normalize_punctuation(F.trim(c)))


def owned_words(terms: DataFrame) -> DataFrame:
    """type, word and standard term; is_term tells terms from aliases (type, standard_term, aliases)."""
    own = F.array(F.struct(F.col("standard_term").alias("word"), F.lit(True).alias("is_term")))
    aliases = F.transform("aliases", lambda a: F.struct(a.alias("word"), F.lit(False).alias("is_term")))
    rows = terms.select("type", "standard_term", F.explode(F.concat(own, aliases)).alias("w"))
    return rows.select("type", "standard_term", "w.word", "w.is_term").where("word <> ''").distinct()


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rarest(words: DataFrame, counts: DataFrame, text: str, share: float) -> DataFrame:
    """words (type and a text) by the rarest distinct characters of the text, as many as must hold one that a similar text has among its own."""
    n, w = F.size("__chars"), Window.partitionBy("type", text).orderBy(F.coalesce("f", F.lit(0)), "ch")
    rows = words.select("*", F.array_distinct(chars(F.col(text))).alias("__chars")).select("*", n.alias("n"), F.explode("__chars").alias("ch")).drop("__chars")
    ranked = rows.join(_bounded(counts), ["type", "ch"], "left").withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).drop("rn", "f")


def judge(inputs: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, delta: int = DELTA) -> DataFrame:
    """The best dictionary term of every distinct (type, input): level 1 exact, 2 contained, 3 similar, 0 none.

    Distinct inputs alone are joined, always by equal keys. Exact: the input. Contained: what is left of the input
    without up to delta characters at its ends. Similar: the rarest characters of both sides (a prefix filter: two
    texts that reach the threshold share one of them), for texts whose numbers of characters can reach it at all.
    Ties: shortest, then first term in order.
    """
    words = owned_words(terms)
    wanted = cut(inputs.select("type", "input").where("input is not null").distinct())
    x, w, t = F.col("input"), F.col("word"), F.col("standard_term")
    exact = wanted.withColumn("word", x).join(_bounded(words), ["type", "word"]).select("type", "input", "standard_term", F.lit(EXACT).alias("level"), F.when(F.col("is_term"), 0).otherwise(1).cast("double").alias("order"))
    rest = wanted.join(exact.select("type", "input").distinct(), ["type", "input"], "left_anti").where(F.length("input") >= 2)
    ends = [(a, b) for a in range(delta + 1) for b in range(delta + 1 - a) if a + b]
    shorter = rest.select("type", "input", F.explode(F.array(*(F.substring(x, F.lit(a + 1), F.length(x) - (a + b)) for a, b in ends))).alias("word")).where("word <> ''")
    inside = shorter.join(_bounded(words), ["type", "word"]).where(F.col("is_term") | (F.length(w) >= 2)).select("type", "input", "standard_term", F.lit(CONTAIN).alias("level"), F.lit(0.0).alias("order"))
    standard = terms.select("type", "standard_term").distinct()
    counts = standard.select("type", F.explode(F.array_distinct(chars(t))).alias("ch")).groupBy("type", "ch").agg(F.count("*").alias("f"))
    share = threshold / (2 - threshold)
    entry = _rarest(standard, counts, "standard_term", share).withColumnRenamed("n", "m")
    size = F.col("n") * share <= F.col("m") + 1e-9
    met = _rarest(rest, counts, "input", share).join(entry, ["type", "ch"]).where(size & (F.col("m") * share <= F.col("n") + 1e-9)).select("type", "input", "standard_term").distinct()
    similar = F.when(~(x.contains(t) | t.contains(x)) & ~polarity_only(x, t), dice(x, t))
    fuzzy = met.withColumn("similar", similar).where(F.col("similar") >= threshold).select("type", "input", "standard_term", F.lit(FUZZY).alias("level"), (-F.col("similar")).alias("order"))
    every = exact.unionByName(inside).unionByName(fuzzy)
    best = F.min(F.struct("level", "order", F.length("standard_term").alias("l"), "standard_term")).alias("b")
    top = every.groupBy("type", "input").agg(best).select("type", "input", "b.standard_term", "b.level")
    return wanted.join(top, ["type", "input"], "left").select("type", "input", "standard_term", F.coalesce("level", F.lit(0)).alias("level"))


def normalized(entities: DataFrame, terms: DataFrame, negated: Column | None = None, keep_negated: bool = False) -> DataFrame:
    """entities (type, content, ...) with term and level.

    Negated terms that only contain an entry are dropped, or kept as they are where keep_negated is set.
    """
    hits = judge(entities.select("type", F.col("content").alias("input")), terms).withColumnRenamed("input", "content")
    out = entities.join(hits, ["type", "content"], "left")
    if negated is not None:
        bad = negated & (F.col("level") == CONTAIN)
        if not keep_negated:
            out = out.where(~F.coalesce(bad, F.lit(False)))
        else:
            out = out.withColumn("standard_term", F.when(~bad, F.col("standard_term"))).withColumn("level", F.when(bad, 0).otherwise(F.col("level")))
    return out.withColumn("term", F.coalesce("standard_term", "content")).drop("standard_term")


def stripped_match(inputs: DataFrame, terms: DataFrame, prefixes: tuple[str, ...], suffixes: tuple[str, ...], block: str = "") -> DataFrame:
    """Inputs (type, input) that are a term or alias once one prefix, one suffix or both are off; none with a blocking character."""
    begins, ends = f"^(?:{'|'.join(prefixes)})", f"(?:{'|'.join(suffixes)})$"
    x = F.col("input")
    rows = inputs.select("type", "input").distinct()
    rows = rows.where(~x.rlike(f"[{block}]")) if block else rows
    bodies = F.array(F.regexp_replace(F.regexp_replace(x, begins, ""), ends, ""), F.regexp_replace(x, begins, ""), F.regexp_replace(x, ends, ""))
    body = rows.select("type", "input", F.posexplode(bodies).alias("order", "word")).where((F.col("word") != x) & (F.length("word") > 0))
    met = body.join(_bounded(owned_words(terms)), ["type", "word"])
    return met.groupBy("type", "input").agg(F.min(F.struct("order", F.when(F.col("is_term"), 0).otherwise(1).alias("alias"), "standard_term"))["standard_term"].alias("standard_term"))


def rerouted_types(entities: DataFrame, terms: DataFrame, moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """entities (id, type, content) with the type that they belong to: the first type on their list in which they are a term or alias.

    An entity that its own type knows stays. moves: type to the types that are tried, in order.
    """
    known = owned_words(terms).select("type", F.col("word").alias("content")).distinct()
    order = F.coalesce(*(F.when((F.col("from") == t) & (F.col("type") == u), k) for t, to in moves.items() for k, u in enumerate((t, *to))))
    wanted = entities.select(F.col("type").alias("from"), "content").where(F.col("from").isin(*moves)).distinct()
    best = wanted.join(_bounded(known), "content").withColumn("k", order).where("k is not null").groupBy("from", "content").agg(F.min(F.struct("k", "type"))["type"].alias("to"))
    out = entities.join(best.withColumnRenamed("from", "type"), ["type", "content"], "left")
    return out.withColumn("moved", F.coalesce(F.col("to") != F.col("type"), F.lit(False))).withColumn("type", F.coalesce("to", "type")).drop("to")


def without_fragments(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """entities (type, content) without single characters that the type's dictionary doesn't have."""
    one = owned_words(terms).where(F.length("word") == 1).select("type", F.col("word").alias("content")).distinct()
    short = entities.where(F.length("content") == 1).join(_bounded(one), ["type", "content"], "left_semi")
    return entities.where(F.length("content") > 1).unionByName(short)


def backfilled(entities: DataFrame, raw: DataFrame, terms: DataFrame) -> DataFrame:
    """entities (id, type, content, level) with terms that the raw text (id, type, text) of records holds, unless all of a type are normalised.

    Entities without a level that are part of a found term give way to it.
    """
    entities = cut(entities)
    state = entities.groupBy("id", "type").agg(F.every(F.coalesce("level", F.lit(0)) > 0).alias("done"))
    open_rows = raw.join(state, ["id", "type"], "left").where(~F.coalesce("done", F.lit(False))).drop("done")
    found = scan(open_rows.select(F.struct("id", "type").alias("id"), "text"), terms).where(F.col("id.type") == F.col("type")).select("id.id", "type", F.col("standard_term").alias("content"))
    new = found.join(entities.select("id", "type", "content"), ["id", "type", "content"], "left_anti").withColumn("level", F.lit(EXACT))
    hits = found.groupBy("id", "type").agg(F.collect_set("content").alias("hits"))
    kept = entities.join(hits, ["id", "type"], "left")
    part = F.exists(F.coalesce("hits", F.array().cast("array<string>")), lambda h: h.contains(F.col("content")) & (h != F.col("content")))
    kept = kept.where(~(part & (F.coalesce("level", F.lit(0)) == 0))).drop("hits")
    return kept.unionByName(new.select(*kept.columns))


def herb_entities(herbs: DataFrame, terms: DataFrame, reset: bool = False) -> DataFrame:
    """herbs (id, name, raw, dosage) with their standard name and level; dosages are trimmed and lower-cased. reset: a miss takes the raw name."""
    herbs = cut(herbs)
    hits = judge(herbs.select(F.lit("herb").alias("type"), F.col("name").alias("input")), terms).select(F.col("input").alias("name"), "standard_term", "level")
    miss = F.coalesce("raw", "name") if reset else F.col("name")
    out = herbs.join(hits, "name", "left")
    return out.select("id", F.coalesce("standard_term", miss).alias("name"), F.lower(F.trim("dosage")).alias("dosage"), F.coalesce("level", F.lit(0)).alias("level"))


def impact(inputs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """What a dictionary change does to each distinct (type, input): gained, lost, changed or same, with both levels; suspect where the new term is under half as long."""
    a = judge(inputs, old).select("type", "input", F.col("standard_term").alias("before"), F.col("level").alias("old_level"))
    b = judge(inputs, new).select("type", "input", F.col("standard_term").alias("after"), F.col("level").alias("new_level"))
    both = a.join(b, ["type", "input"], "full_outer")
    change = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "gained").when(F.col("after").isNull() & F.col("before").isNotNull(), "lost").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return both.withColumn("change", change).withColumn("suspect", F.coalesce(2 * F.length("after") < F.length("input"), F.lit(False)))


def suggestion_text(suggestions: DataFrame) -> DataFrame:
    """One line for each (type, input) with its candidates in order (rn)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "standard_term"))), lambda x: x["standard_term"])
    return suggestions.groupBy("type", "input").agg(F.concat(F.col("input"), F.lit("："), F.array_join(listed, "、")).alias("text"))


def _scanned(texts: DataFrame, owned: list[tuple[str, str, str]]) -> DataFrame:
    """id, type, standard_term and word of all words in texts (id, text), by an automaton over a dictionary of bounded size that each task builds."""
    id_type = texts.schema["id"]
    schema = T.StructType([id_type, *(T.StructField(n, T.StringType()) for n in ("type", "standard_term", "word"))])
    shared = texts.sparkSession.sparkContext.broadcast(owned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, columns = ahocorasick.Automaton(), list(zip(*shared.value, strict=True))
        owners: dict[str, list[int]] = {}
        for k, word in enumerate(columns[2]):
            owners.setdefault(word, []).append(k)
        for word, own in owners.items():
            found.add_word(word, own)
        found.make_automaton()
        arrays = [pa.array(c) for c in columns]
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                mine = sorted({k for _, own in found.iter(text) for k in own if columns[1][k] != text})
                at += [i] * len(mine)
                hits += mine
            rows = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(a.take(rows) for a in arrays)], ["id", "type", "standard_term", "word"])

    return texts.where("text is not null").select("id", "text").mapInArrow(run, schema)


def scan(texts: DataFrame, terms: DataFrame, words: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """Standard terms whose words a text (id, text) contains, except a term that is the whole text; with `words`, the words too.

    A dictionary of up to `most` words is an automaton that reads each text once, so rows follow hits and not the
    texts' length; with a larger one the texts meet it by the first two characters of each word.
    """
    owned = owned_words(terms).where(F.length("word") >= 2).select("type", "standard_term", "word")
    few = owned.limit(most + 1).collect()
    met = _by_heads(texts, owned) if len(few) > most or not few else _scanned(texts, [tuple(r) for r in few])
    return met.select("id", "type", "standard_term", *(["word"] if words else [])).distinct()


def _by_heads(texts: DataFrame, owned: DataFrame) -> DataFrame:
    """The same by a join of equal first characters."""
    owned = owned.withColumn("head", F.substring("word", 1, 2))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2))))
    placed = texts.where("text is not null").select("id", "text", F.explode(heads).alias("head"))
    return placed.join(_bounded(owned), "head").where(F.col("text").contains(F.col("word")) & (F.col("standard_term") != F.col("text"))).select("id", "type", "standard_term", "word")


def _tokens(text: str) -> Column:
    """The characters of a text, each with the number of its like before it: common tokens are common characters, each as often as both have it."""
    ordered = F.array_sort(chars(F.col(text)))
    return F.transform(ordered, lambda c, i: F.concat(c, (i + 1 - F.array_position(ordered, c)).cast("string")))


def _in_order(texts: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """texts (type, text) and their tokens that some term has, rarest first."""
    rows = texts.select("type", text, F.explode(_tokens(text)).alias("token")).join(_bounded(counts), ["type", "token"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: x["token"])
    return rows.groupBy("type", text).agg(listed.alias(f"{text}_tokens"))


def suggestion_candidates(inputs: DataFrame, terms: DataFrame, least: int = 2, top: int = 5, seeds: int = 16) -> DataFrame:
    """Pairs (type, input, standard_term, overlap) that hold each distinct input's `top` terms by common characters, at least `least`.

    A bound comes first: the longest terms of every token, `seeds` of them, are met, and the top-th best overlap of an
    input with them, if they are so many, can't be too high. A term that reaches the bound has its first common token, in one
    order from rare to frequent, where both sides have enough tokens left to reach it, so only such places are joined
    and frequent characters are not. Each pair comes once, by its first common token. Nothing that reaches the bound
    is left out.
    """
    known = terms.select("type", "standard_term").where("standard_term is not null").distinct()
    owned = known.select("type", "standard_term", F.explode(_tokens("standard_term")).alias("token"))
    counts = owned.groupBy("type", "token").agg(F.count("*").alias("f"))
    by_length = F.row_number().over(Window.partitionBy("type", "token").orderBy(F.desc(F.length("standard_term")), "standard_term"))
    longest = owned.withColumn("rn", by_length).where(F.col("rn") <= max(seeds, top)).groupBy("type", "token").agg(F.collect_list("standard_term").alias("longest"))
    asked = _in_order(inputs.select("type", "input").where("input is not null").distinct(), "input", counts)
    held = _in_order(known, "standard_term", counts)
    first = asked.select("type", "input", F.explode("input_tokens").alias("token")).join(_bounded(longest), ["type", "token"])
    first = first.groupBy("type", "input").agg(F.array_distinct(F.flatten(F.collect_list("longest"))).alias("first"))
    best = F.slice(F.sort_array(F.transform("first", lambda t: multiset_overlap(F.col("input"), t)), asc=False), 1, top)
    bound = first.select("type", "input", best.alias("b")).select("type", "input", F.greatest(F.lit(least), F.when(F.size("b") == top, F.element_at("b", -1))).alias("bound"))
    n, m = F.size("input_tokens"), F.size("standard_term_tokens")
    x = asked.join(bound, ["type", "input"]).select("*", F.posexplode("input_tokens").alias("i", "token")).where(n - F.col("i") >= F.col("bound"))
    t = held.select("*", F.posexplode("standard_term_tokens").alias("j", "token")).where(m - F.col("j") >= least)
    met = x.join(_bounded(t), ["type", "token"]).where(m - F.col("j") >= F.col("bound"))
    both = F.array_intersect("input_tokens", "standard_term_tokens")
    pairs = met.select("type", "input", "standard_term", "token", "bound", both.alias("both")).where(F.col("both")[0] == F.col("token"))
    return pairs.select("type", "input", "standard_term", F.size("both").alias("overlap"), "bound")


def suggest(inputs: DataFrame, terms: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """The terms that share most characters with each distinct input (type, input), at least `least`; ties by term."""
    reached = suggestion_candidates(inputs, terms, least, top).where(F.col("overlap") >= F.col("bound")).drop("bound")
    rank = F.row_number().over(Window.partitionBy("type", "input").orderBy(F.desc("overlap"), "standard_term"))
    return reached.withColumn("rn", rank).where(F.col("rn") <= top)
