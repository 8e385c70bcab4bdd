"""Layered term dictionaries: overlay, diff, merge, versions, lint. Columns: org_id, type, standard_term, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the lint rules.
SENTENCE = "[。；;，,、]"
PHRASE = "反复发作|反复出现|(反复|发作|加重|减轻|明显|持续|多年|数次)$"
MIN_LENGTH, MAX_LENGTH = 2, 20


def clean_aliases(aliases: Column, term: Column) -> Column:
    """Trimmed, without blanks, repeats and the term itself."""
    trimmed = F.transform(aliases, lambda a: F.trim(a))
    return F.array_distinct(F.filter(trimmed, lambda a: (a != "") & (a != F.trim(term))))


def overlay(terms: DataFrame, org_id: str) -> DataFrame:
    """The effective dictionary: an organisation's entry takes the place of the base entry of the same trimmed term."""
    rows = terms.where(F.col("org_id").isin("", org_id)).withColumn("standard_term", F.trim("standard_term"))
    own = F.max(F.struct((F.col("org_id") != "").alias("own"), "aliases")).alias("best")
    return rows.groupBy("type", "standard_term").agg(own).select("type", "standard_term", F.col("best.aliases").alias("aliases"), F.col("best.own").alias("own"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, modified (another alias set) and removed terms; terms are the same up to case and blanks."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("type", F.lower(F.trim("standard_term")).alias("key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias(name))

    both = keyed(old, "before").join(keyed(new, "after"), ["type", "key"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return both.withColumn("change", change).where("change is not null").select("type", "key", "change")


def merge(*sources: DataFrame) -> DataFrame:
    """Terms of all sources with the union of their aliases."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    merged = rows.groupBy("type", F.trim("standard_term").alias("standard_term")).agg(F.flatten(F.collect_list("aliases")).alias("aliases"))
    return merged.select("type", "standard_term", F.array_sort(clean_aliases(F.col("aliases"), F.col("standard_term"))).alias("aliases"))


def collisions(terms: DataFrame, most: int = 1) -> DataFrame:
    """Words (terms or aliases) that more than `most` different standard terms of a type own."""
    words = terms.select("type", "standard_term", F.explode(F.array_union(F.array("standard_term"), "aliases")).alias("word"))
    return words.groupBy("type", "word").agg(F.count_distinct("standard_term").alias("owners")).where(F.col("owners") > most)


def lint(terms: DataFrame) -> DataFrame:
    """rule and term for everything that looks wrong (type, standard_term)."""
    term, n = F.col("standard_term"), F.length("standard_term")
    rules = F.array(
        F.when(F.array_contains("aliases", term), "self_alias"),
        F.when(term.rlike(SENTENCE) | term.rlike(PHRASE), "sentence_like"),
        F.when(n < MIN_LENGTH, "too_short"),
        F.when(n > MAX_LENGTH, "too_long"),
    )
    single = terms.select("type", "standard_term", F.explode(F.array_compact(rules)).alias("rule"))
    repeated = terms.groupBy("type", "standard_term").agg(F.count("*").alias("n")).where("n > 1").select("type", "standard_term", F.lit("duplicate_term").alias("rule"))
    shared = collisions(terms.select("type", "standard_term", "aliases"), 2).select("type", F.col("word").alias("standard_term"), F.lit("shared_alias").alias("rule"))
    return single.unionByName(repeated).unionByName(shared)


def quality(terms: DataFrame) -> DataFrame:
    """By type: terms, those with aliases, and those that are their own alias."""
    return terms.groupBy("type").agg(F.count("*").alias("terms"), F.count_if(F.size("aliases") > 0).alias("aliased"), F.count_if(F.array_contains("aliases", F.col("standard_term"))).alias("self_aliased"))


def cross_type(terms: DataFrame) -> DataFrame:
    """Terms that more than one type has."""
    return terms.groupBy("standard_term").agg(F.count_distinct("type").alias("types")).where("types > 1")


def versions(terms: DataFrame) -> DataFrame:
    """Content version of each (org_id, type): a hash of its sorted entries, whatever their order."""
    entry = F.concat(F.col("standard_term"), F.lit("\x02"), F.array_join(F.array_sort("aliases"), ","))
    return terms.groupBy("org_id", "type").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\x01").cast("binary"), 256), 1, 32).alias("version"))


def effective_counts(terms: DataFrame, org_id: str) -> DataFrame:
    """Terms by type; an organisation's own count takes the place of the base count."""
    n = terms.where(F.col("org_id").isin("", org_id)).groupBy("type").agg(F.count_if(F.col("org_id") == org_id).alias("own"), F.count_if(F.col("org_id") == "").alias("base"))
    return n.select("type", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("base")).alias("terms"))


def prune_snapshots(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """The newest versions of each (org_id, type)."""
    rank = F.row_number().over(Window.partitionBy("org_id", "type").orderBy(F.desc("version_no")))
    return snapshots.withColumn("rn", rank).where(F.col("rn") <= keep).drop("rn")


def next_version(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("org_id", "type").agg((F.coalesce(F.max("version_no"), F.lit(0)) + 1).alias("version_no"))


def guard_shrink(old: DataFrame, new: DataFrame, percent: int = 80) -> None:
    """Refuses a replacement that has less than `percent` of the entries before it."""
    before, after = old.count(), new.count()
    if after < before * percent // 100:
        raise ValueError(f"{after} terms would replace {before}")


def in_scope(terms: DataFrame, scope: str, org_id: str = "") -> DataFrame:
    """A baseline to search or export: "base", "org", or "effective" (the overlay)."""
    if scope == "effective":
        return overlay(terms, org_id).drop("own")
    return terms.where(F.col("org_id") == ("" if scope == "base" else org_id)).drop("org_id")


def search(terms: DataFrame, text: str, number: int = 1, size: int | None = 20) -> DataFrame:
    """A page of terms that hold the text in the term or an alias, whatever the case, with the total; by type and term."""
    from lodestrata.operators.filters import page, page_size

    like = text.strip().lower()
    hit = terms.where(F.lower("standard_term").contains(like) | F.exists("aliases", lambda a: F.lower(a).contains(like)))
    total = hit.agg(F.count("*").alias("total"))
    return page(hit, [F.asc("type"), F.asc("standard_term")], number, page_size(size)).crossJoin(total)  # one row


def with_all_chars(terms: DataFrame, text: str) -> DataFrame:
    """Terms that have every character of the text, in any order: the intersection of the characters' posting lists."""
    wanted = sorted(set(text))
    postings = terms.select("type", "standard_term", F.explode(F.array_distinct(F.filter(F.split("standard_term", ""), lambda x: x != ""))).alias("ch")).where(F.col("ch").isin(*wanted))
    return postings.groupBy("type", "standard_term").agg(F.count_distinct("ch").alias("n")).where(F.col("n") == len(wanted)).select("type", "standard_term")


def version_string(version: DataFrame, org_id: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """The effective version in one text, "type:first 8;" of the types given in their order, or of all types by name; an organisation's version counts before the base's."""
    rows = version.where(F.col("org_id").isin("", org_id))
    best = rows.groupBy("type").agg(F.max(F.struct((F.col("org_id") != "").alias("own"), "version"))["version"].alias("version"))
    order = F.col("type") if types is None else F.nullif(F.array_position(F.array(*map(F.lit, types)), F.col("type")), F.lit(0))
    parts = best.where(order.isNotNull()).select(order.alias("at"), F.concat("type", F.lit(":"), F.substring("version", 1, 8), F.lit(";")).alias("part"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("version"))  # one entry a type


def sync_status(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """Whether each (org_id, type) is indexed in the version that is stored: synced, stale or missing."""
    both = stored.join(indexed.withColumnRenamed("version", "other"), ["org_id", "type"], "left")
    return both.select("org_id", "type", F.when(F.col("other").isNull(), "missing").when(F.col("other") == F.col("version"), "synced").otherwise("stale").alias("state"))


def replaced(stored: DataFrame, new: DataFrame, org_id: str) -> DataFrame:
    """stored with an organisation's types replaced by those of new (type, standard_term, aliases), of which each term is kept once."""
    once = merge(new)
    kept = stored.join(once.select("type", F.lit(org_id).alias("org_id")).distinct(), ["org_id", "type"], "left_anti")
    return kept.unionByName(once.withColumn("org_id", F.lit(org_id)).select(*stored.columns))


def pending_proposals(proposals: DataFrame, now: Column, most: int = 5, days: int = 7) -> DataFrame:
    """The oldest `most` open proposals of each organisation; those older than `days` are purged (id, org_id, status, created)."""
    live = proposals.where((F.col("status") == "pending") & (F.col("created") >= now - F.expr(f"interval {int(days)} days")))
    return live.withColumn("rn", F.row_number().over(Window.partitionBy("org_id").orderBy("created", "id"))).where(F.col("rn") <= most).drop("rn")


def archived(snapshots: DataFrame, terms: DataFrame, keep: int = 5) -> DataFrame:
    """snapshots (org_id, type, version_no) with one more of each (org_id, type) in terms, the oldest beyond `keep` gone."""
    known = snapshots.groupBy("org_id", "type").agg(F.max("version_no").alias("last"))
    now = terms.select("org_id", "type").distinct().join(known, ["org_id", "type"], "left").select("org_id", "type", (F.coalesce("last", F.lit(0)) + 1).alias("version_no"))
    return prune_snapshots(snapshots.unionByName(now), keep)


def rollback(snapshot_terms: DataFrame, org_id: str, version_no: int) -> DataFrame:
    """A proposal to go back: the terms of an archived version (org_id, version_no, type, standard_term, aliases)."""
    return snapshot_terms.where((F.col("org_id") == org_id) & (F.col("version_no") == version_no)).select("type", "standard_term", "aliases")


def merge_report(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Conflicts of a merge: "sameTermDiff" for a term whose aliases differ, "collision" for a word that each side gives to other terms."""

    def words(df: DataFrame, side: str) -> DataFrame:
        rows = df.select("type", "standard_term", F.explode(F.array_union(F.array("standard_term"), "aliases")).alias("word"))
        return rows.groupBy("type", "word").agg(F.array_sort(F.collect_set("standard_term")).alias(side))

    same = ours.select("type", "standard_term", F.array_sort("aliases").alias("a")).join(theirs.select("type", "standard_term", F.array_sort("aliases").alias("b")), ["type", "standard_term"])
    differ = same.where("a <> b").select("type", F.col("standard_term").alias("word"), F.lit("sameTermDiff").alias("conflict"))
    met = words(ours, "a").join(words(theirs, "b"), ["type", "word"])
    return differ.unionByName(met.where(F.size(F.array_intersect("a", "b")) == 0).select("type", "word", F.lit("collision").alias("conflict")))


def resolved(ours: DataFrame, theirs: DataFrame, mode: str = "union") -> DataFrame:
    """The merge of two term tables: aliases of both ("union"), or of the side named first in "ours" or "theirs" for terms that both have."""
    if mode == "union":
        return merge(ours.select("type", "standard_term", "aliases"), theirs.select("type", "standard_term", "aliases"))
    first, second = (ours, theirs) if mode == "ours" else (theirs, ours)
    first = first.select("type", "standard_term", "aliases")
    return first.unionByName(second.select(*first.columns).join(first, ["type", "standard_term"], "left_anti"))


def lint_top(terms: DataFrame, top: int = 12, words: int = 5) -> DataFrame:
    """Aliases that three terms or more of a type own, most owners first; only where there are more than `words` of them."""
    shared = collisions(terms, 2)
    many = shared.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") > words).select("type")
    ranked = shared.join(many, "type", "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("owners"), "word")))
    return ranked.where(F.col("rn") <= top)


def enriched(terms: DataFrame, additions: DataFrame) -> DataFrame:
    """terms with the cleaned aliases of additions: known terms gain aliases that no other term of the type has, new ones are added."""
    own = terms.select("type", F.col("standard_term").alias("word")).unionByName(terms.select("type", F.explode("aliases").alias("word"))).distinct()
    words = additions.select("type", F.trim("standard_term").alias("standard_term"), F.explode_outer("aliases").alias("alias")).withColumn("alias", F.trim("alias"))
    fresh = words.join(own.withColumnRenamed("word", "alias"), ["type", "alias"], "left_anti").where("alias <> '' and alias <> standard_term")
    gained = fresh.groupBy("type", "standard_term").agg(F.collect_set("alias").alias("aliases"))
    new = additions.select("type", F.trim("standard_term").alias("standard_term"), F.array().cast("array<string>").alias("aliases"))
    return merge(terms.select("type", "standard_term", "aliases"), gained, new)
