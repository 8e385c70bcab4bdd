"""Structured documents as rows: parsing, exploding and what is read off the exploded lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null
from lodestrata.operators.lineage import cut
from lodestrata.schema import ENTITY, ENTITY_TYPES, STRUCTURED

FIELDS = {t.field: t.key for t in ENTITY_TYPES}
LISTS = "struct<" + ",".join(f"{f}:array<string>" for f in FIELDS) + ">"


def parsed(document: Column) -> Column:
    """The document as a struct of string lists; null where it is no JSON. A list of another shape is null alone."""
    return F.from_json(document, STRUCTURED)


def unparsable(document: Column) -> Column:
    """Whether there is a document and it is no JSON object."""
    return document.isNotNull() & F.try_parse_json(document).isNull()


def manually_edited(document: Column) -> Column:
    """true, "true" in any case, or a number of 1 or more, at the document's mark; anything else is false."""
    mark = F.get_json_object(document, "$._meta.manuallyEdited")
    number = F.get_json_object(document, "$._meta").rlike(r'"manuallyEdited"\s*:\s*-?[0-9]')
    return F.coalesce((F.lower(mark) == "true") | (number & (F.abs(mark.try_cast("double")) >= 1)), F.lit(False))


def element_lists(document: Column, shape: Callable[[Column, Column], Column]) -> list[Column]:
    """(field, kind, elements) of each list of a parsed document, elements as shape(text, entity) makes them; entity is null for a plain string.

    The document must be a column, not the parsing itself, and an array of these must be exploded where it is made:
    only then a plan has each document and each element read once, and no filter that reads them again.
    """

    def elements(f: str) -> Column:
        each = F.transform(document[f], lambda x: F.struct(x.alias("text"), F.when(x.startswith("{"), F.from_json(x, ENTITY)).alias("e")))
        return F.transform(each, lambda x: shape(x["text"], x["e"]))

    return [F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), elements(f).alias("elements")) for f, k in FIELDS.items()]


def element_fields(text: Column, e: Column) -> Column:
    """term, source_text, norm_level, dosage and plain of an element; see exploded."""
    plain = ~text.startswith("{")
    own = F.coalesce(blank_to_null(e["content"]), blank_to_null(e["name"]))
    return F.struct(
        F.when(plain, blank_to_null(text)).otherwise(own).alias("term"),
        blank_to_null(e["sourceText"]).alias("source_text"),
        e["normLevel"].alias("norm_level"),
        e["dosage"].alias("dosage"),
        plain.alias("plain"),
    )


def exploded(df: DataFrame, id_column: str = "id", document: str = "structured_data", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element of each list: id, field, kind, pos, term, source_text, norm_level, dosage and plain.

    The term is the content, else the name; a plain string is its own term. Both are trimmed and null where
    blank. Missing, empty and misshapen lists and documents give no rows. Lists are read by one pass, elements once each.
    """
    docs = df.select(F.col(id_column).alias("id"), *keep, parsed(F.col(document)).alias("__document"))
    rows = docs.select("id", *keep, F.explode(F.array(*element_lists(F.col("__document"), element_fields))).alias("l"))
    return rows.select("id", *keep, "l.field", "l.kind", F.posexplode("l.elements").alias("pos", "e")).select("id", *keep, "field", "kind", "pos", "e.*")


def counted(df: DataFrame, document: str = "structured_data") -> DataFrame:
    """The elements of all lists with how often (n) they occur: kind, n and the fields of exploded but places.

    Equal elements of a kind are counted as they are written and parsed once: what only counts elements needs no more.
    """
    docs = df.select(F.from_json(document, LISTS).alias("__document"))
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("__document")[f].alias("texts")) for f, k in FIELDS.items()))
    texts = docs.select(F.explode(lists).alias("l")).select("l.kind", F.explode("l.texts").alias("text"))
    once = texts.groupBy("kind", "text").agg(F.count("*").alias("n"))
    entity = F.when(F.col("text").startswith("{"), F.from_json("text", ENTITY))
    # Exploded where it is made, so that no filter on it moves below the counting and parses every element again.
    rows = once.select("kind", "n", "text", entity.alias("e")).select("kind", "n", F.explode(F.array(element_fields(F.col("text"), F.col("e")))).alias("e"))
    return rows.select("kind", "n", "e.*")


def term_top(entities: DataFrame, kind: str, top: int = 10) -> DataFrame:
    """The most frequent terms of one kind, ties by term."""
    rows = entities.where((F.col("kind") == kind) & F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("term")).limit(top)


def pattern_top(records: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """Pattern terms of the structured list, or of the raw column (id, pattern) where a record has no such list or an empty one."""
    listed = cut(entities.where("kind = 'pattern'").select("id", "term"))
    raw = records.join(listed.select("id").distinct(), "id", "left_anti").select(F.explode(F.split("pattern", "[、，；;,]")).alias("term"))
    terms = listed.select("term").unionAll(raw.select(blank_to_null("term").alias("term"))).where("term is not null")
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("term")).limit(top)


def representatives(entities: DataFrame) -> DataFrame:
    """One entity for each (id, field, term): the longest source text, then the lowest level (none: 4), then the first.

    first_pos is where the term came first, the place that the representative takes; best_pos is its own. One aggregation, no sort.
    """
    rank = F.struct((-F.length(F.coalesce("source_text", F.lit("")))).alias("l"), F.coalesce("norm_level", F.lit(4)).alias("v"), F.col("pos").alias("p"), "source_text", "norm_level")
    out = entities.where("term is not null").groupBy("id", "field", "term").agg(F.min(rank).alias("best"), F.min("pos").alias("first_pos"))
    return out.select("id", "field", "term", "best.source_text", "best.norm_level", "first_pos", F.col("best.p").alias("best_pos"))


def replacement_pairs(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """id, source_text and the standard term that takes its place: the first of each source text in list order.

    entities have source_text; changed gives (kind, term, standard_term). Longer texts come first (rank).
    """
    order = {f: k for k, f in enumerate(FIELDS)}
    place = F.coalesce(*(F.when(F.col("field") == f, F.lit(k)) for f, k in order.items()))
    met = entities.where("source_text is not null").join(changed, ["kind", "term"]).where("source_text <> standard_term")
    first = met.groupBy("id", "source_text").agg(F.min(F.struct(place.alias("l"), "pos", "standard_term")).alias("x")).select("id", "source_text", "x.standard_term")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.length("source_text").desc(), "source_text")))


def effective_pairs(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only pairs whose source text occurs in one of the record's columns (id and the columns)."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).contains(F.col("source_text")), F.lit(False))
    return pairs.join(records.select("id", *columns), "id").where(found).select(*pairs.columns)


def stamped(df: DataFrame, version: str, at: str, terms: int, document: str = "structured_data") -> DataFrame:
    """df with provenance: _meta of a parsed document tells the dictionary that it was normalised by; other members stay."""
    meta = F.struct(F.lit(version).alias("dictVersion"), F.lit(at).alias("dictCapturedAt"), F.lit(terms).alias("dictTermCount"))
    members = F.from_json(document, "map<string,variant>")
    rest = F.map_filter(members, lambda k, _: k != "_meta")
    whole = F.to_json(F.map_concat(rest, F.create_map(F.lit("_meta"), F.to_variant_object(meta))))
    return df.withColumn(document, F.when(members.isNotNull(), whole).otherwise(F.col(document)))


def hits_by_level(elements: DataFrame) -> DataFrame:
    """Counted elements by kind and level; 0 stands for those without one."""
    return elements.where("term is not null").groupBy("kind", F.coalesce("norm_level", F.lit(0)).alias("level")).agg(F.sum("n").alias("n"))


def missed_terms(elements: DataFrame) -> DataFrame:
    """Terms of counted elements that no dictionary entry met, by kind, with how often."""
    return elements.where("term is not null and coalesce(norm_level, 0) = 0").groupBy("kind", "term").agg(F.sum("n").alias("n"))
