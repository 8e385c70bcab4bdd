"""The way back from rows to structured documents: lists are taken apart, repaired as rows and written again; other members stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import blank_to_null
from lodestrata.operators.decompose import normalized_lists
from lodestrata.operators.entities import FIELDS, element_lists, parsed, stamped
from lodestrata.operators.extraction import SKIN, is_pulse_or_tongue, is_tongue
from lodestrata.operators.lineage import cut

MEMBERS = "map<string,variant>"


def elements(df: DataFrame, id_column: str = "id", document: str = "structured_data", keep: tuple[str, ...] = (), entity: bool = False) -> DataFrame:
    """A row for each element of each list: id, field, kind, pos, element (its text; an object's is its JSON), plain and content.

    content: an object's content, name or source text, the first that isn't blank; null for anything else. entity: with the object's members too.
    """

    def shape(text: Column, e: Column) -> Column:
        object_ = F.coalesce(text.startswith("{"), F.lit(False))
        content = F.coalesce(*(blank_to_null(e[k]) for k in ("content", "name", "sourceText")))
        return F.struct(text.alias("element"), (~object_).alias("plain"), content.alias("content"), *([e.alias("entity")] if entity else []))

    docs = df.select(F.col(id_column).alias("id"), *keep, parsed(F.col(document)).alias("__document"))
    rows = docs.select("id", *keep, F.explode(F.array(*element_lists(F.col("__document"), shape))).alias("l"))
    return rows.select("id", *keep, "l.field", "l.kind", F.posexplode("l.elements").alias("pos", "e")).select("id", *keep, "field", "kind", "pos", "e.*")


def element_json(element: Column) -> Column:
    """An element as JSON: objects as they are, other text quoted, null as null."""
    quoted = F.to_json(F.array(element))
    return F.when(element.isNull(), "null").when(element.startswith("{"), element).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def with_members(element: Column, members: Column, names: tuple[str, ...]) -> Column:
    """An object's JSON with the given members (a struct; those that are null go) in place of its own; all others stay."""
    own = F.map_filter(F.from_json(element, MEMBERS), lambda k, _: ~k.isin(*names))
    return F.to_json(F.map_concat(own, F.from_json(F.to_json(members), MEMBERS)))


def written(df: DataFrame, rows: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), id_column: str = "id", document: str = "structured_data") -> DataFrame:
    """df with the lists `fields` of its documents written from rows (id, field, at, element), in the order of `at`.

    A document's list without rows becomes empty, one that it lacks is added if it has rows; a member that is no list,
    members of other names and documents that are no JSON stay. Nulls stay nulls.
    """
    lists = rows.where(F.col("field").isin(*fields)).groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("at", element_json(F.col("element")).alias("json")))).alias("l"))
    lists = lists.select("id", F.struct("field", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["json"]), ","), F.lit("]")).alias("json")).alias("e"))
    given = lists.groupBy("id").agg(F.map_from_entries(F.collect_list("e")).alias("__given"))
    both = df.join(given.withColumnRenamed("id", "__id"), F.col(id_column) == F.col("__id"), "left")
    doc = F.from_json(document, MEMBERS)
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    none = F.create_map().cast("map<string,string>")
    blank = F.lit("[]")
    own = F.map_filter(doc, lambda k, v: ~(k.isin(*fields) & is_list(v)))
    emptied = F.transform_values(F.map_filter(doc, lambda k, v: k.isin(*fields) & is_list(v) & ~F.map_contains_key(F.coalesce("__given", none), k)), lambda k, _: F.parse_json(blank))
    new = F.transform_values(F.map_filter(F.coalesce("__given", none), lambda k, _: ~F.map_contains_key(own, k)), lambda _, v: F.parse_json(v))
    return both.withColumn(document, F.when(doc.isNotNull(), F.to_json(F.map_concat(own, emptied, new))).otherwise(F.col(document))).drop("__id", "__given")


def rerouted_rows(rows: DataFrame) -> DataFrame:
    """elements() with the list that each belongs to (to), whether it moves there, and its place in it (at); repeats go.

    Pulse and tongue elements leave the symptoms, names of skin diseases leave the tongue. A moved element comes after
    those that are there already, and goes if its new list has the same content, or gets it from an earlier one.
    """
    content = F.col("content")
    out = F.when(is_pulse_or_tongue(content), F.when(is_tongue(content), "tongueList").otherwise("pulseList"))
    to = F.when(F.col("field") == "symptoms", out).when((F.col("field") == "tongueList") & content.startswith(SKIN), F.lit("symptoms"))
    moved = rows.withColumn("to", F.coalesce(to, F.col("field"))).withColumn("moved", F.col("to") != F.col("field"))
    first = F.row_number().over(Window.partitionBy("id", "to", "content").orderBy("moved", "pos"))
    return moved.withColumn("rn", first).where(~F.col("moved") | (F.col("rn") == 1)).withColumn("at", F.struct("moved", "pos")).drop("rn")


def rerouted_documents(df: DataFrame, document: str = "structured_data") -> DataFrame:
    """df with misplaced elements of its documents moved to the lists that they belong to, and `changed`; documents without any stay as they are."""
    lists = ("symptoms", "tongueList", "pulseList")
    rows = cut(elements(df, document=document).where(F.col("field").isin(*lists)))
    placed = cut(rerouted_rows(rows))
    hit = placed.where("moved").select("id").distinct()
    # A repeated one that went has its like in the list, but the document may have no other move.
    gone = rows.select("id", "field", "pos").join(placed.select("id", "field", "pos"), ["id", "field", "pos"], "left_anti").select("id")
    hit = hit.unionByName(gone).distinct()
    rows = placed.join(hit, "id", "left_semi").select("id", F.col("to").alias("field"), "at", "element")
    flagged = df.join(hit.withColumn("changed", F.lit(True)), "id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    own = F.when(F.col("changed"), F.col(document))
    done = written(flagged.withColumn("__new", own), rows, lists, document="__new")
    return done.withColumn(document, F.coalesce("__new", document)).drop("__new")


def normalized_documents(df: DataFrame, terms: DataFrame, types: tuple[str, ...], version: str, at: str, n_terms: int, chosen: Column, document: str = "structured_data") -> DataFrame:
    """df with the documents of `chosen` rows normalised by the cleaning rules and stamped; all others stay as they are.

    Objects of a list are judged by their source text and take the term and level that they get, dosages are lower-cased; of those that end
    as one term one stays (see decompose.normalized_lists). Plain strings, objects without any text and members that
    these rules don't know stay.
    """
    picked = df.where(F.coalesce(chosen, F.lit(False)))
    rows = cut(elements(picked, document=document, entity=True))
    e = F.col("entity")
    live = rows.where(~F.col("plain") & F.col("content").isNotNull())
    inputs = live.select("id", "field", F.col("kind").alias("type"), "pos", F.coalesce(blank_to_null(e["content"]), blank_to_null(e["name"])).alias("content"), e["sourceText"].alias("source_text"), e["normLevel"].alias("norm_level"))
    done = normalized_lists(inputs, terms, types, cleaning=True).select("id", "field", F.col("pos").alias("at"), F.col("best_pos").alias("pos"), "term", "source_text", F.col("norm_level").alias("level"))
    herb = F.col("field") == "herbs"
    new = F.struct(F.when(~herb, F.col("term")).alias("content"), F.when(herb, F.col("term")).alias("name"), F.lower(F.trim(e["dosage"])).alias("dosage"), F.col("source_text").alias("sourceText"), F.col("level").alias("normLevel"))
    objects = live.join(done, ["id", "field", "pos"]).select("id", "field", "at", with_members(F.col("element"), new, ("content", "name", "dosage", "sourceText", "normLevel")).alias("element"))
    rest = rows.where(F.col("plain") | F.col("content").isNull()).select("id", "field", F.col("pos").alias("at"), "element")
    mark = df.withColumn("__new", F.when(F.coalesce(chosen, F.lit(False)), F.col(document)))
    out = stamped(written(mark, objects.unionByName(rest), document="__new"), version, at, n_terms, document="__new")
    return out.withColumn(document, F.coalesce("__new", document)).drop("__new")
