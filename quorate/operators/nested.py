"""Flat tables of nested decision records, by higher-order projection and one inline for each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class FlatTables:
    """Related tables; every child row has its row_id and its place."""

    records: DataFrame  #: row_id, ord, claim, plain_text, evidence_count, question_count, label_count
    evidence: DataFrame  #: row_id, ord, pos, title, text, raw (the JSON of an object)
    questions: DataFrame  #: row_id, ord, pos, question_id, kind, instructions, criteria
    criteria: DataFrame  #: row_id, ord, question_id, pos, option, definition
    labels: DataFrame  #: row_id, ord, question_id, pos, label, probability
    meta: DataFrame  #: row_id, ord, path, value


def _state(state: Column) -> Column:
    return F.try_parse_json(state)


def _elements(state: Column) -> Column:
    """The elements of state.evidence as variants; null if there is no such array."""
    return F.try_variant_get(state, "$.evidence", "array<variant>")


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _evidence(state: Column, row_id: Column, order: Column) -> Column:
    """array<struct> of the elements that are strings or objects with a text, with their places."""

    def element(v: Column, i: Column) -> Column:
        text = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_kind(v) == "OBJECT", F.try_variant_get(v, "$.text", "string"))
        title = F.when(_kind(v) == "OBJECT", F.try_variant_get(v, "$.title", "string"))
        return F.struct(row_id.alias("row_id"), order.alias("ord"), i.alias("pos"), title.alias("title"), text.alias("text"), F.when(_kind(v) == "OBJECT", F.to_json(v)).alias("raw"))

    return F.filter(F.transform(_elements(state), element), lambda e: e["text"].isNotNull())


def _entries(m: Column) -> Column:
    return F.coalesce(F.map_entries(m), F.array())


def flat_tables(rows: DataFrame) -> FlatTables:
    """Flat tables of rows (row_id, ord, state, questions, labels, meta).

    Each table is a single projection: nested transforms attach the row's key and the places
    to every leaf, flatten joins the inner arrays, and one inline emits the rows; nothing is
    shuffled and each table reads only its own columns.

    A state that is no JSON object is plain text and has no evidence. Evidence elements are
    strings or objects with a non-null text; pos is their place in the array as written, so
    elements left out leave gaps. Null maps, arrays and texts give no children; a null label
    probability stays null; criteria may be an object, a list or null; meta values keep their
    JSON form below the first level, and a meta that is no object gives none. Rows delivered
    twice give their children twice, told apart by ord; rows with a null row_id are left out.
    A table without `ord` gets a null one. Other columns, whatever their names, are ignored.
    """
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(None).cast("bigint"))
    rows = rows.where("row_id is not null")
    key, order = F.col("row_id"), F.col("ord")
    parsed = rows.select("row_id", "ord", _state(F.col("state")).alias("state"))

    def question(e: Column, i: Column) -> Column:
        v = e["value"]
        return F.struct(key.alias("row_id"), order.alias("ord"), i.alias("pos"), e["key"].alias("question_id"), v["kind"].alias("kind"), v["instructions"].alias("instructions"), v["criteria"].alias("criteria"))

    def options(e: Column) -> Column:
        c = e["value"]["criteria"]
        by_name = F.transform(_entries(F.from_json(c, "map<string,string>")), lambda o, i: F.struct(key.alias("row_id"), order.alias("ord"), e["key"].alias("question_id"), i.alias("pos"), o["key"].alias("option"), o["value"].alias("definition")))
        by_place = F.transform(F.from_json(c, "array<string>"), lambda o, i: F.struct(key.alias("row_id"), order.alias("ord"), e["key"].alias("question_id"), i.alias("pos"), i.cast("string").alias("option"), o.alias("definition")))
        return F.when(F.ltrim(c).startswith("["), by_place).when(F.ltrim(c).startswith("{"), by_name)

    def labels(e: Column) -> Column:
        return F.transform(_entries(e["value"]), lambda x, i: F.struct(key.alias("row_id"), order.alias("ord"), e["key"].alias("question_id"), i.alias("pos"), x["key"].alias("label"), x["value"].alias("probability")))

    def some(arrays: Column) -> Column:
        return F.flatten(F.filter(arrays, lambda x: x.isNotNull()))

    meta = _entries(F.when(F.ltrim("meta").startswith("{"), F.from_json("meta", "map<string,string>")))
    fields = F.transform(meta, lambda e: F.struct(key.alias("row_id"), order.alias("ord"), e["key"].alias("path"), e["value"].alias("value")))
    is_object = F.coalesce(_kind(F.col("v")) == "OBJECT", F.lit(False))
    heads = rows.select("row_id", "ord", "state", _state(F.col("state")).alias("v"), "questions", "labels").select(
        "row_id",
        "ord",
        F.when(is_object, F.try_variant_get("v", "$.claim", "string")).alias("claim"),
        F.when(~is_object, F.col("state")).alias("plain_text"),
        F.coalesce(F.size(_evidence(F.col("v"), key, order)), F.lit(0)).alias("evidence_count"),
        F.size(_entries(F.col("questions"))).alias("question_count"),
        F.coalesce(F.aggregate(_entries(F.col("labels")), F.lit(0), lambda n, e: n + F.size(_entries(e["value"]))), F.lit(0)).alias("label_count"),
    )
    return FlatTables(
        records=heads,
        evidence=parsed.select(F.inline(_evidence(F.col("state"), key, order))),
        questions=rows.select(F.inline(F.transform(_entries(F.col("questions")), question))),
        criteria=rows.select(F.inline(some(F.transform(_entries(F.col("questions")), options)))),
        labels=rows.select(F.inline(some(F.transform(_entries(F.col("labels")), labels)))),
        meta=rows.select(F.inline(fields)),
    )


def children(rows: DataFrame) -> DataFrame:
    """(row_id, child, child_key) of every evidence, question and label of rows, each once."""
    flat = flat_tables(rows)
    parts = (
        flat.evidence.select("row_id", F.lit("evidence").alias("child"), F.col("pos").cast("string").alias("child_key")),
        flat.questions.select("row_id", F.lit("question").alias("child"), F.col("question_id").alias("child_key")),
        flat.labels.select("row_id", F.lit("label").alias("child"), F.concat_ws("/", "question_id", "label").alias("child_key")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
