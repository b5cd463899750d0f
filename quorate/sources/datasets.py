"""Public fact-checking data in their published form, as decision rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.etl import capped_groups, native_labels, one_hot_labels

LABELS = ["supported", "refuted", "not_enough_info"]
INSTRUCTIONS = "Do the passages support the claim, refute it, or leave it open?"


def _passage(title: Column, body: Column) -> Column:
    return F.struct(title.cast("string").alias("title"), body.alias("text"))


def _row(rows: DataFrame, source: str, row_id: Column, group_id: Column, claim: Column, evidence: Column, split: Column, native: Column, meta: dict[str, Column], label_map: DataFrame, order: list[str]) -> DataFrame:
    """Decision rows of (claim, evidence), mapped to the common labels; rows whose label has no entry are dropped."""
    named = rows.select(
        row_id.alias("row_id"), F.lit(source).alias("source"), F.when(split.isin("dev", "validation"), "val").otherwise(split).alias("split"), group_id.alias("group_id"),
        F.to_json(F.struct(claim.alias("claim"), evidence.alias("evidence"))).alias("state"), native.alias("native"), F.to_json(F.struct(*(v.alias(k) for k, v in meta.items()))).alias("meta"), *(F.col(o) for o in order),
    )
    out = native_labels(named, label_map)
    question = F.struct(F.lit("choice").alias("kind"), F.lit(INSTRUCTIONS).alias("instructions"), F.lit('{"supported": null, "refuted": null, "not_enough_info": null}').alias("criteria"))
    return out.select(
        "row_id", "source", "split", "group_id", "state", F.create_map(F.lit("verdict"), question).alias("questions"), F.create_map(F.lit("verdict"), one_hot_labels(F.col("common"), LABELS)).alias("labels"),
        F.lit(1.0).alias("weight"), F.lit("ground_truth").alias("label_source"), "meta", *order,
    )


def fever(rows: DataFrame, label_map: DataFrame) -> DataFrame:
    """From (premise, hypothesis, fever_gold_label, fid, cid, split): the premise is the claim, the title is the fid."""
    fid, cid = F.col("fid").cast("string"), F.col("cid").cast("string")
    row_id = F.concat(F.lit("fever-"), F.col("split"), F.lit("-"), fid)
    meta = {"dataset": F.lit("fever"), "original_label": F.col("fever_gold_label"), "original_id": fid}
    return _row(rows, "fever", row_id, F.concat(F.lit("fever-claim-"), cid), F.col("premise"), F.array(_passage(fid, F.col("hypothesis"))), F.col("split"), F.col("fever_gold_label"), meta, label_map, [])


def vitaminc(rows: DataFrame, label_map: DataFrame) -> DataFrame:
    """From (claim, evidence, page, label, unique_id, case_id, revision_type, split)."""
    row_id = F.concat(F.lit("vitaminc-"), F.col("unique_id"))
    meta = {"dataset": F.lit("vitaminc"), "revision_type": F.col("revision_type"), "original_label": F.col("label")}
    return _row(rows, "vitaminc", row_id, F.concat(F.lit("vitaminc-case-"), F.col("case_id")), F.col("claim"), F.array(_passage(F.col("page"), F.col("evidence"))), F.col("split"), F.col("label"), meta, label_map, [])


def scifact(claims: DataFrame, corpus: DataFrame, label_map: DataFrame) -> DataFrame:
    """From claims (id, claim, evidence: map of doc to rationales, cited_doc_ids, split) and corpus (doc_id, title, abstract).

    A claim and document with one label make a row of the rationales' sentences, in order and
    within bounds; conflicting labels and documents that aren't in the corpus make none. A
    claim without evidence gets the cited documents that are there, whole, in their order.
    """
    docs = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", "abstract")
    some = F.coalesce(F.size("evidence") > 0, F.lit(False))
    with_evidence = claims.where(some).select("id", "claim", "split", F.explode("evidence").alias("doc", "entries")).withColumn("doc_id", F.col("doc").cast("bigint"))
    found = F.array_distinct(F.transform("entries", lambda e: e["label"]))
    with_evidence = with_evidence.where(F.size(found) == 1).join(docs, "doc_id").withColumn("native", F.get(found, F.lit(0)))
    sentences = text.selected_sentences(F.col("abstract"), F.flatten(F.transform("entries", lambda e: e["sentences"])))
    parts = [with_evidence.select("id", "claim", "split", "native", F.col("doc").alias("tail"), F.array(_passage(F.col("title"), sentences)).alias("passages"))]
    cited = claims.where(~some).select("id", "claim", "split", F.posexplode_outer("cited_doc_ids").alias("pos", "doc_id")).join(docs, "doc_id", "left")
    item = F.when(F.col("title").isNotNull() | F.col("abstract").isNotNull(), F.struct("pos", _passage(F.col("title"), F.array_join("abstract", " ")).alias("p")))
    without = cited.groupBy("id", "claim", "split").agg(F.array_sort(F.collect_list(item)).alias("all"))
    parts.append(without.select("id", "claim", "split", F.lit("NOINFO").alias("native"), F.lit("noinfo").alias("tail"), F.transform("all", lambda x: x["p"]).alias("passages")))
    rows = parts[0].unionByName(parts[1])
    number = F.col("id").cast("string")
    meta = {"dataset": F.lit("scifact"), "original_label": F.col("native"), "original_id": number}
    return _row(rows, "scifact", F.concat_ws("-", F.lit("scifact"), "split", number, "tail"), F.concat(F.lit("scifact-claim-"), number), F.col("claim"), F.col("passages"), F.col("split"), F.col("native"), meta, label_map, [])


CLIMATE = ["SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO", "DISPUTED"]


def climate_fever(rows: DataFrame, label_map: DataFrame) -> DataFrame:
    """From (claim_id, claim, claim_label: index, evidences: array of (article, evidence)); disputed claims have no common label and are dropped."""
    native = F.get(F.array(*(F.lit(x) for x in CLIMATE)), F.col("claim_label").cast("int"))
    passages = F.transform("evidences", lambda e: _passage(e["article"], e["evidence"]))
    number = F.col("claim_id").cast("string")
    meta = {"dataset": F.lit("climate_fever"), "original_label": native, "original_id": number}
    return _row(rows, "climate_fever", F.concat(F.lit("climate-"), number), F.concat(F.lit("climate-claim-"), number), F.col("claim"), passages, F.lit("test"), native, meta, label_map, [])


LOADERS = {"fever": fever, "vitaminc": vitaminc, "scifact": scifact, "climate_fever": climate_fever}


def load(spark: SparkSession, sources: dict[str, tuple], label_map: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """All named sources as one table, each capped without splitting a group, with ord in the order given; an unknown name is an error."""
    out = None
    for k, (name, tables) in enumerate(sources.items()):
        if name not in LOADERS:
            raise ValueError(f"unknown source: {name}")
        # Sources in the order given; inside one a hash order, as tables have none of their own.
        rows = LOADERS[name](*tables, label_map).withColumn("ord", F.lit(k).cast("bigint") * 2**56 + F.shiftrightunsigned(F.xxhash64("row_id"), 8))
        rows = rows if most is None else capped_groups(rows, most, seed)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sources")
    return out
