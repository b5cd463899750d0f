"""Chat records: building, reading back, wording variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist, text

SYSTEM = "Answer with one label of the list."


def chat_records(rows: DataFrame, schema_id: str = "default") -> DataFrame:
    """One chat record for each record and question, with system, user and assistant turns.

    The label is the first of highest probability; records whose label isn't in the
    question's space, or whose targets don't have its labels, are an error.
    """
    long = rows.where("questions is not null and labels is not null").select("*", F.explode("questions").alias("question_id", "q"))
    target = dist.normalize(dist.from_map(F.try_element_at("labels", F.col("question_id"))))
    long = long.withColumn("target", target).where("target is not null")
    q = F.col("q")
    long = long.withColumn("label_space", text.label_space(q["kind"], q["criteria"])).withColumn("label", dist.argmax(F.col("target")))
    same = F.array_sort(dist.labels(F.col("target"))) == F.array_sort("label_space")
    checked = F.when(same, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("labels are not the space of "), F.col("row_id"), F.lit("/"), F.col("question_id"))))
    long = long.withColumn("label", checked)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(turn("system", F.lit(SYSTEM)), turn("user", text.user_text(q["instructions"], q["kind"], q["criteria"], F.col("state"))), turn("assistant", F.col("label")))
    ordered = F.transform("label_space", lambda x: F.struct(x.alias("key"), dist.p_of(F.col("target"), x).alias("value")))
    return long.select(
        "row_id", "question_id", "split", messages.alias("messages"), "label", "label_space", F.map_from_entries(ordered).alias("target_probs"), F.lit(schema_id).alias("schema_id"), "source",
        F.coalesce("weight", F.lit(1.0)).alias("weight"), "label_source", "group_id", F.coalesce("meta", F.lit("{}")).alias("meta"),
    )


def recovered_states(chats: DataFrame, rows: DataFrame) -> DataFrame:
    """Chat records with the state of their ground-truth row; `found` is false where there is none."""
    key = F.coalesce(F.get_json_object("meta", "$.gt_row_id"), F.col("row_id"))
    states = rows.where("row_id is not null").groupBy("row_id").agg(F.min_by("state", "ord").alias("state"))
    return chats.withColumn("gt_row_id", key).join(states.withColumnRenamed("row_id", "gt_row_id").withColumn("found", F.lit(True)), "gt_row_id", "left").fillna(False, ["found"])


def parsed_prompts(chats: DataFrame) -> DataFrame:
    """(row_id, question_id, claim, evidence) read back from the user turn; nulls where it doesn't parse."""
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    return chats.select("row_id", "question_id", text.parse_prompt(user).alias("p")).select("row_id", "question_id", "p.claim", "p.evidence")


def option_rows(rows: DataFrame) -> DataFrame:
    """(row_id, context, options, label) for a menu scorer; only records of exactly one choice question can be told so, others are an error."""
    q, entries = F.col("e.value"), F.map_entries("questions")
    fine = (F.size("questions") == 1) & (F.get(entries, F.lit(0))["value"]["kind"] == "choice")
    kept = rows.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one choice question: "), F.col("row_id")))))
    kept = kept.withColumn("e", F.get(entries, F.lit(0)))
    space = text.label_space(q["kind"], q["criteria"])
    target = dist.normalize(dist.from_map(F.try_element_at("labels", F.col("e.key"))))
    options = F.transform(text.options(q["kind"], q["criteria"]), text.option_line)
    return kept.select("row_id", "group_id", "split", F.col("state").alias("context"), options.alias("options"), (F.array_position(space, dist.argmax(target)) - 1).cast("int").alias("label"))


def multi_question(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every record with every extra question of a table (schema_id, kind, instructions, criteria), however many."""
    return rows.crossJoin(schemas.select("schema_id", "kind", "instructions", "criteria"))
