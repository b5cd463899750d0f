"""Gold labels, predictions, and their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; by a window, so that all columns stay."""
    w = Window.partitionBy(*keys).orderBy(F.col(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_by(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last write of each key: the named columns of the row with the greatest order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, "_r.*")


EXTRAS = ("source", "split", "group_id", "label_source", "weight", "meta")


def gold_labels(rows: DataFrame, columns: tuple[str, ...] = EXTRAS) -> DataFrame:
    """One row for each record and question, with the gold distribution normalised, and the named other columns.

    Only those columns are read. A record delivered twice counts once (its first ord); distributions without mass are left out.
    """
    one = rows.where("row_id is not null and labels is not null").groupBy("row_id").agg(
        F.min_by(F.struct(*columns, "labels"), "ord").alias("r")
    )
    long = one.select("row_id", *(f"r.{c}" for c in columns), F.explode("r.labels").alias("question_id", "m"))
    long = long.withColumn("target", dist.normalize(dist.from_map(F.col("m")))).drop("m").where("target is not null")
    return long.withColumn("gold", dist.argmax(F.col("target")))


def last_predictions(predictions: DataFrame) -> DataFrame:
    """The last answer (by ord) of each model to each record and question, with its distribution as it is."""
    last = last_by(predictions.where("row_id is not null"), ["row_id", "question_id", "model"], "ord", ["probs", "confidence", "latency_ms", "ord"])
    return last.withColumn("raw", dist.from_map(F.col("probs"))).drop("probs")


def problems(raw: Column, space: Column, conf: Column, tolerance: float = 1e-6) -> Column:
    """What is wrong with an answer, as an array of names: empty if nothing is."""
    p = dist.values(raw)
    checks = {
        "missing": raw.isNull(),
        "labels": F.array_sort(dist.labels(raw)) != F.array_sort(space),
        "not_finite": F.exists(p, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))),
        "negative": F.exists(p, lambda x: ~F.isnan(x) & (x < 0)),
        "no_mass": dist.total(raw) <= 0,
        "sum": F.abs(dist.total(raw) - 1) > tolerance,
        "no_confidence": conf.isNull() | F.isnan(conf),
        "confidence_range": (conf < -1e-9) | (~F.isnan(conf) & (conf > 1 + 1e-9)),
    }
    return F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))


def strict_unique(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows, with an error as soon as a key comes twice, whether it would be used or not."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit(f"duplicate {what}:"), *keys))).otherwise(F.lit(True))).drop("_n")


def paired(gold: DataFrame, predictions: DataFrame, unique: bool = False) -> DataFrame:
    """Inner join of gold and answers by record and question; both distributions normalised.

    Two answers of one model to one question are an error, even if no gold asks for them;
    unique says that there are none, as after last_predictions.

    Answers that are no distribution (not finite, negative, without mass) are left out. ok is
    1 where the first label of highest probability is the gold one; conf is the stored
    confidence or else the highest probability.
    """
    keys = ["row_id", "question_id", *(["model"] if "model" in predictions.columns else [])]
    predictions = predictions if unique else strict_unique(predictions, keys, "answer")
    fine = predictions.where(dist.is_valid(F.col("raw"))).withColumn("answer", dist.normalize(F.col("raw"))).drop("raw")
    rows = gold.join(fine, ["row_id", "question_id"])
    rows = rows.withColumn("pred", dist.argmax(F.col("answer"))).withColumn("top", dist.top(F.col("answer")))
    return rows.withColumn("ok", (F.col("pred") == F.col("gold")).cast("int")).withColumn("conf", dist.confidence(F.col("confidence"), F.col("answer")))


def coverage(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per model: gold keys, answers, keys without an answer and answers without a key."""
    want = gold.select("row_id", "question_id")
    have = predictions.select("model", "row_id", "question_id")
    both = have.join(want.withColumn("wanted", F.lit(1)), ["row_id", "question_id"], "left")
    n = want.count()
    extra = both.groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count("wanted").alias("matched"),
        F.sum(F.col("wanted").isNull().cast("int")).alias("extra"),
    )
    return extra.select("model", F.lit(n).cast("bigint").alias("gold"), "answers", "matched", (F.lit(n) - F.col("matched")).alias("missing"), "extra")


def key_differences(gold: DataFrame, predictions: DataFrame, samples: int = 3) -> DataFrame:
    """(model, side, n, sample): gold keys that a model didn't answer and answers without gold, with the first few of each."""
    want = gold.select("row_id", "question_id").distinct()
    have = predictions.select("model", "row_id", "question_id").distinct()
    models = have.select("model").distinct()
    missing = models.crossJoin(want).join(have, ["model", "row_id", "question_id"], "left_anti").withColumn("side", F.lit("missing"))  # models x keys, models are few
    extra = have.join(want, ["row_id", "question_id"], "left_anti").withColumn("side", F.lit("extra")).select("model", "row_id", "question_id", "side")
    both = missing.unionByName(extra).withColumn("key", F.concat_ws("/", "row_id", "question_id"))
    counts = both.groupBy("model", "side").agg(F.count(F.lit(1)).alias("n"))
    # The smallest few by rounds of minima, so that no task sorts a side.
    found, left = None, both.select("model", "side", "key")
    for k in range(samples):
        least = left.groupBy("model", "side").agg(F.min("key").alias(f"k{k}"))
        found = least if found is None else found.join(least, ["model", "side"], "left")
        left = left.join(least, ["model", "side"]).where(F.col("key") > F.col(f"k{k}")).drop(f"k{k}")
    return counts.join(found, ["model", "side"]).select("model", "side", "n", F.concat_ws(" ", *(f"k{k}" for k in range(samples))).alias("sample"))


def raw_pairs(gold: DataFrame, predictions: DataFrame, question: str) -> DataFrame:
    """Answers to one question that have a gold label, probabilities as they are: what a plot draws."""
    rows = predictions.where((F.col("question_id") == question) & F.col("raw").isNotNull())
    rows = rows.join(gold.where(F.col("question_id") == question).select("row_id", "gold"), "row_id")
    return rows.select("model", "row_id", "gold", F.col("raw").alias("answer"), dist.p_of(F.col("raw"), F.col("gold")).alias("p_gold"))


def exact_three(gold: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_id, question_id, target, gold, raw_a, raw_b), or an error where the keys of the three are not the same."""
    first = exact_pairs(gold, a).withColumnsRenamed({"raw": "raw_a", "confidence": "confidence_a"})
    second = exact_pairs(gold, b).select("row_id", "question_id", F.col("raw").alias("raw_b"), F.col("confidence").alias("confidence_b"))
    return first.join(second, ["row_id", "question_id"])


def joined_back(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Option rows (row_id, options, label) with a scorer's answers over option numbers (row_id, answer): pred is a number, ok compares it with label."""
    pred = dist.argmax(F.col("answer")).cast("int")
    return rows.join(answers, "row_id").withColumn("pred", pred).withColumn("ok", (F.col("pred") == F.col("label")).cast("int"))


def exact_pairs(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """The pairs of one model, or an error where keys are missing on either side."""
    both = gold.select("row_id", "question_id", "target", "gold").join(
        predictions.select("row_id", "question_id", "raw", "confidence").withColumn("there", F.lit(True)), ["row_id", "question_id"], "full"
    )
    wrong = F.when(F.col("gold").isNull(), F.concat(F.lit("answer without gold: "), F.col("row_id"))).when(F.col("there").isNull(), F.concat(F.lit("no answer: "), F.col("row_id")))
    return both.where(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.lit(True))).drop("there")


def side_by_side(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that both models answered, one model's columns with _a, the other's with _b."""
    columns = ["pred", "ok", "conf", "answer"]
    one = pairs.where(F.col("model") == a).select("row_id", "question_id", "gold", "target", *(F.col(c).alias(f"{c}_a") for c in columns))
    two = pairs.where(F.col("model") == b).select("row_id", "question_id", *(F.col(c).alias(f"{c}_b") for c in columns))
    return one.join(two, ["row_id", "question_id"])
