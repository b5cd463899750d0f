"""Gates: each gives the failures (code, n, sample) of a rule set; empty means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.runtime import materialize

FORM = "code string, n bigint, sample string"


def _bad(rows: DataFrame, code: str, what: Column) -> DataFrame:
    """One failure if any row is left, with their number and the smallest sample."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(what.cast("string")).alias("sample")).where("n > 0").select(F.lit(code).alias("code"), "n", "sample")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check(failures: DataFrame) -> None:
    """Raises if there are failures; call it before a sink, so that nothing is written then."""
    found = failures.collect()
    if found:
        raise ValueError("; ".join(f"{r.code}: {r.n} ({r.sample})" for r in found))


def state_signatures(rows: DataFrame, state: Column) -> DataFrame:
    """rows with parsed claim and evidence of the rendered state, their ordered and unordered signatures."""
    parsed = rows.withColumn("_p", text.parse_state(text.state_text(state)))
    return _signed(parsed)


def prompt_signatures(rows: DataFrame, user: Column) -> DataFrame:
    return _signed(rows.withColumn("_p", text.parse_prompt(user)))


def _signed(rows: DataFrame) -> DataFrame:
    # canon holds the one Python step; it runs over whole texts at once, before lines are cut.
    lines = F.transform(F.col("_p.evidence"), lambda x: x)
    joined = text.canon(F.array_join(F.concat(F.array(F.col("_p.claim")), lines), "\u0001"))
    parts = F.transform(F.split(joined, "\u0001"), lambda x: F.trim(x))
    claim, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    seen = F.col("_p").isNotNull()
    return rows.withColumn("sig", F.when(seen, text.signature(claim, rest))).withColumn("set_sig", F.when(seen, text.set_signature(claim, rest))).withColumn("parsed", seen).drop("_p")


def train_eval_gate(pool: DataFrame, protected: DataFrame, assets: tuple[str, ...] = ()) -> DataFrame:
    """Failures of a training pool (row_id, split, user, group_id, gt_row_id) against protected rows (row_id, asset, split, state, group_id).

    Coverage: no protected rows, a named asset of `assets` without any, bad ids or groups,
    unknown splits, states or prompts that don't parse,
    rows that aren't train, an empty pool. Overlaps: same state, same claim with the same
    evidence in another order, same group, same ground-truth row. A shared claim with other
    evidence, or a shared passage, is allowed. Of an asset with splits only val and test are
    protected.
    """
    split = F.lower(F.trim("split"))
    kept = protected.where(F.coalesce(split.isin("val", "validation", "dev", "test"), F.lit(True)))
    # Rendered, parsed and hashed once; the checks below read the hashes alone.
    columns = ["row_id", "sig", "set_sig", "parsed"]
    e = materialize(state_signatures(kept, F.col("state")).select(*columns), "eval_signatures")
    t = materialize(prompt_signatures(pool, F.col("user")).select(*columns), "pool_signatures")
    none = lambda df, code: df.agg(F.count(F.lit(1)).alias("k")).where("k = 0").select(F.lit(code).alias("code"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("sample"))
    ids = kept.select(F.col("row_id").alias("gt")).where("gt is not null").distinct()
    gt = pool.select("row_id", F.coalesce("gt_row_id", "row_id").alias("gt"))
    same = t.join(e.where("sig is not null").select("sig").distinct(), "sig", "left_semi")
    other = t.join(e.where("sig is not null").select("set_sig").distinct(), "set_sig", "left_semi").join(e.select("sig").where("sig is not null").distinct(), "sig", "left_anti")
    groups = pool.join(kept.select("group_id").where("group_id is not null").distinct(), "group_id", "left_semi")
    return _union([
        none(kept, "no_protected_rows"),
        none(pool, "empty_pool"),
        *(none(kept.where(F.col("asset") == a), f"empty_asset_{a}") for a in assets),
        _bad(kept.where("row_id is null or row_id = ''"), "protected_row_id", F.lit("?")),
        _bad(kept.where("group_id is null or group_id = ''"), "protected_group_id", F.col("row_id")),
        _bad(protected.where(~F.coalesce(split.isin("train", "val", "validation", "dev", "test"), F.lit(True))), "unknown_split", F.col("row_id")),
        _bad(e.where(~F.col("parsed")), "unparsed_state", F.col("row_id")),
        _bad(t.where(~F.col("parsed")), "unparsed_prompt", F.col("row_id")),
        _bad(pool.where(~F.coalesce(split == "train", F.lit(False))), "not_train", F.col("row_id")),
        _bad(same, "same_state", F.col("row_id")),
        _bad(other, "same_evidence_reordered", F.col("row_id")),
        _bad(groups, "same_group", F.col("row_id")),
        _bad(gt.join(ids, "gt", "left_semi"), "same_ground_truth_row", F.col("row_id")),
    ])


def straddling(rows: DataFrame, key: str, split: Column) -> DataFrame:
    """(key, splits): keys that stand in more than one split, in one pass over all pairs of splits."""
    kept = rows.select(F.col(key).alias("key"), split.alias("s")).where("key is not null and s is not null")
    return kept.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("splits")).where("splits like '%,%'")


def audit_input_gate(gold: DataFrame, predictions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Failures of one model's answers (row_id, question_id, raw, confidence) against gold (row_id, question_id, target)."""
    from .pairing import problems
    from ..functions import dist

    keys = ["row_id", "question_id"]
    both = gold.select(*keys, "target").join(predictions.select(*keys, "raw", "confidence", F.lit(True).alias("there")), keys, "full")
    found = both.where("target is not null and there").select("row_id", F.explode(problems(F.col("raw"), dist.labels(F.col("target")), F.col("confidence"), tolerance)).alias("code"))
    wrong = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("sample"))
    twice = lambda df, code: _bad(df.groupBy(*keys).count().where("count > 1"), code, F.col("row_id"))
    return _union([
        wrong.select("code", "n", "sample"),
        _bad(both.where("there is null"), "missing_answer", F.col("row_id")),
        _bad(both.where("target is null"), "extra_answer", F.col("row_id")),
        twice(gold, "duplicate_gold"),
        twice(predictions, "duplicate_answer"),
        _bad(gold.where(~dist.is_one_hot(F.col("target"))), "gold_not_one_hot", F.col("row_id")),
    ])


def chat_gate(rows: DataFrame, eval_ids: DataFrame, eval_pairs: DataFrame, held_out: list[str], share: tuple[float, float] = (0.1, 0.6)) -> DataFrame:
    """Failures of chat records: test rows, evaluated ids, held-out schemas, pairs of the evaluation, labels, roles, balance."""
    roles = F.transform("messages", lambda m: m["role"])
    train = rows.where(F.lower(F.trim("split")) == "train")
    n = train.agg(F.count(F.lit(1))).first()[0] or 0
    part = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.lit(max(1, n)))
    ids = lambda s: rows.where(F.lower(F.trim("split")) == s).select("row_id").distinct()
    return _union([
        _bad(rows.where(F.lower(F.trim("split")) == "test"), "test_rows", F.col("row_id")),
        _bad(train.join(eval_ids.select("row_id").distinct(), "row_id", "left_semi"), "evaluated_id", F.col("row_id")),
        _bad(train.where(F.col("schema_id").isin(held_out) if held_out else F.lit(False)), "held_out_schema", F.col("row_id")),
        _bad(train.join(eval_pairs.select("source", "schema_id").distinct(), ["source", "schema_id"], "left_semi"), "evaluated_pair", F.col("row_id")),
        _bad(ids("train").intersect(ids("val")), "train_and_val", F.col("row_id")),
        _bad(rows.where(~F.coalesce(F.array_contains("label_space", F.col("label")), F.lit(False))), "label_not_in_space", F.col("row_id")),
        _bad(rows.where(F.coalesce(F.array_sort(F.map_keys("target_probs")) != F.array_sort("label_space"), F.lit(True))), "targets_not_the_space", F.col("row_id")),
        _bad(rows.where(F.coalesce(F.array_join(roles, ",") != "system,user,assistant", F.lit(True))), "roles", F.col("row_id")),
        _bad(rows.where(F.coalesce(F.get("messages", F.lit(2))["content"] != F.col("label"), F.lit(True))), "answer_not_the_label", F.col("row_id")),
        _bad(part.where(~F.col("share").between(*share)), "label_share", F.col("label")),
    ])


def count_gate(rows: DataFrame, split: Column, expected: dict[str, int]) -> DataFrame:
    """Failures where a split doesn't have exactly its expected number of rows."""
    spark = rows.sparkSession
    want = spark.createDataFrame([(k, int(v)) for k, v in expected.items()], "s string, want bigint")
    have = rows.groupBy(split.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    both = want.join(have, "s", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).where("n <> want")
    return both.select(F.concat(F.lit("count_"), "s").alias("code"), "n", F.col("want").cast("string").alias("sample"))


def plan_gate(plan: DataFrame, allowed: list[str], eval_pairs: DataFrame, eval_states: DataFrame, share: tuple[float, float] = (0.1, 0.6), tolerance: float = 1e-6) -> DataFrame:
    """Failures of a labelled plan (state_key, schema_id, target): wordings not allowed, (state, wording) pairs or states of the evaluation, sums off 1, label balance."""
    from ..functions import dist

    n = plan.count()
    top = plan.groupBy(dist.argmax(F.col("target")).alias("label")).agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("share"))
    return _union([
        _bad(plan.where(~F.col("schema_id").isin(allowed)), "wording_not_allowed", F.col("schema_id")),
        _bad(plan.join(eval_pairs.select("state_key", "schema_id").distinct(), ["state_key", "schema_id"], "left_semi"), "evaluated_pair", F.col("state_key")),
        _bad(plan.join(eval_states.select("state_key").distinct(), "state_key", "left_semi"), "evaluated_state", F.col("state_key")),
        _bad(plan.where(F.abs(dist.total(F.col("target")) - 1) > tolerance), "sum", F.col("state_key")),
        _bad(top.where(~F.col("share").between(*share)), "label_share", F.col("label")),
    ])


def training_rows(rows: DataFrame, split: str = "train", carved: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Chat records to train on: all must be of the split, or it is an error; with carved (groups, ids) those are left out and the rest checked again."""
    from .etl import without_carve

    check(_bad(rows.where(~F.coalesce(F.lower(F.trim("split")) == split, F.lit(False))), f"not_{split}", F.col("row_id")))
    if carved is None:
        return rows
    kept = without_carve(rows, *carved)
    check(_bad(kept.join(carved[0].select("group_id"), "group_id", "left_semi"), "carved_group", F.col("row_id")))
    return kept


def without_test(rows: DataFrame) -> DataFrame:
    """Rows that aren't of the test split; asserts that none of their ids is."""
    test = F.coalesce(F.lower(F.trim("split")) == "test", F.lit(False))
    kept = rows.where(~test)
    check(_bad(kept.join(rows.where(test).select("row_id").distinct(), "row_id", "left_semi"), "test_row", F.col("row_id")))
    return kept
