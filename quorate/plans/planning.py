"""Sampling plans: stratified quotas over (state, wording) pairs, cycles, chunks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.etl import hash_order


def schema_splits(schemas: list[tuple[str, str]]) -> dict[str, str]:
    """Wordings (id, kind) to splits: the last two of each kind go to val and test, one each, the others to train."""
    out = {s: "train" for s, _ in schemas}
    for kind in dict.fromkeys(k for _, k in schemas):
        own = [s for s, k in schemas if k == kind]
        if len(own) > 2:
            out[own[-2]], out[own[-1]] = "val", "test"
    return out


def every_kth(rows: DataFrame, k: int, order: str = "ord", variants: int = 5) -> DataFrame:
    """Every k-th row in order, from the first, with the number of its alternative wording."""
    return numbered(rows, order).where(F.col("i") % k == 0).withColumn("variant", F.floor(F.col("i") / k) % variants)


def numbered(rows: DataFrame, order: str = "ord", block: int = 10_000) -> DataFrame:
    """rows with their place i (from 0) by a numeric order: counts of blocks of the order first, then ranks inside each."""
    rows = rows.withColumn("_b", F.floor(F.col(order) / block))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("m")).withColumn("_s", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")  # a row a block
    return rows.join(starts, "_b").withColumn("i", F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1).drop("_b", "_s")


def cycle(offset: Column, n: int, k: int) -> Column:
    """k places of a cycle of n, from offset on."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: ((offset + j) % n).cast("int"))


def strided(rows: DataFrame, workers: int, order: str = "ord") -> DataFrame:
    """Chunk number order % workers; sort by order again to restore the input."""
    return rows.withColumn("chunk", F.col(order) % workers)


def length_batches(rows: DataFrame, length: Column, size: int, within: str = "chunk") -> DataFrame:
    """Batches of rows of similar length, inside each chunk."""
    w = Window.partitionBy(within).orderBy(length, "row_id")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def runs(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Numbers runs of equal neighbouring values (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    flagged = rows.withColumn("_c", F.when(first, 1).otherwise(changed))
    return flagged.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def stratum_quotas(counts: DataFrame, labels: list[str], target: int, wordings: int, synthetic_share: float, caps: tuple[int, int]) -> DataFrame:
    """(label, synthetic, want, per): pairs that each stratum gives and how many wordings a state takes, from (label, synthetic, states).

    One expression over the labels in their order: each gets an even part of what is still to
    be had over the labels still to come, so what one cannot give goes to the next ones.
    """
    spark = counts.sparkSession
    names = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "place int, label string")
    ends = counts.groupBy("label").agg(*(F.coalesce(F.sum(F.when(F.col("synthetic") == flag, F.col("states"))), F.lit(0)).alias(c) for c, flag in (("made", True), ("found", False))))
    held = names.join(ends, "label", "left").fillna(0, ["made", "found"])
    row = held.agg(F.array_sort(F.collect_list(F.struct("place", "label", "made", "found"))).alias("labels"))  # a handful of labels
    most_found, most_made = (min(c, wordings) for c in caps)
    each = lambda want, states, most: F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(want / F.greatest(states, F.lit(1))))).cast("bigint")

    def give(past: Column, x: Column) -> Column:
        part = F.floor(past["open"] / (F.lit(len(labels)) - x["place"])).cast("bigint")
        made = F.least(F.bround(part * F.lit(synthetic_share)).cast("bigint"), x["made"] * most_made)
        found = F.least(part - made, x["found"] * most_found)
        line = F.struct(x["label"].alias("label"), made.alias("made"), each(made, x["made"], most_made).alias("per_made"), found.alias("found"), each(part - made, x["found"], most_found).alias("per_found"))
        return F.struct((past["open"] - made - found).alias("open"), F.concat(past["lines"], F.array(line)).alias("lines"))

    start = F.struct(F.lit(target).cast("bigint").alias("open"), F.array().cast("array<struct<label:string,made:bigint,per_made:bigint,found:bigint,per_found:bigint>>").alias("lines"))
    lines = row.select(F.inline(F.aggregate("labels", start, give, lambda s: s["lines"])))
    made, found = lines.select("label", F.lit(True).alias("synthetic"), F.col("made").alias("want"), F.col("per_made").alias("per")), lines.select("label", F.lit(False).alias("synthetic"), F.col("found").alias("want"), F.col("per_found").alias("per"))
    return made.unionByName(found)


def quota_plan(states: DataFrame, schemas: list[str], labels: list[str], target: int, synthetic_share: float = 0.1, caps: tuple[int, int] = (6, 3), seed: int = 42) -> DataFrame:
    """(state_key, label, synthetic, schema_id, shuffle): about `target` pairs of a state and a wording, near equal by label, no pair twice.

    states: (state_key, label, synthetic). A state that stands under several labels, or is
    both found and synthetic, counts once: found before synthetic, then in the order of the
    labels. A share of each label's quota comes from synthetic states (at most caps[1]
    wordings a state), the rest from the others (at most caps[0]). A state takes consecutive
    wordings of the cycle. Pairs are taken in hash order, by ranks within hash prefixes.
    """
    order = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("label"))
    known = states.where("state_key is not null").where(F.col("label").isin(labels)).withColumn("synthetic", F.coalesce("synthetic", F.lit(False)))
    distinct = known.groupBy("state_key").agg(F.min_by(F.struct("label", "synthetic"), F.struct("synthetic", order)).alias("s")).select("state_key", "s.*")
    counts = distinct.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("states"))
    want = stratum_quotas(counts, labels, target, len(schemas), synthetic_share, caps)
    rows = distinct.join(F.broadcast(want), ["label", "synthetic"]).withColumn("h", hash_order(seed, "state_key")).withColumn("p", F.substring("h", 1, 3))  # two rows a label
    sizes = rows.groupBy("label", "synthetic", "p").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("label", "synthetic").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("s", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")  # at most 4096 rows a stratum
    inside = Window.partitionBy("label", "synthetic", "p").orderBy("h", "state_key")
    rows = rows.join(F.broadcast(sizes), ["label", "synthetic", "p"]).withColumn("i", F.col("s") + F.row_number().over(inside) - 1)
    ids = F.array(*(F.lit(s) for s in schemas))
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("per") - 1), lambda j: F.struct((F.col("i") * F.col("per") + j).alias("place"), F.get(ids, ((F.col("i") + j) % len(schemas)).cast("int")).alias("schema_id")))
    plan = rows.select("state_key", "label", "synthetic", "want", F.inline(places)).where("place < want")
    return plan.select("state_key", "label", "synthetic", "schema_id", F.md5(F.concat_ws(":", F.lit(str(seed)), "state_key", "schema_id")).alias("shuffle"))


def eval_plan(states: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every held-out state with the wordings of its split: an equi-join on the small side."""
    return states.join(F.broadcast(schemas), "split")


def estimate(rows: DataFrame, tokens: int = 450, price: float = 0.042 / 1e6) -> float:
    """Money a plan will cost, before anything runs."""
    return rows.count() * tokens * price


def affordable(rows: DataFrame, budget: float, tokens: int = 450, price: float = 0.042 / 1e6) -> DataFrame:
    """The rows of a plan, or an error before anything runs if it would cost more than the budget."""
    cost = estimate(rows, tokens, price)
    if cost > budget:
        raise ValueError(f"the plan costs {cost:.4f}, the budget is {budget:.4f}")
    return rows


def written_within_budget(answers: DataFrame, path: str, budget: float, **kinds) -> int:
    """Writes answers (ord, tokens, ...) if all of them fit the budget; else an error, and nothing is written. Returns their number."""
    n, kept = answers.count(), within_budget(answers, budget, **kinds).count()
    if kept < n:
        raise ValueError(f"the budget ends after {kept} of {n} answers; nothing was written")
    answers.write.mode("errorifexists").parquet(path)
    return n


def within_budget(rows: DataFrame, budget: float, order: str = "ord", tokens: str = "tokens", fallback: int = 450, price: float = 0.042 / 1e6, block: int = 10_000) -> DataFrame:
    """Rows in order up to where one more could pass the budget (spent so far and a fallback for the next).

    The running sum goes over blocks of the order first, then inside each block, so no task holds all rows.
    """
    t = F.coalesce(tokens, F.lit(fallback)).cast("bigint")
    rows = rows.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_t", t)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_b").agg(F.sum("_t").alias("m")).withColumn("_s", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")  # a row a block
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_s") + F.coalesce(F.sum("_t").over(inside), F.lit(0))
    rows = rows.join(starts, "_b").withColumn("_spent", spent)
    return rows.where((F.col("_spent") + fallback) * F.lit(price) <= F.lit(budget)).drop("_b", "_t", "_s", "_spent")


def stopped_at(history: list[float], patience: int, least: float = 1e-4) -> int | None:
    """The epoch at which training stops: after `patience` epochs without an improvement of more than least; None if it never does."""
    best, waited = float("inf"), 0
    for k, loss in enumerate(history):
        if loss < best - least:
            best, waited = loss, 0
        else:
            waited += 1
            if waited >= patience:
                return k
    return None


def stopping_epoch(history: Column, patience: int, least: float = 1e-4) -> Column:
    """stopped_at over a column of loss histories (array of doubles), as one fold; null where training goes on to the end."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, loss: Column) -> Column:
        better = loss < s["best"] - least
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        stop = F.coalesce(s["stop"], F.when(waited >= patience, s["k"]))
        return F.struct(F.when(better, loss).otherwise(s["best"]).alias("best"), waited.alias("waited"), (s["k"] + 1).alias("k"), stop.alias("stop"))

    return F.aggregate(history, start, step, lambda s: s["stop"])


def search_order(options: DataFrame, threshold: float) -> DataFrame:
    """(puzzle_id, cell, value, p) in the order to try, most probable first; those below the threshold go, unless none passes it."""
    passes = F.max((F.col("p") >= threshold).cast("int")).over(Window.partitionBy("puzzle_id", "cell"))
    kept = options.withColumn("_any", passes).where((F.col("_any") == 0) | (F.col("p") >= threshold)).drop("_any")
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy("puzzle_id", "cell").orderBy(F.desc("p"), "value")))
