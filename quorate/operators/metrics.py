"""Classification and calibration metrics over paired rows (pairing.paired), grouped by `by`.

Every metric is one aggregation with map-side combine unless it ranks; ranks come from
counts of distinct values, in ranges of them (`below`), so no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist

EPS = 1e-15


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def below(per: DataFrame, by: list[str], value: str, sums: list[str], ranges: int = 256) -> DataFrame:
    """per (by, value, sums; values distinct in a group) with each sum over the smaller values (below_x) and over all (all_x).

    Approximate percentiles cut each group's values into even ranges; the ranges' sums are
    added up first, then the values inside each, so that a group is spread over many tasks.
    """
    grid = [k / ranges for k in range(1, ranges)]
    edges = per.groupBy(*by).agg(F.percentile_approx(value, grid, 4 * ranges).alias("_e"))
    cut = per.join(edges, by) if by else per.crossJoin(edges)  # one row of edges a group
    cut = cut.withColumn("_r", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    tops = cut.groupBy(*by, "_r").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # `ranges` rows a group
    whole = Window.partitionBy(*by)
    tops = tops.select(*by, "_r", *(F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums), *(F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums))
    inside = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(tops, [*by, "_r"])
    return out.select(*per.columns, *(f"all_{s}" for s in sums), *((F.col(f"_b_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"below_{s}") for s in sums))


def accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


def ensemble(answers: DataFrame, by: list[str], voter: str, digits: int | None = 10) -> DataFrame:
    """(by, answer): the mean of the voters' answers (wordings of a question, or models), label by label; labels in their order by name.

    A label that a voter doesn't have counts as 0 there. Rounded to digits, so that equal sums tie.
    """
    n = F.size(F.collect_set(voter)).alias("_n")
    voters = answers.groupBy(*by).agg(n)  # a few voters each
    long = answers.select(*by, F.explode("answer").alias("e")).groupBy(*by, F.col("e.label").alias("label")).agg(F.sum("e.p").alias("p"))
    mean = F.col("p") / F.col("_n") if digits is None else F.round(F.col("p") / F.col("_n"), digits)
    return long.join(voters, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("label", mean.alias("p")))).alias("answer"))


def losses(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Multiclass Brier score and negative log-likelihood of the gold label."""
    p = F.greatest(dist.p_of(F.col("answer"), F.col("gold")), F.lit(EPS))
    return pairs.groupBy(*by).agg(F.avg(dist.brier(F.col("answer"), F.col("target"))).alias("brier"), F.avg(-F.ln(p)).alias("nll"))


def soft_loss(pairs: DataFrame, by: list[str], source_weight: dict[str, float] | None = None) -> DataFrame:
    """Soft cross-entropy, each row times its weight (1 if null) and its source's."""
    weight = F.coalesce("weight", F.lit(1.0))
    if source_weight:
        m = F.create_map(*(F.lit(x) for kv in sorted(source_weight.items()) for x in (kv[0], float(kv[1]))))
        weight = weight * F.coalesce(F.try_element_at(m, F.lower(F.trim("source"))), F.lit(1.0))
    return pairs.groupBy(*by).agg(F.avg(dist.soft_cross_entropy(F.col("answer"), F.col("target")) * weight).alias("loss"))


def label_dimension(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The labels of the targets, for each group."""
    return pairs.select(*by, F.explode(dist.labels(F.col("target"))).alias("label")).distinct()


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of gold x predicted label, zeros included."""
    space = label_dimension(pairs, by)
    cells = space.withColumnRenamed("label", "gold").join(space.withColumnRenamed("label", "pred"), by)
    return cells.join(pairs.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n")), [*by, "gold", "pred"], "left").fillna(0, ["n"])


def per_label(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where a denominator is."""
    long = pairs.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.col("ok").alias("h")))).alias("x")).select(*by, "x.*")
    sums = long.groupBy(*by, "label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    rows = label_dimension(pairs, by).join(sums, [*by, "label"], "left").fillna(0, ["support", "predicted", "hits"])
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return rows.select(*by, "label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def macro_f1(pairs: DataFrame, by: list[str]) -> DataFrame:
    return per_label(pairs, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def _bin(c: Column, bins: int, left_open: bool = False) -> Column:
    """The equal-width bin of c by comparison with the edges b / bins; null outside of [0, 1]."""
    edges = [b / bins for b in range(bins + 1)]
    out = F.when(F.lit(False), F.lit(0))
    for b in range(bins):
        inside = (c > edges[b]) & (c <= edges[b + 1]) if left_open else (c >= edges[b]) & ((c < edges[b + 1]) if b < bins - 1 else (c <= edges[b + 1]))
        out = out.when(inside, F.lit(b))
    return out


def _ece(rows: DataFrame, by: list[str], conf: Column, correct: Column, bin_: Column, name: str) -> DataFrame:
    """Calibration error over bins: rows outside of all bins count only in n."""
    per = rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.avg(conf).alias("c"), F.avg(correct.cast("double")).alias("a"))
    gap = F.when(F.col("bin").isNotNull(), F.col("m") * F.abs(F.col("a") - F.col("c"))).otherwise(0.0)
    return per.groupBy(*by).agg((F.sum(gap) / F.sum("m")).alias(name))


def ece_uniform(pairs: DataFrame, by: list[str], conf: str = "conf", bins: int = 10) -> DataFrame:
    """Equal-width bins [lo, hi), the last one closed."""
    return _ece(pairs, by, F.col(conf), F.col("ok"), _bin(F.col(conf), bins), "ece")


def ece_soft(pairs: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """The training variant: bins (lo, hi] of the highest probability; correctness is the target's mass on the answer."""
    mass = dist.p_of(F.col("target"), F.col("pred"))
    return _ece(pairs, by, F.col("top"), mass, _bin(F.col("top"), bins, left_open=True), "ece_soft")


def ece_adaptive(pairs: DataFrame, by: list[str], conf: str = "conf", bins: int = 10) -> DataFrame:
    """Bins of equal count by stable rank (row_id, question_id among ties); ties may straddle.

    Ranks come from counts per distinct confidence; only the confidences at which a bin ends
    are ranked row by row.
    """
    per = pairs.groupBy(*by, F.col(conf).alias("c")).agg(F.count(F.lit(1)).alias("m"), F.sum("ok").alias("hits"))
    per = below(per, by, "c", ["m"]).select(*by, "c", "m", "hits", F.col("below_m").alias("s"), F.col("all_m").alias("n"))

    def tile(at: Column) -> Column:
        """The bin of a place: the first n % bins bins are larger by one."""
        size, more = F.floor(F.col("n") / bins), F.col("n") % bins
        return F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))

    per = per.withColumn("first", tile(F.col("s"))).withColumn("last", tile(F.col("s") + F.col("m") - 1))
    whole = per.where("first = last").select(*by, F.col("first").alias("bin"), "n", "m", (F.col("m") * F.col("c")).alias("conf_sum"), "hits")
    cut = per.where("first < last").select(*by, "c", "s", "n")
    rows = pairs.select(*by, F.col(conf).alias("c"), "ok", "row_id", "question_id").join(F.broadcast(cut), [*by, "c"])  # fewer than bins rows a group
    place = F.col("s") + F.row_number().over(Window.partitionBy(*by, "c").orderBy("row_id", "question_id")) - 1
    split = rows.withColumn("at", place).select(*by, tile(F.col("at")).alias("bin"), "n", F.lit(1).cast("bigint").alias("m"), F.col("c").alias("conf_sum"), F.col("ok").cast("bigint").alias("hits"))
    sums = whole.unionByName(split).groupBy(*by, "bin").agg(F.max("n").alias("n"), F.sum("conf_sum").alias("c"), F.sum("hits").alias("h"))
    return sums.groupBy(*by).agg((F.sum(F.abs(F.col("h") - F.col("c"))) / F.max("n")).alias("ece_adaptive"))


def ece_one_vs_rest(pairs: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Per label the error of its probability against being the gold one."""
    long = pairs.select(*by, "gold", "answer", F.explode(dist.labels(F.col("target"))).alias("label"))
    long = long.select(*by, "label", dist.p_of(F.col("answer"), F.col("label")).alias("p"), (F.col("gold") == F.col("label")).cast("int").alias("hit"))
    return _ece(long, [*by, "label"], F.col("p"), F.col("hit"), _bin(F.col("p"), bins), "ece")


def ece_macro(pairs: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """The mean of the labels' errors."""
    return ece_one_vs_rest(pairs, by, bins).groupBy(*by).agg(F.avg("ece").alias("ece_macro"))


def confidence_gap(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Stored confidence against highest probability: both calibration errors, greatest and mean difference."""
    kept = pairs.where(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    gap = F.abs(F.col("confidence") - F.col("top"))
    out = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"))
    stored, top = ece_uniform(kept, by, "confidence"), ece_uniform(kept, by, "top")
    return out.join(stored.withColumnRenamed("ece", "ece_stored"), by).join(top.withColumnRenamed("ece", "ece_top"), by)


def reliability(pairs: DataFrame, by: list[str], bins: int = 10, least: int = 0) -> DataFrame:
    """Bins min(int(conf x bins), bins - 1) with mean confidence and accuracy; empty ones too, with nulls, unless least is set."""
    b = F.greatest(F.least((F.col("conf") * bins).cast("int"), F.lit(bins - 1)), F.lit(0))
    per = pairs.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_confidence"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    if least:
        return per.where(F.col("n") >= least)
    frame = pairs.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(per, [*by, "bin"], "left").fillna(0, ["n"])


def selective_risk(pairs: DataFrame, by: list[str], targets: tuple[float, ...] = (0.5, 0.8, 0.9)) -> DataFrame:
    """Risk among the most confident share of rows; all rows tied with the last one are kept.

    Ranks come from counts per distinct confidence, which are combined before the shuffle.
    """
    per = below(pairs.groupBy(*by, "conf").agg(F.count(F.lit(1)).alias("m"), F.sum("ok").alias("hits")), by, "conf", ["m", "hits"])
    n, k, h = F.col("all_m"), F.col("all_m") - F.col("below_m"), F.col("all_hits") - F.col("below_hits")
    rows = per.select("*", n.alias("n"), k.alias("k"), h.alias("h"), (k - F.col("m")).alias("above"), F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target"))
    want = F.ceil(F.col("target") * F.col("n"))
    rows = rows.where((F.col("above") < want) & (F.col("k") >= want))
    return rows.select(*by, F.col("target").alias("target_coverage"), F.col("conf").alias("threshold"), F.col("k").alias("selected"), (F.col("k") / F.col("n")).alias("coverage"), (1 - F.col("h") / F.col("k")).alias("risk"))


def recall_strata(pairs: DataFrame, by: list[str], stratum: str) -> DataFrame:
    """Accuracy of each stratum and recall of each gold label in it, in one pass of grouping sets; label null: the stratum."""
    rows = pairs.groupingSets([[*by, stratum], [*by, stratum, "gold"]], *by, stratum, "gold")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("recall")).withColumnRenamed("gold", "label")


def tie_sensitivity(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Answers with tied highest probabilities, and accuracy if ties went by label order."""
    tied = (dist.ties(F.col("answer")) > 1).cast("int")
    other = (dist.argmax_sorted(F.col("answer")) == F.col("gold")).cast("double")
    return pairs.groupBy(*by).agg(F.sum(tied).alias("ties"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg(other).alias("accuracy_sorted"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where either side doesn't vary."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of answers with soft targets: same first label, mean total variation, correlation of confidence and match."""
    ok = F.col("ok").cast("double")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("top1"), F.avg(dist.total_variation(F.col("answer"), F.col("target"))).alias("mean_tv"), pearson(F.col("conf"), ok).alias("conf_match"))


def flips(both: DataFrame, most: int = 20) -> DataFrame:
    """Label moves from model a to model b, with what they fixed and broke; the most frequent ones."""
    moved = both.where("pred_a <> pred_b").groupBy("pred_a", "pred_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("ok_a") == 0) & (F.col("ok_b") == 1)).alias("fixed"),
        F.count_if((F.col("ok_a") == 1) & (F.col("ok_b") == 0)).alias("broke"),
    )
    moved = moved.withColumn("neither", F.col("n") - F.col("fixed") - F.col("broke"))
    return moved.orderBy(F.desc("n"), "pred_a", "pred_b").limit(most)


def headroom(both: DataFrame) -> DataFrame:
    """What an oracle that picks the better of two answers would add: rows that a, b, either and neither got right."""
    a, b = F.col("ok_a") == 1, F.col("ok_b") == 1
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("right_a"), F.count_if(b).alias("right_b"), F.count_if(a | b).alias("either"), F.count_if(~a & ~b).alias("neither"))


def recall_change(both: DataFrame) -> DataFrame:
    """Recall of each class for two models, the difference, and how many rows that is."""
    rows = both.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok_a").cast("double")).alias("recall_a"), F.avg(F.col("ok_b").cast("double")).alias("recall_b"))
    return rows.withColumn("delta", F.col("recall_b") - F.col("recall_a")).withColumn("rows", F.round(F.col("delta") * F.col("n")).cast("bigint"))


def over_claims(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Shares of refuted and undecided rows that were answered as supported."""
    def share(label: str) -> Column:
        return ratio(F.count_if((F.col("gold") == label) & (F.col("pred") == "supported")), F.count_if(F.col("gold") == label))

    return pairs.groupBy(*by).agg(share("refuted").alias("refuted_as_supported"), share("not_enough_info").alias("undecided_as_supported"))


def with_and_without(pairs: DataFrame, by: list[str], shortcut: Column) -> DataFrame:
    """Accuracy over all rows and over those that no shortcut answered, in one pass."""
    ok, rest = F.col("ok").cast("double"), ~F.coalesce(shortcut, F.lit(False))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("accuracy"), F.count_if(rest).alias("n_rest"), F.avg(F.when(rest, ok)).alias("accuracy_rest"))


def rollup_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by two columns, with totals; the flags tell a total from a null value."""
    out = rows.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping(outer).cast("int").alias("all_outer"), F.grouping(inner).cast("int").alias("all_inner"))
    return out


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n, one column a place): the values at places (from 0, expressions over n) of each group's ascending order; nulls are left out."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    per = below(per, by, value, ["m"]).withColumn("n", F.col("all_m"))
    held = lambda at: (F.col("below_m") <= at) & (at < F.col("below_m") + F.col("m"))
    return per.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(held(at), F.col(value))).alias(name) for name, at in places.items()))


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p n)."""
    return at_places(rows, by, value, {f"p{round(100 * p)}": F.greatest(F.ceil(F.col("n") * F.lit(float(p))), F.lit(1)) - 1 for p in shares})


def floor_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The value at index min(n - 1, int(p n)), a different definition."""
    return at_places(rows, by, value, {"value": F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(share))))})


def spread(rows: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Median, least, greatest, and the share above a limit."""
    v = F.col(value)
    middle = at_places(rows, by, value, {"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)})
    ends = rows.groupBy(*by).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg((v > limit).cast("double")).alias("over"))
    return ends.join(middle, by).select(*by, ((F.col("lo") + F.col("hi")) / 2).alias("median"), "least", "most", "over")


def length_stats(rows: DataFrame, by: list[str], length: Column, limit: int) -> DataFrame:
    """Rows, mean, median and 95 % place (nearest rank), greatest length, and how many are above a limit."""
    sized = rows.select(*by, length.cast("bigint").alias("length")).where("length is not null")
    ranks = nearest_rank(sized, by, "length")
    sums = sized.groupBy(*by).agg(F.avg("length").alias("mean"), F.max("length").alias("most"), F.count_if(F.col("length") > limit).alias("over"))
    return sums.join(ranks, by).select(*by, "n", "mean", "p50", "p95", "most", "over")


def cost(answers: DataFrame, price: float = 0.042 / 1e6, fallback: int = 450) -> DataFrame:
    """Live and cached requests, tokens (fallback where unknown) and money, of (cached, tokens)."""
    live = ~F.coalesce("cached", F.lit(False))
    tokens = F.sum(F.when(live, F.coalesce("tokens", F.lit(fallback))).otherwise(0)).alias("tokens")
    out = answers.agg(F.count_if(live).alias("live"), F.count_if(~live).alias("cached"), tokens)
    return out.withColumn("usd", F.coalesce("tokens", F.lit(0)) * F.lit(price))


def reward_terms(pairs: DataFrame, by: list[str], saturated: float = 0.99) -> DataFrame:
    """Expected reward (mass on the target), KL from the target, entropy, and the share of saturated answers."""
    a, t = F.col("answer"), F.col("target")
    reward = F.aggregate(t, F.lit(0.0), lambda s, g: s + g["p"] * dist.p_of(a, g["label"]))
    return pairs.groupBy(*by).agg(F.avg(reward).alias("reward"), F.avg(dist.kl(t, a)).alias("kl"), F.avg(dist.entropy(a)).alias("entropy"), F.avg((F.col("top") > saturated).cast("double")).alias("saturated"))


def policy_terms(pairs: DataFrame, by: list[str], clip: float = 1.0) -> DataFrame:
    """Policy-gradient loss of the given answers: reward against the group's mean, clipped, times log-probability."""
    reward = F.col("ok").cast("double")
    rows = pairs.join(pairs.groupBy(*by).agg(F.avg(reward).alias("baseline")), by)
    advantage = dist.clip(reward - F.col("baseline"), -clip, clip)
    loss = -advantage * F.ln(F.greatest(F.col("top"), F.lit(EPS)))
    return rows.groupBy(*by).agg(F.avg(loss).alias("loss"), F.first("baseline").alias("baseline"), F.stddev_pop(reward).alias("reward_std"), (F.stddev_pop(reward) == 0).alias("degenerate"))
