"""Paired comparison of two models (pairing.side_by_side)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def discordant(both: DataFrame) -> DataFrame:
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("ok_a") == 1) & (F.col("ok_b") == 0)).alias("only_a"), F.count_if((F.col("ok_a") == 0) & (F.col("ok_b") == 1)).alias("only_b"))


def mcnemar(both: DataFrame) -> DataFrame:
    """Discordant counts with the exact two-sided binomial p, summed in log space, and the asymptotic z.

    Without discordant pairs p is 1 and z null.
    """
    d = discordant(both)
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # The tail over 0..k of C(n, i) / 2^n, each log-term from the one before.
    terms = F.aggregate(
        F.when(F.col("k") > 0, F.sequence(F.lit(1), F.col("k").cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0.0).alias("l"), F.exp(-F.col("m") * F.ln(F.lit(2.0))).alias("s")),
        lambda a, i: F.struct((a["l"] + F.ln(F.col("m") - i + 1) - F.ln(i)).alias("l"), (a["s"] + F.exp(a["l"] + F.ln(F.col("m") - i + 1) - F.ln(i) - F.col("m") * F.ln(F.lit(2.0)))).alias("s")),
        lambda a: a["s"],
    )
    d = d.withColumn("m", n).withColumn("k", k)
    p = F.when(F.col("m") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms))
    z = F.try_divide(F.abs(F.col("only_a") - F.col("only_b")).cast("double"), F.sqrt(F.col("m")))
    return d.select("n", "only_a", "only_b", p.alias("p_exact"), z.alias("z"))


def asymptotic_p(z: float | None) -> float:
    """erfc(z / sqrt 2); 1 without a z."""
    return 1.0 if z is None else math.erfc(z / math.sqrt(2))


def bootstrap_interval(both: DataFrame, resamples: int = 6000, seed: int = 11) -> tuple[float, float, float]:
    """Mean difference of accuracy (b - a) with its 95 % percentile interval.

    A resample's mean depends only on how often each of -1, 0, 1 was drawn, so resamples are
    multinomial draws from the three counts, whatever the number of rows.
    """
    r = discordant(both).first()
    n = r.n or 0
    if not n:
        raise ValueError("no pairs")
    rng = np.random.default_rng(seed)
    draws = rng.multinomial(n, [r.only_a / n, r.only_b / n, 1 - (r.only_a + r.only_b) / n], resamples)
    means = (draws[:, 1] - draws[:, 0]) / n
    low, high = np.percentile(means, [2.5, 97.5])
    return (r.only_b - r.only_a) / n, float(low), float(high)


def prediction_regression(old: DataFrame, new: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whether two runs (row_id, question_id, answer) agree: same first labels, and the greatest difference within tolerance."""
    from ..functions import dist

    rows = old.select("row_id", "question_id", F.col("answer").alias("x")).join(new.select("row_id", "question_id", F.col("answer").alias("y")), ["row_id", "question_id"])
    delta = F.array_max(F.transform("x", lambda e: F.abs(e["p"] - dist.p_of(F.col("y"), e["label"]))))
    moved = dist.argmax(F.col("x")) != dist.argmax(F.col("y"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.max(delta).alias("max_delta"), F.count_if(moved).alias("moved"))
    return out.withColumn("passed", (F.col("moved") == 0) & (F.col("max_delta") < tolerance))
