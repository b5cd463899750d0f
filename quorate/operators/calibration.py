"""Post-hoc calibration: temperature and isotonic maps, fitted with aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from . import metrics

LOW, HIGH = 0.05, 20.0


def grid_losses(pairs: DataFrame, by: list[str], temperatures: list[float]) -> DataFrame:
    """Mean soft cross-entropy at each temperature, all in one pass over the rows."""
    rows = pairs.select(*by, "answer", "target", F.explode(F.array(*(F.lit(float(t)) for t in temperatures))).alias("t"))
    hot = F.transform("answer", lambda e: dist.entry(e["label"], F.ln(F.greatest(e["p"], F.lit(metrics.EPS))) / F.col("t")))
    return rows.groupBy(*by, "t").agg(F.avg(dist.soft_cross_entropy(dist.softmax(hot), F.col("target"))).alias("loss"))


def fit_temperature(pairs: DataFrame, passes: int = 4, points: int = 17) -> float:
    """The temperature of least soft cross-entropy, within [0.05, 20]; 1 without rows.

    Each pass evaluates a grid in ln T at once and the next refines around its best point;
    the loss has one minimum in 1/T.
    """
    low, high = math.log(LOW), math.log(HIGH)
    best = 0.0
    for _ in range(passes):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        found = grid_losses(pairs, [], [math.exp(x) for x in grid]).collect()
        if not found:
            return 1.0
        best = min(found, key=lambda r: (r.loss, r.t)).t
        width = (high - low) / (points - 1)
        low, high = max(math.log(LOW), math.log(best) - width), min(math.log(HIGH), math.log(best) + width)
    return best


#: Steps of the probabilities in the isotonic fit; what it keeps is as long as this, whatever the rows.
STEPS = 4096


def isotonic_knots(pairs: DataFrame, question: str) -> list[tuple[float, float]]:
    """Knots (x, y) of a monotone map from probability to target probability for one question.

    Positive probabilities only, rounded to 1 / STEPS; fewer than three points or all of one
    value give the identity. Points of one step are summed up where they are; the sums, at
    most STEPS + 1, are pooled (adjacent violators) on the driver.
    """
    long = pairs.where(F.col("question_id") == question).select("target", F.explode("answer").alias("e"))
    long = long.where("e.p > 0").select(F.round(F.col("e.p") * STEPS).alias("k"), dist.p_of(F.col("target"), F.col("e.label")).alias("y"))
    rows = long.groupBy("k").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
    if sum(r.n for r in rows) < 3 or len(rows) < 2:
        return [(0.0, 0.0), (1.0, 1.0)]
    blocks: list[list[float]] = []  # first x, last x, sum of y, points
    for r in rows:
        blocks.append([r.k / STEPS, r.k / STEPS, r.y, r.n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, y, n = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + y, blocks[-1][3] + n]
    return [(x, y / n) for lo, hi, y, n in blocks for x in ((lo,) if lo == hi else (lo, hi))]


def with_isotonic(pairs: DataFrame, knots: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """answer through each question's map; questions without one stay as they are."""
    form = "array<struct<x:double,y:double>>"
    chosen = F.lit(None).cast(form)
    for q, k in sorted(knots.items()):
        lit = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in k)).cast(form)
        chosen = F.when(F.col("question_id") == q, lit).otherwise(chosen)
    return refreshed(pairs.withColumn("answer", dist.apply_isotonic(F.col("answer"), chosen)))


def with_temperature(pairs: DataFrame, t: float | Column) -> DataFrame:
    return refreshed(pairs.withColumn("answer", dist.temperature(F.col("answer"), t)))


def refreshed(pairs: DataFrame) -> DataFrame:
    """The columns that follow from answer, anew."""
    out = pairs.withColumn("pred", dist.argmax(F.col("answer"))).withColumn("top", dist.top(F.col("answer")))
    return out.withColumn("ok", (F.col("pred") == F.col("gold")).cast("int")).withColumn("conf", F.col("top"))


def report(pairs: DataFrame, knots: dict[str, list[tuple[float, float]]], t: float) -> DataFrame:
    """Soft calibration error before, with the temperature and with the isotonic maps."""
    parts = [(name, metrics.ece_soft(df, [])) for name, df in (("none", pairs), ("temperature", with_temperature(pairs, t)), ("isotonic", with_isotonic(pairs, knots)))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("method"), "ece_soft")
        out = row if out is None else out.unionByName(row)
    return out
