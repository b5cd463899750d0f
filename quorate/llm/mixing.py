"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize


@dataclass(frozen=True)
class Params:
    """total: weight of the mix, by default that of all records of any target row.

    block: records of one flight; a pair's records are flown in blocks, and what stays
    undecided of all blocks (three records each at most) is flown again. most_targets:
    rows of the target table that the driver takes.
    """

    total: float | None = None
    block: int = 5000
    most_targets: int = 100_000
    seed: int = 17


def key_of(c: Column | str) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def _null_vector(rows: list[list[float]], m: int) -> list[float]:
    """A vector u <> 0 of length m with rows . u = 0; needs fewer independent rows than m."""
    a = [r[:m] for r in rows]
    pivots: list[int] = []
    r = 0
    for c in range(m):
        best = max(range(r, len(a)), key=lambda i: abs(a[i][c]), default=None)
        if best is None or abs(a[best][c]) < 1e-10:
            continue
        a[r], a[best] = a[best], a[r]
        p = a[r][c]
        a[r] = [x / p for x in a[r]]
        for i in range(len(a)):
            if i != r and a[i][c]:
                f = a[i][c]
                a[i] = [x - f * y for x, y in zip(a[i], a[r])]
        pivots.append(c)
        r += 1
        if r == len(a):
            break
    free = next(c for c in range(m) if c not in pivots)
    u = [0.0] * m
    u[free] = 1.0
    for i, c in enumerate(pivots):
        u[c] = -a[i][free]
    return u


def flight(pi: list[float], x: list[list[float]], rng: random.Random, land: bool = False) -> list[float]:
    """The cube method over units with inclusion probabilities pi and balancing values x.

    While more units are undecided than there are balancing values, a few of them move
    along a direction that leaves every balanced total as it is, until one is taken or left;
    the sign is drawn so that each probability keeps its expectation. With land=True the
    last ones go on with the least important value given up, one after another.
    """
    pi = list(pi)
    live = [k for k, p in enumerate(pi) if 1e-9 < p < 1 - 1e-9]
    values = len(x[0]) if x else 0
    need = values
    hand: list[int] = []
    start = {k: pi[k] for k in live}
    live.reverse()
    while True:
        while live and len(hand) < need + 1:
            hand.append(live.pop())
        if len(hand) <= need:
            if not land or not hand:
                break
            need = len(hand) - 1
        rows = [[x[k][j] / start[k] for k in hand] for j in range(need)]
        u = _null_vector(rows, len(hand))
        up = min(((1 - pi[k]) / d if d > 0 else pi[k] / -d) for k, d in zip(hand, u) if abs(d) > 1e-12)
        down = min((pi[k] / d if d > 0 else (1 - pi[k]) / -d) for k, d in zip(hand, u) if abs(d) > 1e-12)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(hand, u):
            pi[k] = min(1.0, max(0.0, pi[k] + step * d))
        done = [k for k in hand if not 1e-9 < pi[k] < 1 - 1e-9]
        for k in done:
            pi[k] = float(round(pi[k]))
        hand = [k for k in hand if k not in done]
    return pi


SCHEMA = "target int, row_id string, weight double, tokens double, start double, pi double"


def _fly(rows: DataFrame, by: list[str], seed: int, land: bool) -> DataFrame:
    def run(key, table):
        table = table.sort_by("row_id").combine_chunks()
        rng = random.Random(f"{seed}:{land}:" + ":".join(str(k.as_py()) for k in key))
        weight, tokens, start = (table.column(c).to_pylist() for c in ("weight", "tokens", "start"))
        mean = (sum(tokens) / len(tokens)) or 1.0
        order = list(range(len(start)))
        rng.shuffle(order)
        pi = table.column("pi").to_pylist()
        # Of equal weights the second value follows from the first, and a null vector is found all the same.
        flown = flight([pi[k] for k in order], [[weight[k] * start[k], tokens[k] / mean * start[k], start[k]] for k in order], rng, land)
        out = [0.0] * len(order)
        for k, p in zip(order, flown):
            out[k] = p
        return table.select(["target", "row_id", "weight", "tokens", "start"]).append_column("pi", pa.array(out, pa.float64()))

    return rows.groupBy(*by).applyInArrow(run, SCHEMA)


@dataclass
class Mix:
    chosen: DataFrame  #: row_id, source, label_source, copies
    report: DataFrame  #: one row per target row, with the share reached


def mix_sources(records: DataFrame, targets: DataFrame, params: Params = Params()) -> Mix:
    """Takes records (row_id, source, label_source, weight, state) so that each target pair has its share of the weight.

    A pair wants target_share x total; each of its records is used floor(r) times, r being
    what is wanted over what there is, and once more with probability r - floor(r), drawn by
    the cube method so that weight, words and number of records come out as expected. A pair
    with r above max_repeat is used max_repeat times and reported as short.

    Keys are compared trimmed and lower-cased; records with a null key, or that match no
    target, take no part; a null weight is 1, a negative or NaN one 0; a record delivered
    twice counts once (lowest `ord` if there is such a column). Target rows of one key are
    added up. Empty tables give an empty mix and a report of zeros.
    """
    spark, p = records.sparkSession, params
    wanted = targets.select("source", "label_source", "target_share", "max_repeat").where("source is not null and label_source is not null")
    wanted = wanted.groupBy(key_of("source").alias("s"), key_of("label_source").alias("l")).agg(
        F.min("source").alias("source"), F.min("label_source").alias("label_source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat")
    )
    plan = wanted.orderBy("s", "l").limit(p.most_targets + 1).collect()
    if len(plan) > p.most_targets:
        raise ValueError(f"more than {p.most_targets} target rows")
    keys = spark.createDataFrame([(r.s, r.l, k) for k, r in enumerate(plan)], "s string, l string, target int")
    ordered = F.col("ord") if "ord" in records.columns else F.lit(0)
    weight = F.coalesce("weight", F.lit(1.0))
    rows = records.where("row_id is not null").select(
        "row_id", key_of("source").alias("s"), key_of("label_source").alias("l"), F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(0.0).alias("weight"),
        F.coalesce(F.regexp_count("state", F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("double").alias("tokens"), ordered.alias("ord"),
    )
    rows = rows.join(F.broadcast(keys), ["s", "l"]).groupBy("row_id").agg(F.min_by(F.struct("target", "weight", "tokens"), "ord").alias("r"))
    rows = materialize(rows.select("row_id", "r.*"), "mix_rows")
    sums = {r.target: r for r in rows.groupBy("target").agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    there = sum(r.w for r in sums.values())
    total = there if p.total is None else p.total
    lines = []
    for k, r in enumerate(plan):
        w, n = (sums[k].w, sums[k].n) if k in sums else (0.0, 0)
        want = r.target_share * total
        short = w * r.max_repeat < want
        ratio = 0.0 if not w else float(r.max_repeat) if short else want / w
        base = int(ratio + 1e-12)
        lines.append((k, r.source, r.label_source, float(r.target_share), int(r.max_repeat), int(n), float(w), float(want), short, base, max(0.0, ratio - base), max(1, -(-n // p.block))))
    form = "target int, source string, label_source string, target_share double, max_repeat int, records bigint, weight bigint, wanted double, short boolean, base int, pi double, blocks int"
    lined = spark.createDataFrame(lines, form.replace("weight bigint", "weight double"))
    ratios = F.broadcast(lined.select("target", "base", F.col("pi").alias("start"), "blocks"))
    units = rows.join(ratios, "target")
    flown = units.where("start > 1e-9").select("target", "row_id", "weight", "tokens", "start", F.col("start").alias("pi"), F.pmod(F.xxhash64("row_id"), "blocks").cast("int").alias("block"))
    sure = None
    while True:
        flown = materialize(_fly(flown, ["target", "block"], p.seed, False), "flown")
        fixed = flown.where("pi = 1").select("row_id", "target")
        sure = fixed if sure is None else sure.unionByName(fixed)
        left = flown.where("pi > 0 and pi < 1")
        most = left.groupBy("target").count().agg(F.max("count")).first()[0] or 0
        if most <= p.block:
            break
        flown = left.withColumn("block", F.pmod(F.xxhash64(F.lit("again"), "row_id"), F.lit(-(-most // p.block))).cast("int"))
    landed = _fly(left, ["target"], p.seed, True).where("pi = 1").select("row_id", "target")
    extra = sure.unionByName(landed).withColumn("extra", F.lit(1))
    used = units.select("row_id", "target", "weight", "tokens", "base").join(extra, ["row_id", "target"], "left")
    used = used.withColumn("copies", F.col("base") + F.coalesce("extra", F.lit(0))).where("copies > 0")
    used = materialize(used.select("row_id", "target", "weight", "tokens", "copies"), "mix")
    reached = used.groupBy("target").agg(F.sum(F.col("weight") * F.col("copies")).alias("reached"), F.sum("copies").alias("draws"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    report = lined.join(reached, "target", "left").fillna(0, ["reached", "draws", "tokens"])
    whole = F.lit(float(reached.agg(F.sum("reached")).first()[0] or 0.0))
    report = report.select(
        "source", "label_source", "target_share", "max_repeat", "records", "weight", "wanted", "short", "draws", "reached", "tokens", F.coalesce(F.try_divide(F.col("reached"), whole), F.lit(0.0)).alias("reached_share")
    )
    names = F.broadcast(lined.select("target", "source", "label_source"))
    return Mix(used.join(names, "target").select("row_id", "source", "label_source", "copies"), report)


def balance(records: DataFrame, mix: Mix) -> DataFrame:
    """(source, label_source, records, weight, expected, least_copies, weight_met, words_met, draws_met, copies_met) of each pair.

    weight_met: reached weight within three records' greatest weight of the expected one.
    words_met, draws_met: words and draws within four records' greatest of the expected ones.
    copies_met: every record that can be in the mix has the least number of copies or one more.
    """
    ordered = F.col("ord") if "ord" in records.columns else F.lit(0)
    weight = F.coalesce("weight", F.lit(1.0))
    rows = records.where("row_id is not null").select(
        "row_id", key_of("source").alias("s"), key_of("label_source").alias("l"), F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(0.0).alias("w"),
        F.coalesce(F.regexp_count("state", F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("double").alias("t"), ordered.alias("ord"),
    )
    rows = rows.groupBy("row_id").agg(F.min_by(F.struct("s", "l", "w", "t"), "ord").alias("r")).select("row_id", "r.*")
    sums = rows.groupBy("s", "l").agg(F.sum("t").alias("t"), F.max("w").alias("max_w"), F.max("t").alias("max_t"))
    used = mix.chosen.groupBy("source", "label_source").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.count(F.lit(1)).alias("used"))
    both = mix.report.join(used, ["source", "label_source"], "left").withColumn("s", key_of("source")).withColumn("l", key_of("label_source")).join(sums, ["s", "l"], "left")
    ratio = F.when(F.col("weight") > 0, F.least(F.col("max_repeat").cast("double"), F.col("wanted") / F.col("weight"))).otherwise(0.0)
    both = both.withColumn("ratio", ratio).withColumn("base", F.floor(F.col("ratio") + 1e-12).cast("int"))
    near = lambda x, y, by: F.coalesce(F.abs(x - y) <= by + 1e-6, F.lit(True))
    fine = (F.col("lo") >= F.greatest(F.col("base"), F.lit(1))) & (F.col("hi") <= F.col("base") + 1) & ((F.col("base") == 0) | (F.col("used") == F.col("records")))
    return both.select(
        "source", "label_source", "records", F.round("weight", 6).alias("weight"), F.round(F.col("weight") * F.col("ratio"), 6).alias("expected"), F.col("base").alias("least_copies"),
        near(F.col("reached"), F.col("weight") * F.col("ratio"), 3 * F.col("max_w")).alias("weight_met"), near(F.col("tokens"), F.col("t") * F.col("ratio"), 4 * F.col("max_t")).alias("words_met"),
        near(F.col("draws"), F.col("records") * F.col("ratio"), F.lit(4.0)).alias("draws_met"), F.coalesce(fine, F.lit(True)).alias("copies_met"),
    )
