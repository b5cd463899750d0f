"""Pairing, metrics and significance against hand-computed values and published counts."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quorate.functions import dist
from quorate.operators import calibration as cal
from quorate.operators import metrics as m
from quorate.operators import pairing, reports
from quorate.operators import significance as sig
from quorate.operators.pairing import coverage, exact_pairs, gold_labels, last_predictions, paired, problems, strict_unique

LABELS = ["supported", "refuted", "nei"]
PRED = "row_id string, question_id string, probs map<string,double>, confidence double, model string, latency_ms double, ord long"


@pytest.fixture(scope="module")
def make(spark, fixture_rows):
    def run(cases):
        """cases: (gold label, {label: p}, confidence)"""
        gold = fixture_rows([{"row_id": f"r{k:03d}", "split": "val", "source": "s", "labels": {"v": {x: float(x == g) for x in LABELS}}} for k, (g, *_) in enumerate(cases)])
        # Maps from Python lose their order, those from JSON keep it.
        preds = spark.createDataFrame([(f"r{k:03d}", "v", json.dumps(p), c, "m", 1.0, k) for k, (_, p, c) in enumerate(cases)], PRED.replace("map<string,double>", "string"))
        preds = preds.withColumn("probs", F.from_json("probs", "map<string,double>"))
        return paired(gold_labels(gold), last_predictions(preds)).persist()

    return run


def hot(x):
    return {y: float(x == y) for y in LABELS}


def one(df):
    return df.first().asDict()


def test_perfect_and_uniform(make):
    rows = make([(x, hot(x), None) for x in LABELS])
    assert one(m.accuracy(rows, ["model"]))["accuracy"] == 1 and one(m.macro_f1(rows, ["model"]))["macro_f1"] == 1
    assert one(m.losses(rows, ["model"])) == {"model": "m", "brier": 0.0, "nll": 0.0} and one(m.ece_uniform(rows, ["model"]))["ece"] == 0
    flat = make([(x, {y: 1 / 3 for y in LABELS}, None) for x in LABELS])
    losses = one(m.losses(flat, ["model"]))
    assert losses["brier"] == pytest.approx(6 / 9) and losses["nll"] == pytest.approx(math.log(3))
    assert one(m.macro_f1(flat, ["model"]))["macro_f1"] == pytest.approx(1 / 6) and one(m.ece_uniform(flat, ["model"]))["ece"] == pytest.approx(0)
    assert one(m.tie_sensitivity(flat, ["model"]))["ties"] == 3


def test_ties_follow_insertion_and_clip(make):
    rows = make([("supported", {"supported": 0.5, "refuted": 0.5, "nei": 0.0}, None), ("nei", {"supported": 1.0, "refuted": 0.0, "nei": 0.0}, None)])
    t = one(m.tie_sensitivity(rows, ["model"]))
    assert (t["ties"], t["accuracy"], t["accuracy_sorted"]) == (1, 0.5, 0.0)
    assert one(m.losses(rows, ["model"]))["nll"] == pytest.approx((math.log(2) - math.log(1e-15)) / 2)


def test_selective_risk(make):
    ten = make([("supported", hot("supported" if k % 2 else "refuted"), 0.9) for k in range(10)])
    r = {x.target_coverage: x for x in m.selective_risk(ten, ["model"]).collect()}
    assert (r[0.5].selected, r[0.5].coverage, r[0.5].threshold, r[0.5].risk) == (10, 1.0, 0.9, 0.5)
    spread = make([("supported", hot("supported" if k >= 5 else "refuted"), 0.05 + 0.1 * k) for k in range(10)])
    r = {x.target_coverage: x for x in m.selective_risk(spread, ["model"]).collect()}
    assert (r[0.5].selected, r[0.5].risk) == (5, 0.0)


def test_bin_edges(make):
    confs = [0.0, 0.1, 0.3, 0.7, 1.0, 0.29999999999999999, 0.5]
    rows = make([("supported", hot("supported"), c) for c in confs])
    bins = {b.bin: b.n for b in m.reliability(rows, ["model"]).collect()}
    expected = {b: sum(min(int(c * 10), 9) == b for c in confs) for b in range(10)}
    assert bins == expected
    assert one(m.ece_uniform(rows, ["model"]))["ece"] == pytest.approx(sum(1 - c for c in confs) / len(confs))
    outside = make([("supported", hot("supported"), 1.5), ("supported", hot("supported"), 1.0)])
    assert one(m.ece_uniform(outside, ["model"]))["ece"] == 0  # beyond all bins: counted in n alone


def test_differential(make):
    rng = random.Random(3)
    cases = []
    for _ in range(120):
        x = [rng.choice([0, 0, 1, 1, 2, 3]) for _ in LABELS]
        x = x if sum(x) else [1, 1, 1]
        cases.append((rng.choice(LABELS), {y: v / sum(x) for y, v in zip(LABELS, x)}, rng.choice([None, 0.0, 0.1, 0.3, 0.7, 1.0, rng.random()])))
    rows = make(cases)
    top = [max(p, key=p.get) for _, p, _ in cases]
    conf = [max(p.values()) if c is None else c for _, p, c in cases]
    ok = [t == g for t, (g, *_) in zip(top, cases)]
    n = len(cases)
    order = sorted(range(n), key=lambda k: (conf[k], k))
    tiles, at = [], 0
    for b in range(10):
        size = n // 10 + (b < n % 10)
        tiles.append(order[at : at + size])
        at += size
    adaptive = sum(len(t) / n * abs(sum(ok[k] for k in t) / len(t) - sum(conf[k] for k in t) / len(t)) for t in tiles)
    for shape in (rows, rows.repartition(7), rows.orderBy(F.desc("row_id"))):
        assert one(m.accuracy(shape, ["model"]))["accuracy"] == pytest.approx(sum(ok) / n)
        assert one(m.ece_adaptive(shape, ["model"]))["ece_adaptive"] == pytest.approx(adaptive)
    per = {r.label: r for r in m.per_label(rows, ["model"]).collect()}
    for x in LABELS:
        hits, said, there = (sum(f(k) for k in range(n)) for f in (lambda k: ok[k] and top[k] == x, lambda k: top[k] == x, lambda k: cases[k][0] == x))
        assert per[x].precision == pytest.approx(hits / said) and per[x].recall == pytest.approx(hits / there)


def test_strict_inputs(spark, fixture_rows):
    preds = spark.createDataFrame([("a", "v", {"x": 1.0}, 0.5, "m", 1.0, 0), ("a", "v", {"x": 0.5}, 0.5, "m", 1.0, 1)], PRED)
    with pytest.raises(Exception, match="duplicate"):
        strict_unique(preds, ["row_id", "question_id"], "prediction").count()
    assert last_predictions(preds).first().raw[0].p == 0.5
    gold = gold_labels(fixture_rows([{"row_id": r, "labels": {"v": {"x": 1.0}}} for r in "ab"]))
    c = one(coverage(gold, last_predictions(preds)))
    assert (c["gold"], c["matched"], c["missing"], c["extra"]) == (2, 1, 1, 0)
    with pytest.raises(Exception, match="no answer"):
        exact_pairs(gold, last_predictions(preds)).count()
    bad = {"nan": ({"x": float("nan"), "y": 1.0}, 0.5, "not_finite"), "neg": ({"x": -1.0, "y": 2.0}, 0.5, "negative"), "sum": ({"x": 0.4, "y": 0.4}, 0.5, "sum"), "lab": ({"x": 1.0}, 0.5, "labels"), "conf": ({"x": 0.5, "y": 0.5}, None, "no_confidence"), "rng": ({"x": 0.5, "y": 0.5}, 1.5, "confidence_range"), "ok": ({"y": 0.5, "x": 0.5}, 0.5, None)}
    rows = spark.createDataFrame([(k, "v", p, c, "m", 1.0, 0) for k, (p, c, _) in bad.items()], PRED)
    found = last_predictions(rows).select("row_id", problems(F.col("raw"), F.array(F.lit("x"), F.lit("y")), F.col("confidence")).alias("p")).collect()
    for r in found:
        assert bad[r.row_id][2] in r.p if bad[r.row_id][2] else r.p == []


def both(spark, counts):
    rows = [(f"r{k}", "v", "g", int(a), int(b)) for k, (a, b) in enumerate(p for pair, n in counts.items() for p in [pair] * n)]
    return spark.createDataFrame(rows, "row_id string, question_id string, gold string, ok_a int, ok_b int")


@pytest.mark.parametrize("counts, p", [({(1, 0): 1, (0, 1): 1, (1, 1): 3}, 1.0), ({(1, 0): 0, (0, 1): 4}, 0.125), ({(1, 1): 5}, 1.0)])
def test_mcnemar(spark, counts, p):
    assert one(sig.mcnemar(both(spark, counts)))["p_exact"] == pytest.approx(p)


def test_published_comparison(spark):
    rows = spark.range(9730).select((F.col("id") < 594).alias("x"), ((F.col("id") >= 594) & (F.col("id") < 1091)).alias("y"))
    rows = rows.select((~F.col("y")).cast("int").alias("ok_a"), (~F.col("x")).cast("int").alias("ok_b"))
    r = one(sig.mcnemar(rows))
    assert (r["only_a"], r["only_b"]) == (594, 497) and r["p_exact"] == pytest.approx(0.003636540511, abs=1e-11)
    assert r["z"] == pytest.approx(2.937, abs=1e-3) and sig.asymptotic_p(r["z"]) == pytest.approx(0.0033, abs=5e-5)
    d, low, high = sig.bootstrap_interval(rows)
    assert d == pytest.approx(-97 / 9730) and -0.0175 < low < -0.0155 and -0.0045 < high < -0.0025


def test_correlation_without_variance(make):
    rows = make([("supported", hot("supported"), 0.5)] * 3)
    assert one(m.agreement(rows, ["model"]))["conf_match"] is None


def test_calibration(make):
    rng = random.Random(1)
    cases = []
    for _ in range(400):
        g = rng.choice(LABELS)
        said = g if rng.random() < 0.6 else rng.choice(LABELS)
        cases.append((g, {x: 0.98 if x == said else 0.01 for x in LABELS}, None))
    rows = make(cases)
    t = cal.fit_temperature(rows)
    losses = {r.t: r.loss for r in cal.grid_losses(rows, [], [t * 0.95, t, t * 1.05]).collect()}
    assert t > 1.5 and min(losses, key=losses.get) == t
    knots = cal.isotonic_knots(rows, "v")
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(knots, knots[1:]))
    got = {r.method: r.ece_soft for r in cal.report(rows, {"v": knots}, t).collect()}
    assert got["temperature"] < got["none"] and got["isotonic"] < got["none"]
    assert cal.isotonic_knots(rows.where("false"), "v") == [(0.0, 0.0), (1.0, 1.0)] and cal.fit_temperature(rows.where("false")) in (1.0, 1)


def test_duplicate_answers_and_keys_of_one_side_are_errors(spark):
    gold = spark.createDataFrame([("a", "q", [("x", 1.0), ("y", 0.0)], "x")], "row_id string, question_id string, target array<struct<label:string,p:double>>, gold string")
    form = "row_id string, question_id string, model string, raw array<struct<label:string,p:double>>, confidence double"
    one, other = ("a", "q", "m", [("x", 0.5), ("y", 0.5)], None), ("b", "q", "m", [("x", 1.0)], None)
    assert pairing.paired(gold, spark.createDataFrame([one], form)).count() == 1
    with pytest.raises(Exception, match="duplicate answer"):  # even if no gold asks for it
        pairing.paired(gold, spark.createDataFrame([one, other, other], form)).count()
    assert pairing.exact_three(gold, spark.createDataFrame([one], form), spark.createDataFrame([one], form)).count() == 1
    with pytest.raises(Exception, match="answer without gold: b"):
        pairing.exact_three(gold, spark.createDataFrame([one], form), spark.createDataFrame([one, other], form)).collect()
    with pytest.raises(Exception, match="duplicate arm"):
        reports.arms(spark.createDataFrame([("x/preds_a.jsonl",), ("y/a.json",)], "file string")).collect()


def test_running_sums_equal_a_sort(spark):
    import random

    rng = random.Random(1)
    rows = [("m", round(rng.random() ** 3, 4), rng.randint(0, 1)) for _ in range(3000)] + [("k", 0.5, 1)]
    per = spark.createDataFrame(rows, "model string, v double, ok int").groupBy("model", "v").agg(F.count(F.lit(1)).alias("m"), F.sum("ok").alias("hits"))
    got = m.below(per, ["model"], "v", ["m", "hits"], ranges=16).collect()
    for r in got:
        own = [(v, ok) for g, v, ok in rows if g == r.model]
        assert (r.below_m, r.below_hits, r.all_m) == (sum(v < r.v for v, _ in own), sum(ok for v, ok in own if v < r.v), len(own))
