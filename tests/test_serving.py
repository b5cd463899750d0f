"""Synthesis, requests, reports and puzzles."""

import json

import pytest
from pyspark.sql import functions as F

from quorate.functions import dist
from quorate.operators import puzzles, reports, serving
from quorate.operators.pairing import gold_labels, last_predictions
from quorate.plans.synthesis import ARMS, mixed_labels, synthetic_rows


def test_synthetic_rows(spark):
    rows = synthetic_rows(spark, 900)
    got = rows.collect()
    assert got == synthetic_rows(spark, 900).repartition(5).orderBy("ord").collect() or sorted(got, key=str) == sorted(synthetic_rows(spark, 900).repartition(5).collect(), key=str)
    labels = [json.loads(r.meta)["oracle_label"] for r in got]
    assert all(labels.count(x) == 300 for x in set(labels)) and len({r.row_id for r in got}) == 900
    split = {}
    for r in got:
        assert split.setdefault(r.group_id, r.split) == r.split
        arm = json.loads(r.meta)["arm"]
        assert (r.source == "adversarial") == next(a[4] for a in ARMS if a[0] == arm)
        assert (json.loads(r.state)["evidence"] == []) == (arm == "no_evidence")
        assert max(r.labels["verdict"].values()) == 1.0 and sum(r.labels["verdict"].values()) == 1.0
    assert set(split.values()) == {"train", "val", "test"}
    with pytest.raises(ValueError):
        synthetic_rows(spark, 5, domains=["none"])
    teacher = rows.where("ord < 10").select("row_id", F.create_map(F.lit("verdict"), F.create_map(F.lit("x"), F.lit(1.0))).alias("labels"))
    mixed = mixed_labels(rows, teacher).where("label_source = 'teacher'")
    assert sorted(r.ord for r in mixed.collect()) == [1, 3, 5, 7, 9]


def test_requests_and_answers(spark):
    q = "questions map<string,struct<kind:string,instructions:string,criteria:string>>"
    rows = spark.createDataFrame([(1, {"a": ("choice", "i", '{"x": null}'), "b": ("noul", "i", None)}), (2, {"a": ("choice", "i", None)}), (3, {"a": ("rank", "i", "x")}), (4, {}), (5, None), (6, {"s": ("SCORE", "i", "[]")})], f"id int, {q}")
    got = {r.id: r.p for r in rows.select("id", serving.request_problems(F.col("questions")).alias("p")).collect()}
    assert got == {1: [], 2: ["a: no criteria"], 3: ["a: unknown kind"], 4: ["no questions"], 5: ["no questions"], 6: ["s: no criteria"]}
    states = spark.createDataFrame([('[{"role": "u", "content": "a"}, {"role": "x"}, "skip", {"content": "b"}]',), ("plain",), ('{"claim": "c"}',), (None,)], "state string")
    assert [r.s for r in states.select(serving.flat_state(F.col("state")).alias("s")).collect()] == ["a\n\nb", "plain", '{"claim": "c"}', None]
    entry = lambda *x: F.array(*(dist.entry(F.lit(k), F.lit(p)) for k, p in x))
    one = spark.range(1).select(F.lit("score").alias("kind"), entry(("0", 0.25), ("1", 0.75)).alias("answer"))
    r = serving.answers(one).first()
    assert r.score.score == 0.75 and r.score.confidence == 0.75 and r.choice is None and r.noul is None
    nested = spark.range(1).select("id", F.struct(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c")).alias("b")).alias("s"))
    assert serving.flattened(nested).columns == ["id", "s.a", "s.b.c"]


PRED = "row_id string, question_id string, probs string, confidence double, model string, latency_ms double, ord long"


def test_audit_fails_closed(spark, fixture_rows):
    gold = gold_labels(fixture_rows([{"row_id": f"r{k}", "split": "val", "labels": {"v": {"x": float(k % 2), "y": float(1 - k % 2)}}} for k in range(6)]))
    def preds(rows):
        return last_predictions(spark.createDataFrame(rows, PRED).withColumn("probs", F.from_json("probs", "map<string,double>")))

    fine = [(f"r{k}", "v", '{"x": 0.6, "y": 0.4}', 0.6, m, 1.0, k) for k in range(6) for m in "ab"]
    out = reports.audit(gold, preds(fine), ["a", "b"])
    assert out["models"]["a"]["accuracy"] == 0.5 and out["paired"]["p_exact"] == 1.0 and out["paired"]["interval"] == [0.0, 0.0]
    assert "| a |" in reports.markdown(out)
    for bad in (fine[1:], fine + [("zz", "v", '{"x": 1.0, "y": 0.0}', 1.0, "a", 1.0, 9)], [*fine[1:], ("r0", "v", '{"x": 0.6, "y": 0.6}', 0.6, "a", 1.0, 9)], [*fine[1:], ("r0", "v", '{"x": 0.6, "z": 0.4}', 0.6, "a", 1.0, 9)], [*fine[1:], ("r0", "v", '{"x": 0.6, "y": 0.4}', None, "a", 1.0, 9)]):
        with pytest.raises(ValueError):
            reports.audit(gold, preds(bad), ["a", "b"])


def test_routing(spark):
    preds = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c"), ("n", "a"), ("o", "zz")], "model string, row_id string")
    sets = {"one": spark.createDataFrame([("a", "val"), ("b", "val"), ("d", "val")], "row_id string, split string"), "two": spark.createDataFrame([("c", "test"), ("a", "val")], "row_id string, split string")}
    got = {r.model: (r.record_set, r.split, r.matched, r.available) for r in reports.routed(preds, sets).collect()}
    assert got == {"m": ("one", "val", 2, 3), "n": ("one", "val", 1, 3), "o": (None, None, None, None)}


def test_puzzles(spark):
    full = "".join(str((r * 3 + r // 3 + c) % 9 + 1) for r in range(9) for c in range(9))
    easy = "".join(x if k % 4 else "." for k, x in enumerate(full))
    rows = spark.createDataFrame([(1, easy), (2, full), (3, "1" * 81), (4, "." * 81), (5, "short"), (6, None)], "puzzle_id long, board string")
    left = {r.puzzle_id: r.n for r in puzzles.propagated(puzzles.cells(rows.where("puzzle_id < 3"))).groupBy("puzzle_id").agg(F.count_if(F.col("value").isNull()).alias("n")).collect()}
    assert left == {1: 0, 2: 0}
    out = {r.puzzle_id: r.solution for r in puzzles.solved(rows).collect()}
    assert out[1] == out[2] == full and out[3] is None and out[5] is None and out[6] is None
    assert all(sorted(out[4][9 * k : 9 * k + 9]) == list("123456789") for k in range(9))
    options = puzzles.candidates(puzzles.cells(rows.where("puzzle_id = 1")))
    assert puzzles.fewest(options).first().n == 1 and puzzles.hidden_singles(options).count() > 0


def test_more_gates(spark):
    from quorate.operators import gates

    plan = spark.createDataFrame([("a", "w1", 1.0), ("b", "w2", 0.9), ("c", "w9", 1.0)], "state_key string, schema_id string, p double").select("state_key", "schema_id", F.array(dist.entry(F.lit("x"), F.col("p"))).alias("target"))
    pairs = spark.createDataFrame([("a", "w1")], "state_key string, schema_id string")
    states = spark.createDataFrame([("b",)], "state_key string")
    assert {r.code: r.n for r in gates.plan_gate(plan, ["w1", "w2"], pairs, states).collect()} == {"wording_not_allowed": 1, "evaluated_pair": 1, "evaluated_state": 1, "sum": 1, "label_share": 1}
    rows = spark.createDataFrame([("a", "train", "g", None), ("b", "TRAIN ", "h", '{"gt_row_id": "z"}'), ("c", "train", None, None)], "row_id string, split string, group_id string, meta string")
    groups, ids = spark.createDataFrame([("g",)], "group_id string"), spark.createDataFrame([("z",)], "row_id string")
    assert [r.row_id for r in gates.training_rows(rows, carved=(groups, ids)).collect()] == ["c"]
    with pytest.raises(ValueError, match="not_val"):
        gates.training_rows(rows, "val")
    assert gates.without_test(rows).count() == 3
    with pytest.raises(ValueError, match="test_row"):
        gates.without_test(rows.union(spark.createDataFrame([("a", "test", None, None)], rows.schema)))


def test_scoring_helpers(spark):
    import pandas as pd

    from quorate.operators import scoring
    from quorate.plans import planning

    calls = []

    def flaky(batches):
        for b in batches:
            calls.append(len(b))
            if len(calls) < 3:
                raise OSError("busy")
            yield b

    one = pd.DataFrame({"row_id": ["a", "b"]})
    assert len(list(scoring.with_retries(flaky, sleep=lambda s: None)(iter([one])))) == 1 and calls == [2, 2, 2]

    def bad(batches):
        for b in batches:
            if "b" in b["row_id"].tolist():
                raise OSError("never")
            yield b

    with pytest.raises(RuntimeError, match="row b"):
        list(scoring.with_retries(bad, attempts=2, sleep=lambda s: None)(iter([one])))
    rows = scoring.probe_rows(spark)
    assert rows.count() == len(scoring.PROBES) and scoring.throughput(scoring.requests(rows), scoring.lexical_scorer)["n"] == 9
    assert planning.stopped_at([3, 2, 2, 2, 1], 2) == 3 and planning.stopped_at([3, 2, 1], 2) is None
    options = spark.createDataFrame([(1, 0, 1, 0.2), (1, 0, 2, 0.9), (1, 1, 1, 0.1), (1, 1, 3, 0.1)], "puzzle_id int, cell int, value int, p double")
    assert [(r.cell, r.value, r.turn) for r in planning.search_order(options, 0.5).orderBy("cell", "turn").collect()] == [(0, 2, 1), (1, 1, 1), (1, 3, 2)]
