"""Mixing, quotas and group splits."""

import json
import random

import pytest

from pyspark.sql import functions as F

from quorate.llm import group_splits as gs
from quorate.llm import mixing as mx
from quorate.llm import quota_sample as qs


@pytest.fixture(scope="module")
def mix(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "source string, label_source string, target_share double, max_repeat int, extra string")


def test_mix_reaches_its_shares(fixture_rows, mix):
    rng = random.Random(1)
    rows = [{"row_id": f"{s}{k}", "source": rng.choice([s, s.upper(), f" {s}"]), "label_source": "h", "weight": rng.choice([None, 0.5, 1.0, 2.0]), "state": "w " * rng.randint(1, 90)} for s, n in (("a", 700), ("b", 150), ("c", 20)) for k in range(n)]
    rows += [rows[0], {"row_id": "n", "source": None, "label_source": "h"}, {"row_id": None, "source": "a", "label_source": "h"}]
    targets = mix(("A", "h", 0.5, 1, "x"), ("b", "H ", 0.35, 3, "x"), ("c", "h", 0.15, 2, "x"), ("d", "h", 0.0, 2, "x"))
    params = mx.Params(block=100)
    out = mx.mix_sources(fixture_rows(rows), targets, params)
    report = {r.source: r for r in out.report.collect()}
    assert report["c"].short and not report["A"].short and report["d"].draws == 0
    for s in ("A", "b"):  # within one record of what is wanted
        assert abs(report[s].reached - report[s].wanted) <= 2.0
    assert report["c"].reached == report["c"].weight * 2
    copies = {r.row_id: r.copies for r in out.chosen.collect()}
    assert max(v for k, v in copies.items() if k[0] == "a") <= 1 and max(v for k, v in copies.items() if k[0] == "b") <= 3
    assert copies == {r.row_id: r.copies for r in mx.mix_sources(fixture_rows(rows[::-1]).repartition(7), targets, params).chosen.collect()}


def test_mix_of_nothing(fixture_rows, mix):
    out = mx.mix_sources(fixture_rows([]), mix(("a", "h", 0.5, 1, None), (None, "h", 0.5, 1, None)))
    assert out.chosen.count() == 0 and [(r.records, r.reached) for r in out.report.collect()] == [(0, 0.0)]
    assert mx.mix_sources(fixture_rows([{"row_id": "a", "source": "a", "label_source": "h"}]), mix().where("false")).report.count() == 0


def test_flight_balances_and_keeps_expectations():
    rng = random.Random(2)
    x = [[rng.uniform(0.5, 2), rng.uniform(1, 50), 1.0] for _ in range(200)]
    pi = [rng.uniform(0.1, 0.9) for _ in x]
    rows = [[v * p for v in r] for r, p in zip(x, pi)]
    flown = mx.flight(pi, rows, rng)
    assert sum(1 for p in flown if 0 < p < 1) <= 3
    for j in range(3):
        assert sum(p * r[j] for p, r in zip(flown, x)) == pytest.approx(sum(p * r[j] for p, r in zip(pi, x)))
    taken = [0.0] * 12
    for k in range(3000):
        for i, p in enumerate(mx.flight(pi[:12], rows[:12], random.Random(k), land=True)):
            assert p in (0.0, 1.0)
            taken[i] += p / 3000
    assert all(abs(a - b) < 0.05 for a, b in zip(taken, pi))


def test_allocation_passes_on_to_siblings_first():
    leaves = [(("a", "x"), 0.4, 0, 10), (("a", "x"), 0.1, 0, 100), (("a", "y"), 0.1, 0, 100), (("b", "z"), 0.4, 5, 100)]
    assert qs.allocate(leaves, 100) == [10, 40, 10, 40]  # the sibling takes all that is missing
    assert qs.allocate([(("a", "x"), 0.5, 0, 10), (("a", "x"), 0.1, 0, 20), (("a", "y"), 0.1, 0, 100), (("b", "z"), 0.3, 0, 100)], 100) == [10, 20, 40, 30]  # then the cousin
    assert qs.allocate([(("a", "x"), 1.0, 0, 3), (("b", "y"), 0.0, 4, 9)], 50) == [3, 9]
    assert qs.allocate([], 5) == []


def test_quota_sample(spark, fixture_rows):
    rows = [{"row_id": f"r{k}", "source": " F" if k % 3 else "g", "meta": json.dumps({"label": ["S", "r"][k % 2], "arm": [None, "Odd ", ""][k % 3]})} for k in range(600)]
    rows += [rows[5], {"row_id": "n", "source": "f", "meta": None}, {"row_id": "x", "source": "f", "meta": "{"}, {"row_id": None, "source": "f", "meta": '{"label": "s"}'}]
    labels = spark.createDataFrame([("f", "s", "yes"), ("f", "R", "no"), ("g", "s", "yes"), ("g", "q", None)], "source string, native_label string, label string")
    targets = spark.createDataFrame([("f", "yes", "odd", 0.5, 2), ("f", "no", "plain", 0.3, 2), ("g", "yes", "plain", 0.2, 500), (None, "yes", "plain", 0.1, 1)], "source string, label string, arm string, target_share double, min_rows int")
    out = qs.quota_sample(fixture_rows(rows), labels, targets, qs.Params(fraction=0.5, ranges=4))
    report = {r.source + r.label: r for r in out.report.collect()}
    assert report["gyes"].short and not report["fyes"].short and report["fyes"].available == 100
    assert sum(r.drawn for r in report.values()) == out.chosen.count() == out.chosen.select("row_id").distinct().count()
    # g can give 100 and must; what is left of the sample of 150 goes to f by its shares
    assert (report["gyes"].drawn, report["fyes"].drawn + report["fno"].drawn) == (100, 50)
    assert qs.quota_sample(fixture_rows([]), labels, targets).chosen.count() == 0


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")


def test_groups_that_share_a_claim_stay_together(fixture_rows, targets, state):
    rng = random.Random(4)
    rows = [{"row_id": f"r{k}", "group_id": f"g{k // 2:04d}", "state": state(f"claim number {k}")} for k in range(2000)]
    for a, b in ((10, 700), (701, 1300), (1301, 50)):  # a chain of groups
        rows[b]["state"] = state(f"  CLAIM, number: {a}!")
    rows += [{"row_id": "p", "group_id": "zz", "state": "Claim: claim number 10"}, {"row_id": "q", "group_id": None, "state": state("claim number 10")}, {"row_id": "e1", "group_id": "ya", "state": state("?!")}, {"row_id": "e2", "group_id": "yb", "state": state("...")}, dict(rows[3]), {"row_id": None, "group_id": "g0001", "state": None}]
    rng.shuffle(rows)
    got = gs.assign_splits(fixture_rows(rows), targets)
    groups = {r.group_id: r for r in got.groups.collect()}
    chain = {"g0005", "g0350", "g0650", "g0025"}
    assert {g for g, r in groups.items() if r.linked} == chain
    assert {groups[g].root_group_id for g in chain} == {"g0005"} and len({groups[g].split for g in chain}) == 1
    assert not groups["zz"].linked and groups["q"].root_group_id == "q" and not groups["ya"].linked
    splits = [r.split for r in gs.record_splits(fixture_rows(rows), got).collect()]
    assert len(splits) == 2004 and abs(splits.count("train") - 1603) < 20 and abs(splits.count("val") - 200) < 20


def test_incremental_splits_keep_and_quarantine(spark, fixture_rows, targets, state, tmp_path):
    first = gs.assign_splits(fixture_rows([{"row_id": f"r{k}", "group_id": f"g{k:03d}", "state": state(f"claim {k}")} for k in range(300)]), targets)
    first.save(str(tmp_path))
    before = {r.group_id: r.split for r in first.groups.collect()}
    train, test = (min(g for g, s in before.items() if s == x) for x in ("train", "test"))
    new = [{"row_id": "a1", "group_id": "new1", "state": state(f"claim {int(train[1:])}")}, {"row_id": "b1", "group_id": "new2", "state": state(f"claim {int(train[1:])}")}, {"row_id": "b2", "group_id": "new3", "state": state(f"claim {int(test[1:])}")}, {"row_id": "b3", "group_id": "new4", "state": state("alone")}]
    second = gs.assign_splits(fixture_rows(new[:1] + new[2:]), targets, gs.State.load(spark, str(tmp_path)))
    after = {r.group_id: r for r in second.groups.collect()}
    assert all(after[g].split == s and after[g].status == "kept" for g, s in before.items())
    assert after["new1"].split == "train" and after["new3"].split == "test" and after["new4"].split and after["new4"].status == "new"
    third = gs.assign_splits(fixture_rows([dict(new[1], row_id="c1"), dict(new[1], row_id="c2", state=state(f"claim {int(test[1:])}"))]), targets, second)
    last = {r.group_id: r for r in third.groups.collect()}
    assert last["new2"].status == "quarantined" and last["new2"].split is None
    assert all(last[g].split == s for g, s in before.items())


def test_a_quarantine_lasts_and_loses_no_link(spark, fixture_rows, targets, state, tmp_path):
    row = lambda r, g, *claims: [{"row_id": f"{r}{k}", "group_id": g, "state": state(c)} for k, c in enumerate(claims)]
    start = [dict(x, split=s) for s, rows in (("train", row("A", "gA", "one")), ("test", row("B", "gB", "two")), ("train", row("C", "gC", "three"))) for x in rows]
    first = gs.adopt_splits(fixture_rows(start), F.col("split"))
    look = lambda s: {r.group_id: (r.split, r.status, r.records, r.root_group_id) for r in s.groups.collect()}
    assert look(first)["gA"] == ("train", "kept", 1, "gA")
    second = gs.assign_splits(fixture_rows(row("q", "a0", "one", "two") + row("A", "gA", "one")), targets, first)
    assert look(second)["a0"] == (None, "quarantined", 2, "a0")
    assert look(second)["gA"] == ("train", "kept", 1, "gA") and look(second)["gB"][0] == "test"  # A0 came again and counts once
    second.save(str(tmp_path / "two"))
    third = gs.assign_splits(fixture_rows(row("u", "zz", "alone") + row("n", "gN", "one") + row("m", "gM", "two") + row("q", "a0", "one")), targets, gs.State.load(spark, str(tmp_path / "two")))
    got = look(third)
    assert got["a0"] == (None, "quarantined", 2, "a0") and got["zz"][1] == "new" and got["zz"][0]
    assert (got["gN"][0], got["gN"][3]) == ("train", "gA") and (got["gM"][0], got["gM"][3]) == ("test", "gB")
    # what is tied to a quarantined group alone stays with it; components of one split join; clashing new records are held
    fourth = gs.assign_splits(fixture_rows(row("p", "a0", "five") + row("o", "gO", "five") + row("j", "gJ", "one", "three") + row("h", "gA", "nine", "two")), targets, third)
    got = look(fourth)
    assert got["gO"][:2] == (None, "quarantined") and got["a0"][2] == 3
    assert got["gJ"][0] == "train" and {got[g][3] for g in ("gA", "gC", "gJ", "gN")} == {"gA"}
    splits = {r.row_id: r.split for r in gs.record_splits(fixture_rows(row("h", "gA", "nine", "two") + start + row("q", "a0", "one", "two")), fourth).collect()}
    assert splits == {"h0": "train", "h1": None, "A0": "train", "B0": "test", "C0": "train", "q0": None, "q1": None}
    fifth = gs.assign_splits(fixture_rows(row("i", "gI", "two")), targets, fourth)
    assert look(fifth)["gI"][0] == "test"  # the held record of gA gave it no claim
    free = gs.released(fifth, spark.createDataFrame([("a0",), ("gA",)], "group_id string"))
    assert "a0" not in look(free) and "gA" in look(free)
    assert look(gs.assign_splits(fixture_rows(row("q", "a0", "one")), targets, free))["a0"][0] == "train"


def test_splits_of_nothing(fixture_rows, targets):
    assert gs.assign_splits(fixture_rows([]), targets).groups.count() == 0
