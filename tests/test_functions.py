"""Distributions and text against hand-computed values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quorate.functions import dist, text


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first().x


def lit(*pairs):
    return F.array(*(dist.entry(F.lit(k), F.lit(float(p))) for k, p in pairs))


def pairs(rows):
    return [(r.label, r.p) for r in rows]


def test_normalize_and_argmax(one):
    assert pairs(value(one, dist.normalize(lit(("a", 1), ("b", 3))))) == [("a", 0.25), ("b", 0.75)]
    assert value(one, dist.normalize(lit(("a", 0)))) is None
    with pytest.raises(Exception, match="without mass"):
        value(one, dist.normalize(lit(("a", 0)), strict=True))
    tied = lit(("supported", 0.5), ("refuted", 0.5), ("nei", 0))
    assert value(one, dist.argmax(tied)) == "supported" and value(one, dist.argmax_sorted(tied)) == "refuted" and value(one, dist.ties(tied)) == 2


def test_validity(one):
    for bad in (float("nan"), float("inf"), -0.1):
        assert value(one, dist.is_valid(lit(("a", bad), ("b", 1)))) is False
    assert value(one, dist.is_valid(lit(("a", 0), ("b", 0)))) is False and value(one, dist.is_valid(lit(("a", 0), ("b", 2)))) is True


def test_scores(one):
    soft = pairs(value(one, dist.softmax(lit(("a", 1000), ("b", 1000 + math.log(3))))))
    assert soft[1][1] == pytest.approx(0.75)
    assert value(one, dist.expected_score(lit(("0", 0.25), ("1", 0.25), ("2", 0.5)))) == pytest.approx(1.25)
    assert pairs(value(one, dist.temperature(lit(("a", 0.2), ("b", 0.8)), 0.5)))[1][1] == pytest.approx(0.64 / 0.68)
    assert pairs(value(one, dist.label_bias(lit(("a", 0.5), ("b", 0.5)), {"a": 3})))[0][1] == pytest.approx(0.75)
    with pytest.raises(Exception, match="without mass"):
        value(one, dist.label_bias(lit(("a", 1.0)), {"a": 0}))
    assert pairs(value(one, dist.from_noul(F.lit(0.7)))) == [("yes", 0.7), ("no", pytest.approx(0.3))]
    assert pairs(value(one, dist.over_space(lit(("b", 1.0), ("c", 1.0)), F.array(F.lit("a"), F.lit("b"))))) == [("a", 0.0), ("b", 1.0)]
    assert pairs(value(one, dist.candidates(lit(("1", -2.0), ("2", 0.0))))) == [("1", 0.5), ("2", 0.5)]
    assert pairs(value(one, dist.candidates(lit(("1", -2.0), ("2", 3.0)), rescale=True))) == [("1", 0.0), ("2", 1.0)]


def test_rules(one):
    assert pairs(value(one, dist.from_nli(F.lit("noul"), F.lit(0.2), F.lit(0.3), F.lit(0.5)))) == [("yes", 0.2), ("no", 0.8)]
    with pytest.raises(Exception, match="no map"):
        value(one, dist.from_nli(F.lit("score"), F.lit(0.2), F.lit(0.3), F.lit(0.5)))
    space = F.array(F.lit("supported"), F.lit("not_enough_info"))
    assert pairs(value(one, dist.without_evidence(space))) == [("supported", 0.0), ("not_enough_info", 1.0)]
    with pytest.raises(Exception, match="not in space"):
        value(one, dist.one_hot(space, F.lit("x")))
    tokens = lambda *ids: F.array(*(F.struct(F.lit(str(k)).alias("label"), F.array(*(F.lit(i) for i in x)).alias("ids")) for k, x in enumerate(ids)))
    assert value(one, dist.readout_mode(tokens([1, 2], [3]))) == "first_token" and value(one, dist.readout_mode(tokens([1, 2], [1]))) == "sequence"
    assert value(one, dist.collisions(tokens([5], [1], [5], [1]))) == [1, 5]
    logps = F.array(*(F.struct(F.lit(k).alias("label"), F.array(*(F.lit(x) for x in v)).alias("logps")) for k, v in (("a", [-1.0, -1.0]), ("b", [-2.0 + math.log(3)]))))
    assert pairs(value(one, dist.sequence_scores(logps)))[1][1] == pytest.approx(0.75)


def test_isotonic_apply(one):
    knots = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 0.0), (0.6, 0.4), (0.8, 1.0))))
    for x, y in ((0.1, 0.0), (0.4, 0.2), (0.7, 0.7), (0.9, 1.0)):
        assert value(one, dist.interpolate(F.lit(x), knots)) == pytest.approx(y)
    assert pairs(value(one, dist.apply_isotonic(lit(("a", 0.1), ("b", 0.1), ("c", 0.0)), knots))) == [("a", 0.5), ("b", 0.5), ("c", 0.0)]


def test_padding(one):
    assert value(one, dist.truncated(F.array(*(F.lit(x) for x in (1, 2, 3, 4))), F.array(F.lit(9)), 3)) == [1, 2, 9]
    r = value(one, dist.left_padded(F.array(F.lit(7), F.lit(8)), F.lit(4)))
    assert (r.ids, r.mask, r.positions) == ([0, 0, 7, 8], [0, 0, 1, 1], [0, 0, 0, 1])


def test_losses(one):
    a, g = lit(("x", 0.5), ("y", 0.5)), lit(("x", 1.0), ("y", 0.0), ("z", 0.0))
    assert value(one, dist.brier(a, g)) == pytest.approx(0.5) and value(one, dist.total_variation(a, g)) == pytest.approx(0.5)
    assert value(one, dist.soft_cross_entropy(lit(("x", 0.0)), g)) == pytest.approx(-math.log(1e-15))
    assert value(one, dist.entropy(a)) == pytest.approx(math.log(2)) and value(one, dist.kl(a, a)) == pytest.approx(0)


def test_texts(one):
    assert value(one, text.norm_claim(F.lit("  Été, THE_x -- 3!"))) == "été the_x 3"
    assert value(one, text.canon(F.lit(" “A”  ‘é’ \n"))) == "\"a\" 'é'" and value(one, text.canon(F.lit(None).cast("string"))) == ""
    lines = F.array(F.lit("b"), F.lit("a"), F.lit("a"))
    assert value(one, text.signature(F.lit("c"), lines)) != value(one, text.signature(F.lit("c"), F.array_sort(lines)))
    assert value(one, text.set_signature(F.lit("c"), lines)) == value(one, text.set_signature(F.lit("c"), F.reverse(lines)))
    assert value(one, text.set_signature(F.lit("c"), lines)) != value(one, text.set_signature(F.lit("c"), F.array_distinct(lines)))
    assert value(one, text.rubric(F.lit("Rate it\n1: some\n0: none\n2: all"))) == ["none", "some", "all"] and value(one, text.rubric(F.lit("1: a\n3: b"))) is None
    sentences = F.array(*(F.lit(x) for x in "abc"))
    assert value(one, text.selected_sentences(sentences, F.array(*(F.lit(x) for x in (2, 0, 2, 9))))) == "a c"
    assert value(one, text.arm_name(F.lit("x/preds_big.model.jsonl"))) == "big.model"


def test_questions(one):
    q = lambda kind, criteria: value(one, text.question_text(F.lit("Ask"), F.lit(kind), F.lit(criteria).cast("string")))
    assert q("noul", None) == "Ask\nyes\nno" and q("noul", '{"yes": "it does"}') == "Ask\nyes: it does\nno"
    assert q("choice", '{"z": null, "a": "", "b": "bee"}') == "Ask\nz\na\nb: bee" and q("score", '["none", "all"]') == "Ask\n0: none\n1: all"
    assert value(one, text.option_texts(F.lit(" Two\nlines "), F.lit("score"), F.lit('["x"]'))) == ["Two\nlines\n0: x"]


def test_states(one):
    s = lambda x: value(one, text.state_text(F.lit(x)))
    whole = {"claim": "C", "evidence": [{"title": "T", "text": "x"}, "bare", {"text": None}, {"title": None, "text": "y"}], "b": 1, "as": "q"}
    assert s(json.dumps(whole)) == 'Claim: C\nEvidence:\n1. T: x\n2. bare\n3. \n4. y\n{"as":"\\"q\\"","b":"1"}' or s(json.dumps(whole)).startswith("Claim: C\nEvidence:\n1. T: x\n2. bare\n3. \n4. y\n")
    assert s('{"claim": "C", "evidence": null}') == "Claim: C\nEvidence:\n(none)" and s("plain") == "plain" and s('{"b": 2, "a": 1}') == '{"a":1,"b":2}'
    p = value(one, text.parse_state(F.lit(s(json.dumps({"claim": "C d", "evidence": ["one", {"title": "T", "text": "two"}]})))))
    assert (p.claim, p.evidence) == ("C d", ["one", "T: two"])
    assert value(one, text.parse_state(F.lit("Claim: C\nEvidence:\n(none)"))).evidence == [] and value(one, text.parse_state(F.lit("Claim: \nEvidence:\n1. x"))) is None and value(one, text.parse_state(F.lit("nothing"))) is None
    assert value(one, text.parse_prompt(F.lit("Q\na\n\nState:\nClaim: C\nEvidence:\n1. x\n2. y"))).evidence == ["x", "y"]
    assert value(one, text.state_key(F.lit('{"b":1,"a":2}'))) == value(one, text.state_key(F.lit('{ "a": 2, "b": 1 }')))
