"""Distributions as ordered arrays: ARRAY<STRUCT<label STRING, p DOUBLE>>, Column to Column.

The order of the labels is part of a distribution: of equal probabilities the first wins.
A null distribution gives null everywhere. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "array<struct<label:string,p:double>>"


def entry(label: Column, p: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), p.cast("double").alias("p"))


def bind(x: Column, f) -> Column:
    """f(x) with x computed once for each row, however often f uses it: inside a lambda, Spark computes it anew for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def from_map(m: Column | str) -> Column:
    """A map's entries in their order."""
    return F.transform(F.map_entries(m), lambda e: entry(e["key"], e["value"]))


def labels(d: Column) -> Column:
    return F.transform(d, lambda e: e["label"])


def values(d: Column) -> Column:
    return F.transform(d, lambda e: e["p"])


def total(d: Column) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda s, e: s + e["p"])


def is_valid(d: Column) -> Column:
    """Every p finite and not negative, and their sum above 0."""
    fine = F.forall(d, lambda e: F.coalesce(~F.isnan(e["p"]) & (e["p"] >= 0) & (e["p"] < float("inf")), F.lit(False)))
    return F.coalesce(fine & (total(d) > 0), F.lit(False))


def normalize(d: Column, strict: bool = False) -> Column:
    """Divided by its sum; a distribution without mass is null, or an error if strict."""
    out = bind(d, lambda v: bind(total(v), lambda s: F.when(s > 0, F.transform(v, lambda e: entry(e["label"], e["p"] / s)))))
    return F.coalesce(out, F.when(d.isNotNull(), F.raise_error(F.lit("distribution without mass")).cast(NONE))) if strict else out


def p_of(d: Column, label: Column) -> Column:
    """The label's probability, 0 if it is absent."""
    return F.when(d.isNotNull(), F.coalesce(F.get(F.filter(d, lambda e: e["label"] == label), F.lit(0))["p"], F.lit(0.0)))


def top(d: Column) -> Column:
    return F.array_max(values(d))


def argmax(d: Column) -> Column:
    """The first label of the highest probability."""
    return bind(d, lambda v: F.get(_highest(v), F.lit(0))["label"])


def _highest(d: Column) -> Column:
    return bind(top(d), lambda m: F.filter(d, lambda e: e["p"] == m))


def argmax_sorted(d: Column) -> Column:
    """The alternative rule for ties: the first in label order."""
    return bind(d, lambda v: F.array_min(labels(_highest(v))))


def ties(d: Column) -> Column:
    """How many labels share the highest probability."""
    return bind(d, lambda v: F.size(_highest(v)))


def one_hot(space: Column, winner: Column) -> Column:
    """All mass on winner; an error if it is not in the space."""
    out = F.transform(space, lambda x: entry(x, F.when(x == winner, 1.0).otherwise(0.0)))
    return F.when(F.array_contains(space, winner), out).when(space.isNotNull() & winner.isNotNull(), F.raise_error(F.concat(F.lit("label not in space: "), winner)).cast(NONE))


def is_one_hot(d: Column) -> Column:
    return (F.size(F.filter(d, lambda e: e["p"] == 1.0)) == 1) & (top(d) == 1.0)


def confidence(stored: Column, d: Column) -> Column:
    """The stored confidence, or the highest probability where there is none."""
    return F.coalesce(F.nanvl(stored, F.lit(None).cast("double")), top(d))


def softmax(logits: Column) -> Column:
    """Of an array of (label, p) with logits in p; shifted by their maximum."""
    return normalize(bind(logits, lambda v: bind(top(v), lambda m: F.transform(v, lambda e: entry(e["label"], F.exp(e["p"] - m))))))


def sequence_scores(token_logps: Column) -> Column:
    """From (label, logps: array of log-probabilities of its tokens): softmax over their sums, no length penalty."""
    return softmax(F.transform(token_logps, lambda e: entry(e["label"], F.aggregate(e["logps"], F.lit(0.0), lambda s, x: s + x))))


def readout_mode(tokens: Column) -> Column:
    """first_token if every label (label, ids) has tokens and the first ones differ, else sequence."""
    first = F.transform(tokens, lambda e: F.get(e["ids"], F.lit(0)))
    plain = F.forall(tokens, lambda e: F.size(e["ids"]) > 0) & (F.size(F.array_distinct(first)) == F.size(first))
    return F.when(plain, "first_token").when(tokens.isNotNull(), "sequence")


def collisions(tokens: Column) -> Column:
    """First token ids that more than one label begins with, ascending."""
    first = F.transform(tokens, lambda e: F.get(e["ids"], F.lit(0)))
    return F.array_sort(F.filter(F.array_distinct(first), lambda x: F.size(F.filter(first, lambda y: y == x)) > 1))


def temperature(d: Column, t: Column | float) -> Column:
    """p^(1/t), renormalised."""
    power = F.lit(1.0) / (t if isinstance(t, Column) else F.lit(float(t)))
    return normalize(F.transform(d, lambda e: entry(e["label"], F.pow(e["p"], power))))


def label_bias(d: Column, bias: dict[str, float]) -> Column:
    """p times its label's factor (1 if none), renormalised; without mass an error."""
    if not bias:
        return normalize(d, strict=True)
    m = F.create_map(*(F.lit(x) for kv in sorted(bias.items()) for x in (kv[0], float(kv[1]))))
    return normalize(F.transform(d, lambda e: entry(e["label"], e["p"] * F.coalesce(F.try_element_at(m, e["label"]), F.lit(1.0)))), strict=True)


def expected_score(d: Column) -> Column:
    """Sum of the labels as numbers, weighted by probability."""
    return F.aggregate(d, F.lit(0.0), lambda s, e: s + e["label"].try_cast("double") * e["p"])


def from_nli(kind: Column, entail: Column, contra: Column, neutral: Column) -> Column:
    """An entailment model's answer over the labels of a question kind; other kinds are an error."""
    noul = F.array(entry(F.lit("yes"), entail), entry(F.lit("no"), contra + neutral))
    choice = F.array(entry(F.lit("supported"), entail), entry(F.lit("refuted"), contra), entry(F.lit("not_enough_info"), neutral))
    return F.when(kind == "noul", noul).when(kind == "choice", choice).otherwise(F.raise_error(F.concat(F.lit("no map for "), kind)).cast(NONE))


def without_evidence(space: Column) -> Column:
    """The answer to a record without evidence: no, or not_enough_info, whichever is in the space; else an error."""
    winner = F.when(F.array_contains(space, "not_enough_info"), "not_enough_info").when(F.array_contains(space, "no"), "no")
    return F.when(winner.isNotNull(), one_hot(space, winner)).when(space.isNotNull(), F.raise_error(F.lit("no label for missing evidence")).cast(NONE))


def from_index(space: Column, index: Column) -> Column:
    return one_hot(space, F.get(space, index))


def from_scores(space: Column, scores: Column) -> Column:
    return normalize(F.zip_with(space, scores, lambda x, p: entry(x, p)))


def from_noul(p_yes: Column) -> Column:
    return F.array(entry(F.lit("yes"), p_yes), entry(F.lit("no"), 1.0 - p_yes))


def interpolate(x: Column, knots: Column) -> Column:
    """Piecewise-linear value at x over knots (x, y) ascending in x; the ends' values beyond them."""
    below, above = F.filter(knots, lambda k: k["x"] <= x), F.filter(knots, lambda k: k["x"] > x)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    return F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"]))


def apply_isotonic(d: Column, knots: Column) -> Column:
    """Positive probabilities through the fitted map, renormalised; no mass left: uniform over them."""
    mapped = F.transform(d, lambda e: entry(e["label"], F.when(e["p"] > 0, interpolate(e["p"], knots)).otherwise(e["p"])))
    flat = bind(F.size(F.filter(d, lambda e: e["p"] > 0)), lambda n: F.transform(d, lambda e: entry(e["label"], F.when(e["p"] > 0, F.lit(1.0) / n).otherwise(0.0))))
    return F.when(knots.isNull(), normalize(d)).otherwise(F.coalesce(normalize(mapped), flat))


def over_space(d: Column, space: Column) -> Column:
    """Probabilities in the order of a label space, 0 where absent, divided by their sum if there is any."""
    return normalize(F.transform(space, lambda x: entry(x, p_of(d, x))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def candidates(d: Column, rescale: bool = False) -> Column:
    """Negative and missing scores are 0, all 0 is uniform; divided by the sum only on request."""
    kept = F.transform(d, lambda e: entry(e["label"], F.greatest(F.coalesce(F.nanvl(e["p"], F.lit(0.0)), F.lit(0.0)), F.lit(0.0))))
    flat = F.transform(d, lambda e: entry(e["label"], F.lit(1.0) / F.size(d)))
    return F.when(total(kept) > 0, normalize(kept) if rescale else kept).otherwise(flat)


def truncated(prompt: Column, completion: Column, most: int) -> Column:
    """Prompt tokens cut on the right so that prompt and completion fit into most."""
    room = F.greatest(F.lit(most) - F.size(completion), F.lit(0))
    return F.concat(F.slice(prompt, F.lit(1), F.least(room, F.size(prompt))), completion)


def left_padded(ids: Column, length: Column, pad: int = 0) -> Column:
    """(ids, mask, positions) padded on the left to length; positions count from 0 behind the padding."""
    gap = F.greatest(length - F.size(ids), F.lit(0))
    mask = F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(ids)))
    return F.struct(
        F.concat(F.array_repeat(F.lit(pad), gap), ids).alias("ids"),
        mask.alias("mask"),
        F.transform(mask, lambda m, i: F.greatest(i - gap, F.lit(0))).alias("positions"),
    )


def brier(d: Column, gold: Column) -> Column:
    """Squared distance over the gold labels, an absent one counting 0."""
    return bind(d, lambda v: F.aggregate(gold, F.lit(0.0), lambda s, g: s + F.pow(p_of(v, g["label"]) - g["p"], F.lit(2.0))))


def total_variation(d: Column, gold: Column) -> Column:
    return bind(d, lambda v: F.aggregate(gold, F.lit(0.0), lambda s, g: s + F.abs(p_of(v, g["label"]) - g["p"]))) / 2


def soft_cross_entropy(d: Column, gold: Column, eps: float = 1e-15) -> Column:
    return bind(d, lambda v: F.aggregate(gold, F.lit(0.0), lambda s, g: s - g["p"] * F.ln(F.greatest(p_of(v, g["label"]), F.lit(eps)))))


def entropy(d: Column) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda s, e: s - F.when(e["p"] > 0, e["p"] * F.ln(e["p"])).otherwise(0.0))


def kl(d: Column, reference: Column, eps: float = 1e-15) -> Column:
    """KL divergence of d from reference over d's whole support."""
    return bind(reference, lambda v: F.aggregate(d, F.lit(0.0), lambda s, e: s + F.when(e["p"] > 0, e["p"] * (F.ln(e["p"]) - F.ln(F.greatest(p_of(v, e["label"]), F.lit(eps))))).otherwise(0.0)))
