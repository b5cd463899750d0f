"""Counters, routing of prediction files, and the audit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from . import gates, metrics, significance
from .pairing import paired, side_by_side


def arms(files: DataFrame, file: str = "file") -> DataFrame:
    """(arm, file) of prediction files; two files of one arm name are an error."""
    from ..functions.text import arm_name
    from .pairing import strict_unique

    return strict_unique(files.select(arm_name(F.col(file)).alias("arm"), F.col(file).alias("file")).distinct(), ["arm"], "arm")


def label_counts(gold: DataFrame) -> DataFrame:
    """First labels, counted within each answer space."""
    space = F.array_join(F.array_sort(dist.labels(F.col("target"))), ",")
    return gold.groupBy(space.alias("space"), F.col("gold").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def arm_accuracy(pairs: DataFrame, arm: Column, by: list[str]) -> DataFrame:
    """Rows that passed and all rows, of each probe arm."""
    return pairs.groupBy(*by, arm.alias("arm")).agg(F.sum("ok").alias("passed"), F.count(F.lit(1)).alias("total"))


def routed(predictions: DataFrame, candidates: dict[str, DataFrame]) -> DataFrame:
    """(model, record_set, split, matched, available, coverage): each model's answers go to the first record set that has any of them.

    Record sets are tried in the order given; split is `mixed` if more than one is met. A
    model whose answers match none has a null set.
    """
    ids = predictions.select("model", "row_id").distinct()
    found = None
    for k, (name, rows) in enumerate(candidates.items()):
        own = rows.select("row_id", "split").distinct()
        hit = ids.join(own, "row_id").groupBy("model").agg(F.count_distinct("row_id").alias("matched"), F.min("split").alias("lo"), F.max("split").alias("hi"))
        hit = hit.select("model", F.lit(k).alias("rank"), F.lit(name).alias("record_set"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("split"), "matched", F.lit(own.select("row_id").distinct().count()).alias("available"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("model").agg(F.min_by(F.struct("record_set", "split", "matched", "available"), "rank").alias("r"))
    out = ids.select("model").distinct().join(best, "model", "left").select("model", "r.*")
    return out.withColumn("coverage", metrics.ratio(F.col("matched"), F.col("available")))


def audit(gold: DataFrame, predictions: DataFrame, models: list[str]) -> dict:
    """The audit of some models on one question: metrics of each, and the first two compared.

    The gate is run for every model before anything is computed; a failure raises, and
    nothing is returned or written.
    """
    for name in models:
        gates.check(gates.audit_input_gate(gold, predictions.where(F.col("model") == name)))
    pairs = paired(gold, predictions.where(F.col("model").isin(models))).persist()
    try:
        by = ["model"]
        out: dict = {"models": {x: {} for x in models}}
        for frame in (metrics.accuracy(pairs, by), metrics.macro_f1(pairs, by), metrics.losses(pairs, by), metrics.ece_uniform(pairs, by), metrics.ece_adaptive(pairs, by), metrics.tie_sensitivity(pairs, by), metrics.over_claims(pairs, by)):
            for r in frame.collect():
                out["models"][r.model] |= {k: v for k, v in r.asDict().items() if k != "model"}
        for r in metrics.selective_risk(pairs, by).collect():
            out["models"][r.model].setdefault("selective_risk", {})[f"{r.target_coverage:g}"] = {"threshold": r.threshold, "selected": r.selected, "coverage": r.coverage, "risk": r.risk}
        for r in metrics.confusion(pairs, by).collect():
            out["models"][r.model].setdefault("confusion", {}).setdefault(r.gold, {})[r.pred] = r.n
        if len(models) > 1:
            both = side_by_side(pairs, models[0], models[1])
            r = significance.mcnemar(both).first()
            d, low, high = significance.bootstrap_interval(both)
            out["paired"] = {"a": models[0], "b": models[1], "only_a": r.only_a, "only_b": r.only_b, "p_exact": r.p_exact, "p_asymptotic": significance.asymptotic_p(r.z), "difference": d, "interval": [low, high]}
        return out
    finally:
        pairs.unpersist()


def markdown(report: dict) -> str:
    """The audit as a table for readers."""
    names = ["n", "accuracy", "macro_f1", "nll", "brier", "ece", "ece_adaptive", "ties"]
    lines = ["| model | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    for model, m in report["models"].items():
        lines.append(f"| {model} | " + " | ".join(f"{m[k]:.4f}" if isinstance(m.get(k), float) else str(m.get(k, "")) for k in names) + " |")
    if p := report.get("paired"):
        lines += ["", f"{p['a']} against {p['b']}: {p['only_a']} and {p['only_b']} rows right alone, exact p {p['p_exact']:.4g}, difference {p['difference']:+.4f} ({p['interval'][0]:+.4f} to {p['interval'][1]:+.4f})."]
    return "\n".join(lines) + "\n"
