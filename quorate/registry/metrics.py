"""Queries of pairing, metrics and significance, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, text
from ..operators import metrics as m
from ..operators import significance as sig
from ..operators.pairing import coverage, exact_pairs, exact_three, gold_labels, key_differences, last_predictions, paired, problems, raw_pairs, side_by_side
from ..plans.runtime import table

MODEL = ["model"]
A, B = "clf-large", "clf-small"


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same; -0.0 is 0.0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _gold(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return gold_labels(table(spark, d, "fixture"), columns)


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return last_predictions(table(spark, d, "predictions"))


def pairs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return paired(_gold(spark, d, *columns), _preds(spark, d), unique=True)


def both(spark: SparkSession, d: str) -> DataFrame:
    return side_by_side(pairs(spark, d), A, B)


def _of(f, *args, columns: tuple[str, ...] = ()):
    return lambda spark, d: rounded(f(pairs(spark, d, *columns), MODEL, *args))


def _malformed(spark: SparkSession, d: str) -> DataFrame:
    rows = _preds(spark, d).join(_gold(spark, d).select("row_id", "question_id", "target"), ["row_id", "question_id"])
    found = problems(F.col("raw"), dist.labels(F.col("target")), F.col("confidence"))
    return rows.select("model", "row_id", "question_id", F.array_join(found, ",").alias("problems")).where("problems <> ''")


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the models' answers, label by label, then its first label."""
    mean = m.ensemble(pairs(spark, d), ["row_id", "question_id", "gold"], "model")
    return mean.select("row_id", "question_id", "gold", dist.argmax(F.col("answer")).alias("pred"), F.round(dist.top(F.col("answer")), 10).alias("top"))


def _wordings(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers averaged over the wordings of one claim: what it says of records with the same claim and another question text."""
    rows = table(spark, d, "fixture").where("row_id is not null").groupBy("row_id").agg(F.min_by(F.struct("state", "questions"), "ord").alias("r"))
    rows = rows.select("row_id", F.coalesce(F.get_json_object("r.state", "$.claim"), "r.state").alias("claim"), F.try_element_at("r.questions", F.lit("verdict"))["instructions"].alias("wording"))
    answers = pairs(spark, d).where("question_id = 'verdict'").join(rows.where("wording is not null"), "row_id")
    per = m.ensemble(answers, ["model", "claim", "wording"], "row_id", None)
    mean = m.ensemble(per, ["model", "claim"], "wording", None)
    out = mean.select("model", F.md5("claim").alias("claim"), F.explode("answer").alias("e"))
    return rounded(out.select("model", "claim", "e.label", F.round("e.p", 10).alias("p")))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Answers after a temperature of 1.5 and label factors."""
    hot = dist.label_bias(dist.temperature(F.col("answer"), 1.5), {"not_enough_info": 1.2, "refuted": 0.9})
    rows = pairs(spark, d).select("model", "row_id", "question_id", F.explode(hot).alias("e"))
    return rounded(rows.select("model", "row_id", "question_id", "e.label", "e.p"))


def _strata(stratum: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = pairs(spark, d, stratum).withColumn(stratum, F.coalesce(F.lower(F.trim(stratum)), F.lit("?")))
        return rounded(m.recall_strata(rows, MODEL, stratum))

    return query


def _shortcut(spark: SparkSession, d: str) -> DataFrame:
    arm = F.lower(F.trim(F.get_json_object("meta", "$.arm")))
    return rounded(m.with_and_without(pairs(spark, d, "meta"), MODEL, arm == "no_evidence"))


def _cost(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "cache_lines")
    rows = lines.select(F.get_json_object("line", "$.key").alias("key"), F.get_json_object("line", "$.answer.usage.input_tokens").try_cast("int").alias("tokens"), "ord").where("key is not null")
    from pyspark.sql import Window

    seen = F.row_number().over(Window.partitionBy("key").orderBy("ord")) > 1
    return rounded(m.cost(rows.select(seen.alias("cached"), "tokens")), 10)


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_gold(spark, d, "split").where("question_id = 'verdict' and lower(trim(split)) in ('val', 'validation', 'dev', 'test')"), _preds(spark, d))


def _source_labels(spark: SparkSession, d: str) -> DataFrame:
    return m.rollup_counts(_gold(spark, d, "source").where("question_id = 'verdict'").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("?"))), "source", "gold")


def _mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sig.mcnemar(both(spark, d)), 10)


def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    x = sig.bootstrap_interval(both(spark, d))
    return spark.createDataFrame([x], "difference double, low double, high double")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs of one model: its first and its last answer to every question."""
    rows = table(spark, d, "predictions").where((F.col("model") == A) & F.col("row_id").isNotNull())
    keys = ["row_id", "question_id"]
    run = lambda pick: rows.groupBy(*keys).agg(pick("probs", "ord").alias("m")).select(*keys, dist.from_map(F.col("m")).alias("raw")).where(dist.is_valid(F.col("raw"))).select(*keys, dist.normalize(F.col("raw")).alias("answer"))
    return run(F.min_by), run(F.max_by)


def _regression(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sig.prediction_regression(*_runs(spark, d)))


def _asymptotic(spark: SparkSession, d: str) -> DataFrame:
    r = sig.mcnemar(both(spark, d)).first()
    return rounded(spark.createDataFrame([(r.n, r.z, sig.asymptotic_p(r.z))], "n bigint, z double, p double"))


def _by_passages(spark: SparkSession, d: str) -> DataFrame:
    """Recall by the number of passages of the record."""
    counts = table(spark, d, "fixture").where("row_id is not null").groupBy("row_id").agg(F.min_by("state", "ord").alias("state"))
    counts = counts.select("row_id", F.size(text.evidence_lines(F.col("state"))).alias("passages"))
    return rounded(m.recall_strata(pairs(spark, d).join(counts, "row_id"), MODEL, "passages"))


def _single_passage(spark: SparkSession, d: str) -> DataFrame:
    """Change of recall over the records of one passage."""
    one = table(spark, d, "fixture").where("row_id is not null").groupBy("row_id").agg(F.min_by("state", "ord").alias("state"))
    one = one.where(F.size(text.evidence_lines(F.col("state"))) == 1).select("row_id")
    return rounded(m.recall_change(both(spark, d).join(one, "row_id", "left_semi")))


def _raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_pairs(_gold(spark, d), _preds(spark, d), "verdict")
    return rounded(rows.select("model", "row_id", "gold", "p_gold", dist.total(F.col("answer")).alias("mass")))


def _verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold and two models' answers, cut to the keys that all of them have."""
    gold, preds = _gold(spark, d).where("question_id = 'verdict'"), _preds(spark, d).where("question_id = 'verdict'")
    a, b = (preds.where(F.col("model") == x) for x in (A, B))
    keys = gold.select("row_id").join(a.select("row_id"), "row_id").join(b.select("row_id"), "row_id")
    return tuple(x.join(keys, "row_id", "left_semi") for x in (gold, a, b))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """The error on keys of one side only is in the tests; here the keys are equal."""
    rows = exact_three(*_verdicts(spark, d))
    return rows.select("row_id", "gold", dist.argmax(F.col("raw_a")).alias("first_a"), dist.argmax(F.col("raw_b")).alias("first_b"))


def _aligned_two(spark: SparkSession, d: str) -> DataFrame:
    gold, a, _ = _verdicts(spark, d)
    return rounded(exact_pairs(gold, a).select("row_id", "question_id", "gold", "confidence"))


def _differences(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d, "split").where("question_id = 'verdict' and lower(trim(split)) in ('val', 'validation', 'dev', 'test')")
    return key_differences(gold, _preds(spark, d))


QUERIES = {
    "j01_pairs": lambda s, d: rounded(pairs(s, d).select("model", "row_id", "question_id", "gold", "pred", "ok", "conf", "top")),
    "j02_coverage": _covered,
    "j03_side_by_side": lambda s, d: both(s, d).select("row_id", "question_id", "gold", "pred_a", "pred_b"),
    "j02_exact_alignment": _aligned_two,
    "j04_raw_pairs": _raw_pairs,
    "j14_three_way": _aligned,
    "j15_regression": _regression,
    "u04_key_differences": _differences,
    "a11_ece_macro": _of(m.ece_macro),
    "a14_recall_by_passages": _by_passages,
    "a19_asymptotic": _asymptotic,
    "a22_single_passage": _single_passage,
    "a33_headroom": lambda s, d: m.headroom(both(s, d)),
    "p16_malformed": _malformed,
    "w02_last_predictions": lambda s, d: rounded(_preds(s, d).select("row_id", "question_id", "model", "confidence", "ord")),
    "a01_accuracy": _of(m.accuracy),
    "a02_confusion": _of(m.confusion),
    "a03_per_label": _of(m.per_label),
    "a04_macro_f1": _of(m.macro_f1),
    "a05_losses": _of(m.losses),
    "a07_ece_uniform": _of(m.ece_uniform),
    "a08_ece_soft": _of(m.ece_soft),
    "a09_ece_adaptive": _of(m.ece_adaptive),
    "a10_reliability": _of(m.reliability),
    "a11_ece_one_vs_rest": _of(m.ece_one_vs_rest),
    "a12_confidence_gap": _of(m.confidence_gap),
    "a13_selective_risk": _of(m.selective_risk),
    "a14_recall_by_source": _strata("source"),
    "a15_tie_sensitivity": _of(m.tie_sensitivity),
    "a16_agreement": _of(m.agreement),
    "a18_mcnemar": _mcnemar,
    "a20_bootstrap": _bootstrap,
    "a21_flips": lambda s, d: m.flips(both(s, d)),
    "a22_recall_change": lambda s, d: rounded(m.recall_change(both(s, d))),
    "a24_source_labels": _source_labels,
    "a26_latency_percentiles": lambda s, d: rounded(m.nearest_rank(_preds(s, d).where("latency_ms is not null and not isnan(latency_ms)"), MODEL, "latency_ms")),
    "a27_floor_percentile": lambda s, d: rounded(m.floor_rank(_preds(s, d).where("not isnan(latency_ms)"), MODEL, "latency_ms", 0.95)),
    "a28_latency_spread": lambda s, d: rounded(m.spread(_preds(s, d).where("latency_ms is not null and not isnan(latency_ms)"), MODEL, "latency_ms", 200.0)),
    "a30_cost": _cost,
    "a32_without_shortcut": _shortcut,
    "a33_over_claims": _of(m.over_claims),
    "a34_soft_loss": _of(m.soft_loss, {"adversarial": 2.0}, columns=("source", "weight")),
    "a35_reward_terms": _of(m.reward_terms),
    "a36_policy_terms": _of(m.policy_terms),
    "f09_decision_rule": _decided,
    "f11_ensemble": _ensemble,
    "f11_wordings": _wordings,
}

GOLD = """
f AS (SELECT * FROM fixture WHERE row_id IS NOT NULL AND labels IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ord) = 1),
gl AS (SELECT row_id, source, split, group_id, label_source, weight, meta, question_id, pos, e.key AS label, e.value AS y
  FROM (SELECT *, unnest(m) AS e, generate_subscripts(m, 1) AS pos FROM
    (SELECT row_id, source, split, group_id, label_source, weight, meta, l.key AS question_id, map_entries(l.value) AS m
     FROM (SELECT *, unnest(map_entries(labels)) AS l FROM f)))),
gs AS (SELECT *, sum(y) OVER w AS s, max(y) OVER w AS mx FROM gl WINDOW w AS (PARTITION BY row_id, question_id)),
gn AS (SELECT *, y / s AS yn FROM gs WHERE s > 0),
gg AS (SELECT row_id, question_id, source, split, meta, weight, arg_min(label, pos) FILTER (y = mx) AS gold FROM gn GROUP BY ALL)"""
PRED = """
pr AS (SELECT * FROM predictions WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id, question_id, model ORDER BY ord DESC) = 1),
pl AS (SELECT row_id, question_id, model, confidence, latency_ms, pos, e.key AS label, e.value AS p
  FROM (SELECT *, unnest(m) AS e, generate_subscripts(m, 1) AS pos FROM (SELECT *, map_entries(probs) AS m FROM pr))),
pv AS (SELECT *, sum(p) OVER w AS s, max(p) OVER w AS mx, count(*) FILTER (WHERE p IS NULL OR isnan(p) OR isinf(p) OR p < 0) OVER w AS bad
  FROM pl WINDOW w AS (PARTITION BY row_id, question_id, model)),
pn AS (SELECT *, p / s AS pn FROM pv WHERE bad = 0 AND s > 0),
pp AS (SELECT row_id, question_id, model, confidence, latency_ms, arg_min(label, pos) FILTER (p = mx) AS pred, max(pn) AS top,
         count(*) FILTER (p = mx) AS nties, min(label) FILTER (p = mx) AS pred_sorted FROM pn GROUP BY ALL)"""
BASE = f"""WITH {GOLD.strip()},{PRED},
b AS (SELECT *, CAST(pred = gold AS INTEGER) AS ok, coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, top) AS conf
      FROM gg JOIN pp USING (row_id, question_id)),
t AS (SELECT b.model, b.row_id, b.question_id, b.gold, b.pred, b.top, b.weight, b.source, gn.label, gn.yn, coalesce(pn.pn, 0) AS q
      FROM b JOIN gn USING (row_id, question_id) LEFT JOIN pn ON pn.row_id = b.row_id AND pn.question_id = b.question_id AND pn.model = b.model AND pn.label = gn.label),
r AS (SELECT model, row_id, question_id, sum((q - yn) * (q - yn)) AS brier, sum(abs(q - yn)) / 2 AS tv, -sum(yn * ln(greatest(q, 1e-15))) AS ce,
        max(CASE WHEN label = gold THEN -ln(greatest(q, 1e-15)) END) AS nll, sum(yn * q) AS reward, coalesce(max(CASE WHEN label = pred THEN yn END), 0) AS mass,
        sum(CASE WHEN yn > 0 THEN yn * (ln(yn) - ln(greatest(q, 1e-15))) ELSE 0 END) AS kl
      FROM t GROUP BY ALL),
ab AS (SELECT x.row_id, x.question_id, x.gold, x.pred AS pred_a, y.pred AS pred_b, x.ok AS ok_a, y.ok AS ok_b
       FROM b x JOIN b y USING (row_id, question_id) WHERE x.model = '{A}' AND y.model = '{B}'),
dim AS (SELECT DISTINCT model, label FROM t),
prf AS (SELECT d.model, d.label, count(*) FILTER (b.gold = d.label) AS support, count(*) FILTER (b.pred = d.label) AS predicted,
          count(*) FILTER (b.gold = d.label AND b.pred = d.label) AS hits FROM dim d JOIN b USING (model) GROUP BY ALL),
prf1 AS (SELECT model, label, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM prf)
"""


def _edges(c: str, left_open: bool = False) -> str:
    parts = []
    for k in range(10):
        lo, hi = repr(k / 10), repr((k + 1) / 10)
        inside = f"{c} > {lo}::DOUBLE AND {c} <= {hi}::DOUBLE" if left_open else f"{c} >= {lo}::DOUBLE AND {c} {'<' if k < 9 else '<='} {hi}::DOUBLE"
        parts.append(f"WHEN {inside} THEN {k}")
    return "CASE " + " ".join(parts) + " END"


def _ece(rows: str, by: str, conf: str, hit: str, bin_: str, name: str) -> str:
    return f"""SELECT {by}, round(sum(CASE WHEN k IS NULL THEN 0 ELSE m * abs(a - c) END) / sum(m), 10) AS {name}
FROM (SELECT {by}, {bin_} AS k, count(*) AS m, avg({conf}) AS c, avg({hit}::DOUBLE) AS a FROM {rows} GROUP BY ALL) GROUP BY ALL"""


_LATENCY = "pr WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms)"
SQL = {
    "j01_pairs": BASE + "SELECT model, row_id, question_id, gold, pred, ok, round(conf, 10) AS conf, round(top, 10) AS top FROM b",
    "j02_coverage": f"""WITH {GOLD.strip()},{PRED},
w AS (SELECT row_id, question_id FROM gg WHERE question_id = 'verdict' AND lower(trim(split)) IN ('val', 'validation', 'dev', 'test'))
SELECT model, (SELECT count(*) FROM w) AS gold, count(*) AS answers, count(w.row_id) AS matched, (SELECT count(*) FROM w) - count(w.row_id) AS missing,
  count(*) - count(w.row_id) AS extra FROM pr LEFT JOIN w USING (row_id, question_id) GROUP BY model""",
    "j03_side_by_side": BASE + "SELECT row_id, question_id, gold, pred_a, pred_b FROM ab",
    "w02_last_predictions": f"WITH {PRED.strip()} SELECT row_id, question_id, model, round(confidence, 10) AS confidence, ord FROM pr",
    "a01_accuracy": BASE + "SELECT model, count(*) AS n, round(avg(ok), 10) AS accuracy FROM b GROUP BY model",
    "a02_confusion": BASE + """SELECT g.model, g.label AS gold, p.label AS pred, count(b.row_id) AS n FROM dim g JOIN dim p USING (model)
LEFT JOIN b ON b.model = g.model AND b.gold = g.label AND b.pred = p.label GROUP BY ALL""",
    "a03_per_label": BASE + """SELECT model, label, round(p, 10) AS precision, round(r, 10) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 10) AS f1,
support FROM prf1""",
    "a04_macro_f1": BASE + "SELECT model, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 10) AS macro_f1 FROM prf1 GROUP BY model",
    "a05_losses": BASE + "SELECT model, round(avg(brier), 10) AS brier, round(avg(nll), 10) AS nll FROM r GROUP BY model",
    "a07_ece_uniform": BASE + _ece("b", "model", "conf", "ok", _edges("conf"), "ece"),
    "a08_ece_soft": BASE + _ece("(SELECT b.model, b.top, r.mass FROM b JOIN r USING (model, row_id, question_id))", "model", "top", "mass", _edges("top", True), "ece_soft"),
    "a09_ece_adaptive": BASE + _ece("(SELECT *, ntile(10) OVER (PARTITION BY model ORDER BY conf, row_id, question_id) AS tile FROM b)", "model", "conf", "ok", "tile", "ece_adaptive"),
    "a10_reliability": BASE + """SELECT model, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(c, 10) AS mean_confidence, round(a, 10) AS accuracy
FROM (SELECT DISTINCT model FROM b) CROSS JOIN range(10) AS x(i)
LEFT JOIN (SELECT model, greatest(least(CAST(trunc(conf * 10) AS INTEGER), 9), 0) AS k, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM b GROUP BY ALL) USING (model) WHERE k = i OR k IS NULL
UNION ALL SELECT model, CAST(i AS INTEGER), 0, NULL, NULL FROM (SELECT DISTINCT model FROM b) CROSS JOIN range(10) AS x(i)
WHERE (model, i) NOT IN (SELECT (model, greatest(least(CAST(trunc(conf * 10) AS INTEGER), 9), 0)) FROM b)""",
    "a11_ece_one_vs_rest": BASE + _ece("t", "model, label", "q", "(gold = label)", _edges("q"), "ece"),
    "j02_exact_alignment": f"""WITH {GOLD.strip()},{PRED}
SELECT gg.row_id, gg.question_id, gold, round(a.confidence, 10) AS confidence FROM gg JOIN pr a ON a.row_id = gg.row_id AND a.question_id = 'verdict' AND a.model = '{A}'
JOIN pr b ON b.row_id = gg.row_id AND b.question_id = 'verdict' AND b.model = '{B}' WHERE gg.question_id = 'verdict'""",
    "j04_raw_pairs": f"""WITH {GOLD.strip()},{PRED}
SELECT model, row_id, gold, round(coalesce(any_value(p) FILTER (label = gold), 0), 10) AS p_gold, round(sum(p), 10) AS mass FROM pl JOIN gg USING (row_id, question_id) WHERE question_id = 'verdict' GROUP BY ALL""",
    "j14_three_way": f"""WITH {GOLD.strip()},{PRED},
w AS (SELECT row_id, model, arg_min(label, pos) FILTER (p = mx) AS first FROM (SELECT *, max(p) OVER (PARTITION BY row_id, model) AS mx FROM pl WHERE question_id = 'verdict') GROUP BY ALL)
SELECT gg.row_id, gold, a.first AS first_a, b.first AS first_b FROM gg JOIN w a ON a.row_id = gg.row_id AND a.model = '{A}' JOIN w b ON b.row_id = gg.row_id AND b.model = '{B}' WHERE question_id = 'verdict'""",
    "j15_regression": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY row_id, question_id ORDER BY ord) AS i, row_number() OVER (PARTITION BY row_id, question_id ORDER BY ord DESC) AS j FROM predictions WHERE model = '{A}' AND row_id IS NOT NULL),
l AS (SELECT row_id, question_id, i = 1 AS old, j = 1 AS new, pos, e.key AS label, e.value AS p FROM (SELECT *, unnest(map_entries(probs)) AS e, generate_subscripts(map_entries(probs), 1) AS pos FROM r WHERE i = 1 OR j = 1)),
v AS (SELECT *, sum(p) OVER w AS s, max(p) OVER w AS mx, count(*) FILTER (WHERE p IS NULL OR isnan(p) OR isinf(p) OR p < 0) OVER w AS bad FROM l WINDOW w AS (PARTITION BY row_id, question_id, old, new)),
k AS (SELECT row_id, question_id, old, new, map_from_entries(list((label, p / s) ORDER BY pos)) AS d, arg_min(label, pos) FILTER (p = mx) AS top FROM v WHERE bad = 0 AND s > 0 GROUP BY ALL),
b AS (SELECT x.d AS dx, y.d AS dy, x.top <> y.top AS moved FROM k x JOIN k y USING (row_id, question_id) WHERE x.old AND y.new),
z AS (SELECT moved, list_max(list_transform(map_entries(dx), lambda e: abs(e.value - coalesce(dy[e.key], 0)))) AS delta FROM b)
SELECT count(*) AS n, round(max(delta), 10) AS max_delta, count(*) FILTER (moved) AS moved, count(*) FILTER (moved) = 0 AND max(delta) < 1e-6 AS passed FROM z""",
    "u04_key_differences": f"""WITH {GOLD.strip()},{PRED},
w AS (SELECT DISTINCT row_id, question_id FROM gg WHERE question_id = 'verdict' AND lower(trim(split)) IN ('val', 'validation', 'dev', 'test')),
d AS (SELECT m.model, 'missing' AS side, row_id || '/' || question_id AS key FROM w, (SELECT DISTINCT model FROM pr) m WHERE (m.model, row_id, question_id) NOT IN (SELECT (model, row_id, question_id) FROM pr)
  UNION ALL SELECT DISTINCT model, 'extra', row_id || '/' || question_id FROM pr WHERE (row_id, question_id) NOT IN (SELECT (row_id, question_id) FROM w))
SELECT model, side, count(*) AS n, array_to_string(list(key ORDER BY key)[1:3], ' ') AS sample FROM d GROUP BY ALL""",
    "p16_malformed": f"""WITH {GOLD.strip()},{PRED},
s AS (SELECT row_id, question_id, list(label ORDER BY label) AS space FROM gn GROUP BY ALL),
h AS (SELECT row_id, question_id, model, list(label ORDER BY label) AS have, count(*) FILTER (p IS NULL OR isnan(p) OR isinf(p)) AS odd, count(*) FILTER (NOT isnan(p) AND p < 0) AS neg, sum(p) AS total FROM pl GROUP BY ALL),
x AS (SELECT pr.model, pr.row_id, pr.question_id, concat_ws(',', CASE WHEN have IS NULL THEN 'missing' END, CASE WHEN have <> space THEN 'labels' END, CASE WHEN odd > 0 THEN 'not_finite' END, CASE WHEN neg > 0 THEN 'negative' END,
    CASE WHEN total <= 0 THEN 'no_mass' END, CASE WHEN abs(total - 1) > 1e-6::DOUBLE THEN 'sum' END, CASE WHEN pr.confidence IS NULL OR isnan(pr.confidence) THEN 'no_confidence' END,
    CASE WHEN pr.confidence < -1e-9::DOUBLE OR (NOT isnan(pr.confidence) AND pr.confidence > 1 + 1e-9::DOUBLE) THEN 'confidence_range' END) AS problems
  FROM pr JOIN s USING (row_id, question_id) LEFT JOIN h ON h.row_id = pr.row_id AND h.question_id = pr.question_id AND h.model = pr.model)
SELECT * FROM x WHERE problems <> ''""",
    "a11_ece_macro": BASE + "SELECT model, round(avg(ece), 10) AS ece_macro FROM (" + _ece("t", "model, label", "q", "(gold = label)", _edges("q"), "ece").replace(", 10) AS ece", ", 15) AS ece") + ") GROUP BY model",
    "a12_confidence_gap": BASE + """, k AS (SELECT * FROM b WHERE confidence IS NOT NULL AND NOT isnan(confidence)),
g AS (SELECT model, count(*) AS n, round(max(abs(confidence - top)), 10) AS max_gap, round(avg(abs(confidence - top)), 10) AS mean_gap FROM k GROUP BY model),
x AS (""" + _ece("k", "model", "confidence", "ok", _edges("confidence"), "ece_stored") + "), y AS (" + _ece("k", "model", "top", "ok", _edges("top"), "ece_top") + ") SELECT * FROM g JOIN x USING (model) JOIN y USING (model)",
    "a14_recall_by_passages": BASE + f""", np AS (SELECT row_id, CAST(CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' AND json_type(state, '$.evidence') = 'ARRAY' THEN json_array_length(state, '$.evidence') ELSE 0 END AS INTEGER) AS passages FROM f)
SELECT model, passages, gold AS label, count(*) AS n, round(avg(ok), 10) AS recall FROM b JOIN np USING (row_id) GROUP BY GROUPING SETS ((model, passages), (model, passages, gold))""",
    "a19_asymptotic": BASE + """, d AS (SELECT count(*) AS n, count(*) FILTER (ok_a = 1 AND ok_b = 0) AS x, count(*) FILTER (ok_a = 0 AND ok_b = 1) AS y FROM ab), z AS (SELECT n, abs(x - y) / sqrt(x + y) AS z FROM d)
SELECT n, round(z, 10) AS z, round(1 - 2 / sqrt(pi()) * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z.z / sqrt(2) * i / 2000, 2))) FROM range(2001) AS r(i)) * (z.z / sqrt(2) / 2000) / 3, 10) AS p FROM z""",
    "a22_single_passage": BASE + """SELECT gold, count(*) AS n, round(avg(ok_a), 10) AS recall_a, round(avg(ok_b), 10) AS recall_b, round(avg(ok_b) - avg(ok_a), 10) AS delta, CAST(sum(ok_b) - sum(ok_a) AS BIGINT) AS "rows"
FROM ab JOIN f USING (row_id) WHERE CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' AND json_type(state, '$.evidence') = 'ARRAY' THEN json_array_length(state, '$.evidence') END = 1 GROUP BY gold""",
    "a33_headroom": BASE + "SELECT count(*) AS n, count(*) FILTER (ok_a = 1) AS right_a, count(*) FILTER (ok_b = 1) AS right_b, count(*) FILTER (ok_a + ok_b > 0) AS either, count(*) FILTER (ok_a + ok_b = 0) AS neither FROM ab",
    "a30_cost": """WITH l AS (SELECT line->>'$.key' AS key, try_cast(line->>'$.answer.usage.input_tokens' AS INT) AS tokens, ord FROM cache_lines WHERE json_valid(line)),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) > 1 AS cached FROM l WHERE key IS NOT NULL)
SELECT count(*) FILTER (NOT cached) AS live, count(*) FILTER (cached) AS cached, CAST(sum(CASE WHEN cached THEN 0 ELSE coalesce(tokens, 450) END) AS BIGINT) AS tokens, round(sum(CASE WHEN cached THEN 0 ELSE coalesce(tokens, 450) END) * (0.042::DOUBLE / 1e6), 10) AS usd FROM k""",
    "a36_policy_terms": BASE + """, y AS (SELECT *, avg(ok) OVER (PARTITION BY model) AS base FROM b)
SELECT model, round(avg(-least(greatest(ok - base, -1), 1) * ln(greatest(top, 1e-15))), 10) AS loss, round(any_value(base), 10) AS baseline, round(stddev_pop(ok), 10) AS reward_std, stddev_pop(ok) = 0 AS degenerate FROM y GROUP BY model""",
    "f09_decision_rule": BASE + """, h AS (SELECT b.model, b.row_id, b.question_id, pn.label, pow(pn.pn, 1 / 1.5::DOUBLE) * CASE pn.label WHEN 'not_enough_info' THEN 1.2::DOUBLE WHEN 'refuted' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS x FROM b JOIN pn USING (model, row_id, question_id))
SELECT model, row_id, question_id, label, round(x / sum(x) OVER (PARTITION BY model, row_id, question_id), 10) AS p FROM h""",
    "f11_wordings": BASE + """, c AS (SELECT row_id, coalesce(CASE WHEN json_valid(state) THEN state->>'$.claim' END, state) AS claim, questions['verdict'].instructions AS wording FROM f),
v AS (SELECT b.model AS m, b.row_id AS r, claim, wording FROM b JOIN c ON c.row_id = b.row_id WHERE b.question_id = 'verdict' AND wording IS NOT NULL),
k AS (SELECT m, claim, wording, count(DISTINCT r) AS n FROM v GROUP BY ALL), y AS (SELECT m, claim, count(*) AS n FROM k GROUP BY ALL),
x AS (SELECT v.m, v.claim, v.wording, pn.label, sum(pn.pn) / any_value(k.n) AS p FROM v JOIN pn ON pn.model = v.m AND pn.row_id = v.r AND pn.question_id = 'verdict'
  JOIN k ON k.m = v.m AND k.claim = v.claim AND k.wording = v.wording GROUP BY ALL)
SELECT x.m AS model, md5(x.claim) AS claim, label, round(sum(p) / any_value(y.n), 10) AS p FROM x JOIN y ON y.m = x.m AND y.claim = x.claim GROUP BY x.m, x.claim, label""",
    "f11_ensemble": BASE + """, w AS (SELECT b.row_id, b.question_id, b.gold, pn.label, round(sum(pn.pn) / count(DISTINCT b.model), 10) AS p FROM b JOIN pn USING (model, row_id, question_id) GROUP BY ALL)
SELECT row_id, question_id, gold, arg_min(label, label) FILTER (p = mx) AS pred, round(max(mx), 10) AS top FROM (SELECT *, max(p) OVER (PARTITION BY row_id, question_id) AS mx FROM w) GROUP BY ALL""",
    "a13_selective_risk": BASE + """, k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY conf DESC) AS rk, count(*) OVER (PARTITION BY model) AS n FROM b)
SELECT model, c AS target_coverage, round(min(conf), 10) AS threshold, count(*) AS selected, round(count(*) / max(n), 10) AS coverage, round(1 - avg(ok), 10) AS risk
FROM k CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) AS v(c) WHERE rk <= ceil(c * n) GROUP BY model, c""",
    "a14_recall_by_source": BASE + """SELECT model, source, gold AS label, count(*) AS n, round(avg(ok), 10) AS recall
FROM (SELECT model, coalesce(lower(trim(source)), '?') AS source, gold, ok FROM b) GROUP BY GROUPING SETS ((model, source), (model, source, gold))""",
    "a15_tie_sensitivity": BASE + """SELECT model, count(*) FILTER (nties > 1) AS ties, round(avg(ok), 10) AS accuracy, round(avg((pred_sorted = gold)::INTEGER), 10) AS accuracy_sorted
FROM b GROUP BY model""",
    "a16_agreement": BASE + """SELECT model, count(*) AS n, round(avg(ok), 10) AS top1, round(avg(tv), 10) AS mean_tv,
CASE WHEN stddev_pop(conf) > 0 AND stddev_pop(ok) > 0 THEN round(corr(conf, ok), 10) END AS conf_match FROM b JOIN r USING (model, row_id, question_id) GROUP BY model""",
    "a18_mcnemar": BASE + """, d AS (SELECT count(*) AS n, count(*) FILTER (ok_a = 1 AND ok_b = 0) AS x, count(*) FILTER (ok_a = 0 AND ok_b = 1) AS y FROM ab)
SELECT n, x AS only_a, y AS only_b, round(CASE WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(d.x + d.y + 1.0) - lgamma(i + 1.0) - lgamma(d.x + d.y - i + 1.0) - (d.x + d.y) * ln(2.0)))
  FROM range(least(d.x, d.y) + 1) AS q(i))) END, 10) AS p_exact, round(abs(x - y) / sqrt(x + y), 10) AS z FROM d""",
    "a21_flips": BASE + """SELECT pred_a, pred_b, count(*) AS n, count(*) FILTER (ok_a = 0 AND ok_b = 1) AS fixed, count(*) FILTER (ok_a = 1 AND ok_b = 0) AS broke,
count(*) FILTER (ok_a = ok_b) AS neither FROM ab WHERE pred_a <> pred_b GROUP BY ALL ORDER BY n DESC, pred_a, pred_b LIMIT 20""",
    "a22_recall_change": BASE + """SELECT gold, count(*) AS n, round(avg(ok_a), 10) AS recall_a, round(avg(ok_b), 10) AS recall_b, round(avg(ok_b) - avg(ok_a), 10) AS delta,
sum(ok_b) - sum(ok_a) AS rows FROM ab GROUP BY gold""".replace("sum(ok_b) - sum(ok_a) AS rows", "CAST(sum(ok_b) - sum(ok_a) AS BIGINT) AS \"rows\""),
    "a24_source_labels": f"""WITH {GOLD.strip()}
SELECT source, gold, count(*) AS n, CAST(grouping(source) AS INTEGER) AS all_outer, CAST(grouping(gold) AS INTEGER) AS all_inner
FROM (SELECT coalesce(lower(trim(source)), '?') AS source, gold FROM gg WHERE question_id = 'verdict') GROUP BY ROLLUP (source, gold)""",
    "a26_latency_percentiles": f"""WITH {PRED.strip()} SELECT model, count(*) AS n, round(quantile_disc(latency_ms, 0.5), 10) AS p50, round(quantile_disc(latency_ms, 0.95), 10) AS p95
FROM {_LATENCY} GROUP BY model""",
    "a27_floor_percentile": f"""WITH {PRED.strip()} SELECT model, n, round(latency_ms, 10) AS value FROM (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS k,
count(*) OVER (PARTITION BY model) AS n FROM {_LATENCY}) WHERE k = least(n - 1, floor(n * 0.95::DOUBLE)) + 1""",
    "a28_latency_spread": f"""WITH {PRED.strip()} SELECT model, round(median(latency_ms), 10) AS median, round(min(latency_ms), 10) AS least, round(max(latency_ms), 10) AS most,
round(avg((latency_ms > 200)::INTEGER), 10) AS over FROM {_LATENCY} GROUP BY model""".replace(" AS over", " AS \"over\""),
    "a32_without_shortcut": BASE + """SELECT model, count(*) AS n, round(avg(ok), 10) AS accuracy, count(*) FILTER (NOT s) AS n_rest, round(avg(ok) FILTER (NOT s), 10) AS accuracy_rest
FROM (SELECT model, ok, coalesce(lower(trim(meta->>'$.arm')) = 'no_evidence', false) AS s FROM b) GROUP BY model""",
    "a33_over_claims": BASE + """SELECT model, round(coalesce(count(*) FILTER (gold = 'refuted' AND pred = 'supported') / nullif(count(*) FILTER (gold = 'refuted'), 0), 0), 10) AS refuted_as_supported,
round(coalesce(count(*) FILTER (gold = 'not_enough_info' AND pred = 'supported') / nullif(count(*) FILTER (gold = 'not_enough_info'), 0), 0), 10) AS undecided_as_supported FROM b GROUP BY model""",
    "a34_soft_loss": BASE + """SELECT model, round(avg(ce * coalesce(weight, 1.0) * CASE WHEN lower(trim(source)) = 'adversarial' THEN 2.0 ELSE 1.0 END), 10) AS loss
FROM b JOIN r USING (model, row_id, question_id) GROUP BY model""",
    "a35_reward_terms": BASE + """SELECT model, round(avg(reward), 10) AS reward, round(avg(kl), 10) AS kl, round(avg(h), 10) AS entropy, round(avg((top > 0.99)::INTEGER), 10) AS saturated
FROM b JOIN r USING (model, row_id, question_id) JOIN (SELECT model, row_id, question_id, -sum(CASE WHEN pn > 0 THEN pn * ln(pn) ELSE 0 END) AS h FROM pn GROUP BY ALL) USING (model, row_id, question_id)
GROUP BY model""",
}
