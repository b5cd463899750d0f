"""Queries of synthesis, request handling, reports and puzzles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist, text
from ..operators import calibration as cal
from ..operators import gates, puzzles, reports, serving
from ..plans.runtime import table
from ..plans.synthesis import synthetic_rows
from ..sources.jsonl import checksums
from .building import _ONE, _one
from .metrics import BASE, GOLD, _gold, _preds, pairs, rounded


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    rows = synthetic_rows(spark, table(spark, d, "fixture").count())
    return rows.groupBy("split", "source", F.get_json_object("meta", "$.arm").alias("arm"), F.get_json_object("meta", "$.oracle_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("facts"))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_rows")
    return rows.select("row_id", "question_id", serving.flat_state(F.to_json("messages")).alias("state"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Questions of every record, and of each with its criteria taken away."""
    rows = _one(spark, d, "questions")
    bare = F.transform_values("questions", lambda _, q: F.struct(q["kind"].alias("kind"), q["instructions"].alias("instructions"), F.lit("{}").alias("criteria")))
    found = rows.select("row_id", F.explode(F.array(F.struct(F.lit("given").alias("form"), F.col("questions").alias("q")), F.struct(F.lit("bare").alias("form"), bare.alias("q")))).alias("x"))
    return found.select("row_id", "x.form", F.array_join(F.array_sort(serving.request_problems(F.col("x.q"))), ",").alias("problems")).where("problems <> ''")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    kinds = _one(spark, d, "questions").select("row_id", F.explode("questions").alias("question_id", "q")).select("row_id", "question_id", "q.kind")
    rows = _gold(spark, d).select("row_id", "question_id", F.col("target").alias("answer")).join(kinds, ["row_id", "question_id"])
    return rounded(serving.answers(rows).select("row_id", "question_id", F.col("choice.choice").alias("choice"), F.col("noul.noul").alias("noul"), F.col("score.score").alias("score")), 3)


def _arms(spark: SparkSession, d: str) -> DataFrame:
    arm = F.coalesce(F.nullif(F.lower(F.trim(F.get_json_object("meta", "$.arm"))), F.lit("")), F.lit("plain"))
    return reports.arm_accuracy(pairs(spark, d, "meta"), arm, ["model"])


def _routed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fixture").where("row_id is not null").withColumn("split", F.lower(F.trim("split")))
    sets = {"test": rows.where("split = 'test'"), "all": rows}
    return rounded(reports.routed(_preds(spark, d), sets))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit over the rows that two models answered well, as (model, metric, value); a gate before it stops at any other row."""
    kept = pairs(spark, d).where("question_id = 'verdict' and model in ('clf-large', 'clf-small')")
    whole = kept.groupBy("row_id").agg(F.count_distinct("model").alias("n")).where("n = 2").select("row_id")
    gold = _gold(spark, d).where("question_id = 'verdict'").join(whole, "row_id", "left_semi")
    gold = gold.withColumn("target", dist.one_hot(dist.labels(F.col("target")), F.col("gold")))
    preds = _preds(spark, d).join(gold.select("row_id", "question_id"), ["row_id", "question_id"], "left_semi")
    preds = preds.withColumn("raw", dist.normalize(F.col("raw"))).withColumn("confidence", dist.clip(dist.confidence(F.col("confidence"), F.col("raw")), 0, 1))
    found = reports.audit(gold, preds, ["clf-large", "clf-small"])
    assert reports.markdown(found).count("|") > 20
    rows = [(m, k, round(float(v), 9)) for m, x in found["models"].items() for k, v in x.items() if isinstance(v, (int, float))]
    rows += [("both", k, float(found["paired"][k])) for k in ("only_a", "only_b")]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def _extremes(spark: SparkSession, d: str) -> DataFrame:
    """Three longest, three middle and three shortest states."""
    rows = _one(spark, d, "state").where("state is not null").select("row_id", F.length("state").alias("chars"))
    n = rows.count()
    ends = rows.orderBy("chars", "row_id").limit(3).withColumn("place", F.lit("short")).unionByName(rows.orderBy(F.desc("chars"), F.desc("row_id")).limit(3).withColumn("place", F.lit("long")))
    # The middle by counts of lengths, so that no task sorts all rows.
    per = rows.groupBy("chars").agg(F.count(F.lit(1)).alias("m")).withColumn("s", F.sum("m").over(Window.orderBy("chars").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    first = max(0, n // 2 - 1)
    near = rows.join(per.where((F.col("s") <= first + 2) & (F.col("s") + F.col("m") > first)), "chars")
    rank = F.col("s") + F.row_number().over(Window.partitionBy("chars").orderBy("row_id")) - 1
    mid = near.withColumn("k", rank).where(F.col("k").between(first, first + 2)).select("row_id", "chars", F.lit("middle").alias("place"))
    return ends.unionByName(mid)


def _knots(spark: SparkSession, d: str) -> DataFrame:
    """Of every question, the fitted map at each step that occurs."""
    rows = pairs(spark, d).where("model = 'clf-large'")
    out = None
    for q in ("verdict", "backed", "strength"):
        knots = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in cal.isotonic_knots(rows, q)))
        steps = rows.where(F.col("question_id") == q).select(F.explode(dist.values(F.col("answer"))).alias("p")).where("p > 0").select((F.round(F.col("p") * cal.STEPS) / cal.STEPS).alias("x")).distinct()
        part = steps.select(F.lit(q).alias("question_id"), "x", dist.interpolate(F.col("x"), knots).alias("y"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 9)


QUERIES = {
    "m06_synthetic_rows": _synthetic,
    "m13_isotonic": _knots,
    "p20_flat_state": _flat,
    "p20_request_problems": _requests,
    "p21_answers": _answers,
    "p22_flattened": lambda s, d: serving.flattened(table(s, d, "fixture").select("row_id", "ord", F.struct(F.col("source"), F.struct("split", "weight").alias("more")).alias("of"))),
    "a23_arm_accuracy": _arms,
    "a25_label_counts": lambda s, d: reports.label_counts(_gold(s, d)),
    "j07_routed": _routed,
    "o05_extremes": _extremes,
    "s17_checksums": lambda s, d: checksums(s, f"{d}/*.parquet"),
    "s23_audit_report": _audit,
}

SQL = {
    "s23_audit_report": BASE + """, two AS (SELECT row_id FROM b WHERE question_id = 'verdict' AND model IN ('clf-large', 'clf-small') GROUP BY row_id HAVING count(*) = 2),
k AS (SELECT b.*, least(greatest(b.conf, 0), 1) AS cf FROM b JOIN two USING (row_id) WHERE question_id = 'verdict' AND model IN ('clf-large', 'clf-small')),
h AS (SELECT k.model, k.row_id, k.gold, n.label, n.pn, (n.label = k.gold)::INT AS y FROM k JOIN pn n ON n.model = k.model AND n.row_id = k.row_id AND n.question_id = 'verdict'),
l AS (SELECT model, row_id, sum((pn - y) * (pn - y)) AS brier, -ln(greatest(max(CASE WHEN y = 1 THEN pn ELSE 0 END), 1e-15)) AS nll FROM h GROUP BY ALL),
d AS (SELECT DISTINCT model, label FROM h), pr3 AS (SELECT d.model, d.label, count(*) FILTER (k.gold = d.label) AS s, count(*) FILTER (k.pred = d.label) AS q, count(*) FILTER (k.gold = d.label AND k.pred = d.label) AS t FROM d JOIN k USING (model) GROUP BY ALL),
e AS (SELECT model, sum(m * abs(a - c)) / sum(m) AS v FROM (SELECT model, least(floor(cf * 10), 9) AS z, count(*) AS m, avg(cf) AS c, avg(ok) AS a FROM k GROUP BY ALL) GROUP BY model),
g AS (SELECT model, sum(m * abs(a - c)) / sum(m) AS v FROM (SELECT model, tile, count(*) AS m, avg(cf) AS c, avg(ok) AS a FROM (SELECT *, ntile(10) OVER (PARTITION BY model ORDER BY cf, row_id) AS tile FROM k) GROUP BY ALL) GROUP BY model),
z AS (SELECT model, 'n' AS metric, count(*)::DOUBLE AS value FROM k GROUP BY model UNION ALL SELECT model, 'accuracy', avg(ok) FROM k GROUP BY model
  UNION ALL SELECT model, 'macro_f1', avg(CASE WHEN s + q > 0 THEN 2 * t / (s + q) ELSE 0 END) FROM pr3 GROUP BY model UNION ALL SELECT model, 'brier', avg(brier) FROM l GROUP BY model UNION ALL SELECT model, 'nll', avg(nll) FROM l GROUP BY model
  UNION ALL SELECT model, 'ece', v FROM e UNION ALL SELECT model, 'ece_adaptive', v FROM g UNION ALL SELECT model, 'ties', count(*) FILTER (nties > 1) FROM k GROUP BY model
  UNION ALL SELECT model, 'accuracy_sorted', avg((pred_sorted = gold)::INT) FROM k GROUP BY model
  UNION ALL SELECT model, 'refuted_as_supported', coalesce(count(*) FILTER (gold = 'refuted' AND pred = 'supported') / nullif(count(*) FILTER (gold = 'refuted'), 0), 0) FROM k GROUP BY model
  UNION ALL SELECT model, 'undecided_as_supported', coalesce(count(*) FILTER (gold = 'not_enough_info' AND pred = 'supported') / nullif(count(*) FILTER (gold = 'not_enough_info'), 0), 0) FROM k GROUP BY model
  UNION ALL SELECT 'both', 'only_a', count(*) FROM k x JOIN k y USING (row_id) WHERE x.model = 'clf-large' AND y.model = 'clf-small' AND x.ok = 1 AND y.ok = 0
  UNION ALL SELECT 'both', 'only_b', count(*) FROM k x JOIN k y USING (row_id) WHERE x.model = 'clf-large' AND y.model = 'clf-small' AND x.ok = 0 AND y.ok = 1)
SELECT model, metric, round(value, 9) AS value FROM z""",
    "m13_isotonic": BASE + """, k AS (SELECT b.question_id, round(pn.pn * 4096) / 4096 AS x, coalesce(gn.yn, 0) AS y FROM b JOIN pn ON pn.model = b.model AND pn.row_id = b.row_id AND pn.question_id = b.question_id
  LEFT JOIN gn ON gn.row_id = b.row_id AND gn.question_id = b.question_id AND gn.label = pn.label WHERE b.model = 'clf-large' AND pn.pn > 0),
s0 AS (SELECT question_id, x, sum(y) AS y, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY x) AS i FROM s0),
c AS (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY question_id ORDER BY i)),
v AS (SELECT a.question_id, a.i AS j, z.i AS k, (z.cy - a.cy + a.y) / (z.cn - a.cn + a.n) AS v FROM c a JOIN c z ON z.question_id = a.question_id AND z.i >= a.i),
m AS (SELECT question_id, j, k, min(v) OVER (PARTITION BY question_id, j ORDER BY k DESC) AS m FROM v)
SELECT s.question_id, round(s.x, 9) AS x, round(max(m.m), 9) AS y FROM s JOIN m ON m.question_id = s.question_id AND m.k = s.i AND m.j <= s.i GROUP BY s.question_id, s.x""",
    "p20_request_problems": f"""WITH {_ONE}, q AS (SELECT row_id, e.key AS k, e.value AS q FROM (SELECT row_id, unnest(map_entries(questions)) AS e FROM o)),
x AS (SELECT row_id, f.form, k, CASE WHEN lower(coalesce(q.kind, 'choice')) NOT IN ('choice', 'noul', 'score') THEN k || ': unknown kind'
  WHEN lower(coalesce(q.kind, 'choice')) <> 'noul' AND (f.form = 'bare' OR coalesce(trim(q.criteria) IN ('', '{{}}', '[]', 'null'), true)) THEN k || ': no criteria' END AS p FROM q, (VALUES ('given'), ('bare')) AS f(form))
SELECT row_id, form, string_agg(p, ',' ORDER BY p) AS problems FROM x WHERE p IS NOT NULL GROUP BY ALL""",
    "j07_routed": """WITH p AS (SELECT DISTINCT model, row_id FROM predictions WHERE row_id IS NOT NULL), r AS (SELECT DISTINCT row_id, lower(trim(split)) AS split FROM fixture WHERE row_id IS NOT NULL),
c AS (SELECT 0 AS k, 'test' AS record_set, row_id, split FROM r WHERE split = 'test' UNION ALL SELECT 1, 'all', row_id, split FROM r),
h AS (SELECT model, k, record_set, count(DISTINCT p.row_id) AS matched, CASE WHEN min(split) = max(split) THEN min(split) ELSE 'mixed' END AS split FROM p JOIN c USING (row_id) GROUP BY ALL),
a AS (SELECT k, count(DISTINCT row_id) AS available FROM c GROUP BY k)
SELECT model, record_set, split, matched, available, round(matched / available, 10) AS coverage FROM h JOIN a USING (k) QUALIFY row_number() OVER (PARTITION BY model ORDER BY k) = 1""",
    "m06_synthetic_rows": """WITH n AS (SELECT count(*) AS n FROM fixture), a AS (SELECT unnest(['plain_support', 'two_passages', 'with_noise', 'plain_refute', 'against_itself', 'prompt_injection', 'no_evidence', 'beyond_passage', 'other_topic']) AS arm, generate_subscripts(range(9), 1) - 1 AS i),
g AS (SELECT k, row_number() OVER (ORDER BY md5('43:' || printf('fact-%03d', k))) - 1 AS p FROM range(40) AS x(k)),
r AS (SELECT i % 9 AS arm, (i // 9) % 40 AS fact FROM n, LATERAL (SELECT unnest(range(n)) AS i))
SELECT CASE WHEN p < 32 THEN 'train' WHEN p < 36 THEN 'val' ELSE 'test' END AS split, CASE WHEN a.arm IN ('against_itself', 'prompt_injection', 'no_evidence') THEN 'adversarial' ELSE 'synthetic' END AS source, a.arm,
  CASE WHEN a.i < 3 THEN 'supported' WHEN a.i < 6 THEN 'refuted' ELSE 'not_enough_info' END AS label, count(*) AS n, count(DISTINCT fact) AS facts FROM r JOIN a ON a.i = r.arm JOIN g ON g.k = r.fact GROUP BY ALL""",
    "p20_flat_state": "SELECT row_id, question_id, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), chr(10)) AS state FROM sft_rows",
    "p21_answers": f"""WITH {GOLD.strip()}, {_ONE}, k AS (SELECT row_id, e.key AS question_id, e.value.kind AS kind FROM (SELECT row_id, unnest(map_entries(questions)) AS e FROM o)),
s AS (SELECT row_id, question_id, sum(try_cast(label AS DOUBLE) * yn) AS score, sum(CASE WHEN label = 'yes' THEN yn ELSE 0 END) AS yes FROM gn GROUP BY ALL)
SELECT row_id, question_id, CASE WHEN kind = 'choice' THEN gold END AS choice, CASE WHEN kind = 'noul' THEN round(round(yes, 6), 3) END AS noul, CASE WHEN kind = 'score' THEN round(round(score, 4), 3) END AS score
FROM gg JOIN k USING (row_id, question_id) JOIN s USING (row_id, question_id)""",
    "p22_flattened": 'SELECT row_id, ord, source AS "of.source", split AS "of.more.split", weight AS "of.more.weight" FROM fixture',
    "a23_arm_accuracy": BASE + "SELECT model, arm, CAST(sum(ok) AS BIGINT) AS passed, count(*) AS total FROM (SELECT model, ok, coalesce(nullif(lower(trim(meta->>'$.arm')), ''), 'plain') AS arm FROM b) GROUP BY ALL",
    "a25_label_counts": f"""WITH {GOLD.strip()}, s AS (SELECT row_id, question_id, string_agg(label, ',' ORDER BY label) AS space FROM gn GROUP BY ALL)
SELECT space, gold AS label, count(*) AS n FROM gg JOIN s USING (row_id, question_id) GROUP BY ALL""",
    "o05_extremes": f"""WITH {_ONE}, r AS (SELECT row_id, length(state) AS chars, row_number() OVER (ORDER BY length(state), row_id) - 1 AS k, count(*) OVER () AS n FROM o WHERE state IS NOT NULL)
SELECT row_id, chars, 'short' AS place FROM r WHERE k < 3 UNION ALL SELECT row_id, chars, 'long' FROM r WHERE k >= n - 3
UNION ALL SELECT row_id, chars, 'middle' FROM r WHERE k BETWEEN greatest(0, n // 2 - 1) AND greatest(0, n // 2 - 1) + 2""",
}
