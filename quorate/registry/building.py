"""Queries of sources, record building, splits, plans, gates, chat records, calibration, scoring and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, text
from ..operators import calibration as cal
from ..operators import chat, etl, gates, scoring
from ..operators.metrics import accuracy
from ..operators.pairing import first_by
from ..plans import planning
from ..plans.runtime import materialize, scratch_path, table
from ..sources import jsonl
from ..streaming import caches
from .metrics import BASE, GOLD, _ece, _edges, pairs, rounded
from .nested import _EVIDENCE

SPACE = ["supported", "refuted", "not_enough_info"]


def _fixture(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fixture")


def _one(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row for each record: its first delivery."""
    return first_by(_fixture(spark, d).where("row_id is not null").select("row_id", "ord", *columns), ["row_id"], "ord")


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines and read again, strictly."""
    path = scratch_path(spark, "rows")
    rows = _fixture(spark, d).where("split is not null")  # a row without a split is no decision row: reading it is an error
    jsonl.write_rows(rows, path)
    back = jsonl.read_rows(spark, path)
    space = F.array_join(F.map_keys(F.try_element_at("labels", F.lit("verdict"))), ",")
    return back.select("row_id", "source", "group_id", F.get_json_object("state", "$.claim").alias("claim"), "weight", space.alias("space"), F.try_element_at("questions", F.lit("verdict"))["criteria"].isNotNull().alias("criteria"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.cache_view(table(spark, d, "cache_lines")).select("key", "ord", "answer.model", F.round("answer.confidence", 10).alias("confidence"))


def _cache_stream(spark: SparkSession, d: str) -> DataFrame:
    found = caches.cache_table(spark, f"{d}/cache_lines.parquet", table(spark, d, "cache_lines").schema)
    return found.select("key", "ord", "answer.model", F.round("answer.confidence", 10).alias("confidence"))


def _native(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "source", "meta").withColumn("native", F.get_json_object("meta", "$.label"))
    return etl.native_labels(rows, table(spark, d, "label_map")).select("row_id", "common")


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    out = etl.deduplicated(_one(spark, d, "state"), etl.dedupe_key(F.col("state"), F.col("row_id")))
    return out.select("row_id", F.coalesce("dup_count", F.lit(1)).alias("dup_count"), F.coalesce(F.array_join("dropped_row_ids", ","), F.lit("")).alias("dropped"))


def _components(spark: SparkSession, d: str) -> DataFrame:
    return etl.claim_components(_fixture(spark, d), F.get_json_object("state", "$.claim"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    groups = _one(spark, d, "group_id").where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(_components(spark, d), "group_id").groupBy("component").agg(F.sum("n").alias("n"))


def _straddling(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.trim("split"))
    return gates.straddling(_fixture(spark, d), "group_id", F.when(s.isin("dev", "validation"), "val").otherwise(s))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "state", "label_source", "labels").withColumn("label", dist.argmax(dist.from_map(F.try_element_at("labels", F.lit("verdict")))))
    states = rows.select(F.coalesce(F.get_json_object("state", "$.claim"), "state").alias("state_key"), "label", F.coalesce(F.lower(F.trim("label_source")) == "synthetic_oracle", F.lit(False)).alias("synthetic"))
    plan = planning.quota_plan(states, [f"fc-c{k}" for k in range(6)], SPACE, states.count() // 3)
    return plan.groupBy("label", "synthetic", "schema_id").agg(F.count(F.lit(1)).alias("n"))


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).where("model = 'clf-small'")
    rows = materialize(rows.select("row_id", "question_id", "gold", "target", "answer"), "pairs")  # read by the fits and three reports
    grid = [0.5, 0.75, 1.0, 1.5, 2.0, 4.0]
    best = min(cal.grid_losses(rows, [], grid).collect(), key=lambda r: (r.loss, r.t)).t
    return rounded(cal.report(cal.refreshed(rows), {"verdict": cal.isotonic_knots(rows, "verdict")}, best))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.requests(_one(spark, d, "state", "questions"))
    cache = rows.where("question_id = 'backed'").select(text.cache_key(F.lit("lex"), F.col("state"), F.col("question")).alias("key"), dist.from_noul(F.lit(0.7)).alias("answer"), F.lit(5.0).alias("latency_ms")).dropDuplicates(["key"])
    both, _ = scoring.answered(rows, cache, "lex", scoring.lexical_scorer)
    return both.groupBy("question_id", "cached").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(dist.total(F.col("answer")) - 1) < 1e-9).alias("whole"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    half = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("7"), F.col("vec_id").cast("string"))), 1, 4), 16, 10).cast("int") % 2
    answers = scoring.centroid_answers(rows.where(half == 1), scoring.centroids(rows, half == 0))
    return rounded(answers.select("vec_id", "gold", dist.argmax(F.col("answer")).alias("pred"), dist.top(F.col("answer")).alias("top")))


def centroid_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = _centroids(spark, d).withColumn("ok", (F.col("gold") == F.col("pred")).cast("int"))
    return rounded(accuracy(rows, ["gold"]))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "state").select("row_id", F.sha2(text.state_text(F.col("state")), 256).alias("text"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "questions").select("row_id", F.explode("questions").alias("question_id", "q"))
    return rows.select("row_id", "question_id", F.array_join(text.label_space(F.col("q.kind"), F.col("q.criteria")), ",").alias("labels"), text.question_text(F.col("q.instructions"), F.col("q.kind"), F.col("q.criteria")).alias("text"))


def _chats(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "split", "source", "group_id", "state", "questions", "labels", "weight", "label_source", "meta").where("lower(trim(split)) = 'train'")
    out = chat.chat_records(rows)
    return out.select("row_id", "question_id", "label", F.array_join("label_space", ",").alias("labels"), F.size("messages").alias("turns"), F.round("weight", 10).alias("weight"))


def _same_prompts(spark: SparkSession, d: str) -> DataFrame:
    """G7: the chat record's user turn is the evaluation prompt without its last cue."""
    rows = _one(spark, d, "split", "source", "group_id", "state", "questions", "labels", "weight", "label_source", "meta")
    user = chat.chat_records(rows).select("row_id", "question_id", F.get("messages", F.lit(1))["content"].alias("user"))
    both = user.join(scoring.requests(rows).select("row_id", "question_id", "prompt"), ["row_id", "question_id"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.concat("user", F.lit("\n\nVerdict:")) != F.col("prompt")).alias("different"))


def _options(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "group_id", "split", "state", "questions", "labels").where("size(questions) = 1")
    return chat.option_rows(rows).select("row_id", F.size("options").alias("options"), "label")


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    found = chat.recovered_states(table(spark, d, "sft_rows"), _fixture(spark, d))
    return found.select("row_id", "question_id", "gt_row_id", "found", F.get_json_object("state", "$.claim").alias("claim"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.grid_losses(pairs(spark, d), ["model"], [0.5, 0.75, 1.0, 1.5, 2.0, 4.0]))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = planning.runs(table(spark, d, "events"), "event_type", "event_id", ["user_id"])
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    rows = planning.strided(_one(spark, d, "state"), 8)
    out = planning.length_batches(rows, F.length("state"), 16)
    return out.groupBy("chunk", "batch").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("state")).alias("least"), F.max(F.length("state")).alias("most"))


def _budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cache_lines").select("ord", F.get_json_object("line", "$.answer.usage.input_tokens").try_cast("int").alias("tokens"))
    return planning.within_budget(rows, 0.003, block=100).select("ord")


def _window_stream(spark: SparkSession, d: str) -> DataFrame:
    """The windows a stream has closed: all but those the watermark still holds open."""
    events = table(spark, d, "events")
    frame = caches.event_counts(caches.stream_of(spark, f"{d}/events.parquet", events.schema))
    return rounded(caches.run_once(frame, "windows"))


QUERIES = {
    "s01_jsonl_round_trip": _written,
    "s06_cache_last_write": _cache,
    "s07_cache_stream": _cache_stream,
    "p02_question_text": _questions,
    "p05_state_text": _rendered,
    "p08_option_rows": _options,
    "p18_chat_records": _chats,
    "p04x_native_labels": _native,
    "w01_deduplicated": _deduplicated,
    "w04_every_kth": lambda s, d: planning.every_kth(_one(s, d), 3).select("row_id", "variant"),
    "w07_length_batches": _batches,
    "w08_runs": _runs,
    "m01_components": _components,
    "m02_greedy_split": lambda s, d: etl.greedy_splits(_sizes(s, d)),
    "m03_capped_groups": lambda s, d: etl.capped_groups(_one(s, d, "group_id"), 700).select("row_id", "group_id"),
    "m04_ratio_split": lambda s, d: etl.ratio_splits(_fixture(s, d), "group_id"),
    "m08_quota_plan": _plan,
    "m09_within_budget": _budget,
    "m11_cached_answers": _answers,
    "m12_temperature_grid": _grid,
    "m14_calibration": _calibrated,
    "m15_carve": lambda s, d: etl.carve(_one(s, d, "group_id")),
    "m16_centroids": _centroids,
    "m16_centroid_eval": centroid_eval,
    "j06_recovered_states": _recovered,
    "j09_without_carve": lambda s, d: etl.without_carve(table(s, d, "sft_rows"), etl.carve(_one(s, d, "group_id")), _fixture(s, d).where("lower(trim(split)) = 'val'")).select("row_id", "question_id"),
    "g05_straddling": _straddling,
    "g07_prompt_alignment": _same_prompts,
    "x01_event_windows": lambda s, d: rounded(caches.event_counts(table(s, d, "events"))),
    "x01_event_window_stream": _window_stream,
    "x02_sessions": lambda s, d: caches.sessions(table(s, d, "events")),
}

_ONE = "o AS (SELECT * FROM fixture WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ord) = 1)"
_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))".format
_OBJECT = "json_valid(state) AND json_type(state) = 'OBJECT'"
_CARVE = f"""g AS (SELECT group_id, count(*) AS n FROM o WHERE group_id IS NOT NULL GROUP BY group_id),
c AS (SELECT group_id, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('42:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM g)
      WHERE s < CAST(floor((SELECT sum(n) FROM g) * 0.15::DOUBLE) AS BIGINT))"""
_COMPONENTS = f"""
k AS (SELECT DISTINCT group_id AS g, {_NORM("state->>'$.claim'")} AS c FROM fixture WHERE group_id IS NOT NULL AND CASE WHEN {_OBJECT} THEN state->>'$.claim' IS NOT NULL ELSE false END),
e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM k x JOIN k y USING (c) WHERE x.g <> y.g AND c <> ''),
w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
comp AS (SELECT g AS group_id, least(g, coalesce(min(b), g)) AS component FROM (SELECT DISTINCT g FROM k WHERE c <> '') q LEFT JOIN w ON w.a = q.g GROUP BY g)"""
_GOOD = """SELECT ord, line, line::JSON AS j FROM cache_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT' AND line->>'$.key' IS NOT NULL AND json_type(line, '$.answer.distributions') = 'OBJECT'"""
_LAST = f"""SELECT j->>'$.key' AS key, max(ord) AS ord, arg_max(j->>'$.answer.model', ord) AS model, round(arg_max((j->>'$.answer.confidence')::DOUBLE, ord), 10) AS confidence
FROM ({_GOOD}) GROUP BY key"""
_HALF = "('0x' || substr(md5('7:' || vec_id), 1, 4))::INT % 2"
_CENTERS = f"""h AS (SELECT *, {_HALF} AS half FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM h WHERE half = 0) GROUP BY ALL),
q AS (SELECT vec_id, h.label AS gold, m.label AS label, -sum((x - m.m) * (x - m.m)) AS z
      FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM h WHERE half = 1) h JOIN m USING (i) GROUP BY ALL),
s AS (SELECT vec_id, gold, label, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM q),
a AS (SELECT vec_id, CAST(gold AS VARCHAR) AS gold, CAST(arg_max(label, x) AS VARCHAR) AS pred, round(max(x) / sum(x), 10) AS top FROM s GROUP BY vec_id, gold)"""
SQL = {
    "s01_jsonl_round_trip": """SELECT row_id, source, group_id, CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state->>'$.claim' END AS claim, coalesce(weight, 1.0) AS weight,
  array_to_string(map_keys(labels['verdict']), ',') AS space, questions['verdict'].criteria IS NOT NULL AS criteria FROM (SELECT row_id, source, group_id, CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state ELSE '{}' END AS state, weight, labels, questions FROM fixture WHERE split IS NOT NULL)""",
    "s06_cache_last_write": _LAST,
    "s07_cache_stream": _LAST,
    "p02_question_text": f"""WITH {_ONE},
q AS (SELECT row_id, e.key AS question_id, e.value AS q FROM (SELECT row_id, unnest(map_entries(questions)) AS e FROM o)),
l AS (
  SELECT row_id, question_id, q.instructions AS t, i, x AS label, q.criteria::JSON->>('$."' || x || '"') AS d FROM (SELECT *, unnest(json_keys(q.criteria)) AS x, generate_subscripts(json_keys(q.criteria), 1) AS i FROM q WHERE q.kind = 'choice')
  UNION ALL SELECT row_id, question_id, q.instructions, i, CAST(i AS VARCHAR), q.criteria::JSON->>('$[' || i || ']') FROM q, LATERAL (SELECT unnest(range(json_array_length(q.criteria)::BIGINT)) AS i) WHERE q.kind = 'score'
  UNION ALL SELECT row_id, question_id, q.instructions, i, x, q.criteria::JSON->>('$.' || x) FROM q, (VALUES (0, 'yes'), (1, 'no')) AS v(i, x) WHERE q.kind = 'noul')
SELECT row_id, question_id, string_agg(label, ',' ORDER BY i) AS labels, any_value(t) || chr(10) || string_agg(label || coalesce(': ' || nullif(d, ''), ''), chr(10) ORDER BY i) AS text
FROM l GROUP BY row_id, question_id""",
    "p08_option_rows": f"""WITH {GOLD.strip()}, {_ONE}
SELECT o.row_id, len(k) AS options, list_position(k, gold) - 1 AS label FROM (SELECT row_id, json_keys(map_entries(questions)[1].value.criteria) AS k FROM o WHERE cardinality(questions) = 1) o
JOIN gg ON gg.row_id = o.row_id""",
    "p18_chat_records": f"""WITH {GOLD.strip()}
SELECT gg.row_id, gg.question_id, gold AS label, labels, 3 AS turns, round(coalesce(weight, 1.0), 10) AS weight FROM gg JOIN (
  SELECT row_id, question_id, CASE q.kind WHEN 'choice' THEN array_to_string(json_keys(q.criteria), ',') WHEN 'noul' THEN 'yes,no' ELSE array_to_string(range(json_array_length(q.criteria)::BIGINT), ',') END AS labels
  FROM (SELECT row_id, e.key AS question_id, e.value AS q FROM (SELECT row_id, unnest(map_entries(questions)) AS e FROM f))) USING (row_id, question_id)
WHERE lower(trim(split)) = 'train'""",
    "p04x_native_labels": f"""WITH {_ONE} SELECT o.row_id, m.label AS common FROM o JOIN label_map m ON lower(trim(o.source)) = lower(trim(m.source)) AND lower(trim(o.meta->>'$.label')) = lower(trim(m.native_label))""",
    "w01_deduplicated": f"""WITH {_ONE},
r AS (SELECT row_id, ord, {_NORM("coalesce(state->>'$.claim', '')")} AS c FROM o WHERE CASE WHEN {_OBJECT} THEN state->>'$.claim' IS NOT NULL ELSE false END),
t AS (SELECT row_id, string_agg(DISTINCT t, chr(1) ORDER BY t) AS t FROM (SELECT e.row_id, {_NORM('e.text')} AS t FROM ({_EVIDENCE}) e JOIN r ON r.row_id = e.row_id AND r.ord = e.ord WHERE e.text IS NOT NULL) GROUP BY row_id),
k AS (SELECT r.row_id, r.ord, c || chr(2) || coalesce(t, '') || (t IS NULL)::VARCHAR AS k FROM r LEFT JOIN t USING (row_id)
  UNION ALL SELECT row_id, ord, chr(3) || coalesce(nullif({_NORM("coalesce(state, '')")}, ''), chr(4) || row_id) FROM o WHERE row_id NOT IN (SELECT row_id FROM r))
SELECT arg_min(row_id, ord) AS row_id, count(*) AS dup_count, coalesce(array_to_string((list(row_id ORDER BY ord))[2:], ','), '') AS dropped FROM k GROUP BY k""",
    "w04_every_kth": f"WITH {_ONE} SELECT row_id, CAST(floor(i / 3) AS BIGINT) % 5 AS variant FROM (SELECT row_id, row_number() OVER (ORDER BY ord) - 1 AS i FROM o) WHERE i % 3 = 0",
    "w07_length_batches": f"""WITH {_ONE} SELECT chunk, CAST(floor(b / 16) AS BIGINT) AS batch, count(*) AS n, min(l) AS least, max(l) AS most
FROM (SELECT ord % 8 AS chunk, length(state) AS l, row_number() OVER (PARTITION BY ord % 8 ORDER BY length(state), row_id) - 1 AS b FROM o) GROUP BY ALL""",
    "w08_runs": """SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY ALL""",
    "m01_components": f"WITH RECURSIVE {_COMPONENTS.strip()} SELECT group_id, component FROM comp",
    "m02_greedy_split": f"""WITH RECURSIVE {_ONE}, {_COMPONENTS.strip()},
z AS (SELECT component, count(*) AS n FROM o JOIN comp USING (group_id) GROUP BY component),
y AS (SELECT component, n::DOUBLE AS n, row_number() OVER (ORDER BY md5('42:' || component), component) AS i, sum(n) OVER ()::DOUBLE AS t FROM z),
f(i, component, s, a, b, c) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::INT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE
  UNION ALL SELECT i, component, s, CASE WHEN s = 0 THEN a + n ELSE a END, CASE WHEN s = 1 THEN b + n ELSE b END, CASE WHEN s = 2 THEN c + n ELSE c END FROM (
    SELECT y.i, y.component, y.n, f.a, f.b, f.c, CASE WHEN 0.8::DOUBLE * t - a >= greatest(0.1::DOUBLE * t - b, 0.1::DOUBLE * t - c) THEN 0 WHEN 0.1::DOUBLE * t - b >= 0.1::DOUBLE * t - c THEN 1 ELSE 2 END AS s
    FROM f JOIN y ON y.i = f.i + 1))
SELECT component, CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM f WHERE i > 0""",
    "m04_ratio_split": """WITH g AS (SELECT group_id, row_number() OVER (ORDER BY md5('43:' || group_id), group_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM fixture WHERE group_id IS NOT NULL))
SELECT group_id, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM g""",
    "m09_within_budget": """SELECT ord FROM (SELECT ord, coalesce(sum(t) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
  SELECT ord, coalesce(CASE WHEN json_valid(line) THEN try_cast(line->>'$.answer.usage.input_tokens' AS INT) END, 450) AS t FROM cache_lines)) WHERE (s + 450) * (0.042::DOUBLE / 1e6) <= 0.003::DOUBLE""",
    "m03_capped_groups": f"""WITH RECURSIVE {_ONE}, z AS (SELECT group_id, count(*) AS n FROM o GROUP BY group_id),
y AS (SELECT group_id, n, row_number() OVER (ORDER BY md5(concat_ws(':', '42', group_id)), group_id) AS i FROM z),
f(i, group_id, taken, got) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, false
  UNION ALL SELECT y.i, y.group_id, CASE WHEN f.taken > 0 AND f.taken + n > 700 THEN f.taken ELSE f.taken + n END, NOT (f.taken > 0 AND f.taken + n > 700) FROM f JOIN y ON y.i = f.i + 1 WHERE f.taken < 700)
SELECT o.row_id, o.group_id FROM o JOIN f ON f.got AND f.group_id IS NOT DISTINCT FROM o.group_id ORDER BY ord LIMIT 700""",
    "m08_quota_plan": f"""WITH RECURSIVE {_ONE},
v AS (SELECT row_id, arg_min(label, pos) FILTER (p = mx) AS label FROM (SELECT row_id, pos, e.key AS label, e.value AS p, max(e.value) OVER (PARTITION BY row_id) AS mx FROM (
  SELECT row_id, unnest(map_entries(labels['verdict'])) AS e, generate_subscripts(map_entries(labels['verdict']), 1) AS pos FROM o)) GROUP BY row_id),
x AS (SELECT coalesce(CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state->>'$.claim' END, state) AS k, label, coalesce(lower(trim(label_source)) = 'synthetic_oracle', false) AS made FROM o LEFT JOIN v USING (row_id)),
s AS (SELECT k, arg_min(label, (made, p)) AS label, arg_min(made, (made, p)) AS made FROM (SELECT *, list_position(['supported', 'refuted', 'not_enough_info'], label) AS p FROM x WHERE k IS NOT NULL) WHERE p IS NOT NULL GROUP BY k),
q(i, label, open, wm, pm, wf, pf) AS (
  SELECT 0, NULL::VARCHAR, (SELECT count(*) FROM x) // 3, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL SELECT i + 1, n.label, q.open - a.m - b.f, a.m, least(3, greatest(1, ceil(a.m / greatest(n.made, 1))))::BIGINT, b.f, least(6, greatest(1, ceil((c.part - a.m) / greatest(n.found, 1))))::BIGINT
  FROM q JOIN (SELECT list_position(['supported', 'refuted', 'not_enough_info'], label) AS p, label, count(*) FILTER (made) AS made, count(*) FILTER (NOT made) AS found FROM s GROUP BY label) n ON n.p = q.i + 1,
    LATERAL (SELECT q.open // (3 - q.i) AS part) c, LATERAL (SELECT least(round_even(c.part * 0.1::DOUBLE, 0)::BIGINT, n.made * 3) AS m) a, LATERAL (SELECT least(c.part - a.m, n.found * 6) AS f) b),
w AS (SELECT label, true AS made, wm AS want, pm AS per FROM q WHERE i > 0 UNION ALL SELECT label, false, wf, pf FROM q WHERE i > 0),
r AS (SELECT s.k, s.label, s.made, want, per, row_number() OVER (PARTITION BY s.label, s.made ORDER BY md5('42:' || s.k), s.k) - 1 AS i FROM s JOIN w USING (label, made))
SELECT label, made AS synthetic, 'fc-c' || ((i + j) % 6) AS schema_id, count(*) AS n FROM r, range(6) AS t(j) WHERE j < per AND i * per + j < want GROUP BY ALL""",
    "m11_cached_answers": f"""WITH {_ONE} SELECT question_id, question_id = 'backed' AS cached, count(*) AS n, count(*) AS whole FROM (SELECT row_id, e.key AS question_id FROM (SELECT row_id, state, unnest(map_entries(questions)) AS e FROM o)) GROUP BY ALL""",
    "m14_calibration": BASE + """, pt AS (SELECT b.row_id, b.question_id, pn.label, pn.pos, pn.pn AS p, coalesce(gn.yn, 0) AS y FROM b JOIN pn ON pn.model = b.model AND pn.row_id = b.row_id AND pn.question_id = b.question_id
  LEFT JOIN gn ON gn.row_id = b.row_id AND gn.question_id = b.question_id AND gn.label = pn.label WHERE b.model = 'clf-small'),
gl2 AS (SELECT gn.row_id, gn.question_id, gn.label, gn.yn FROM gn JOIN b USING (row_id, question_id) WHERE b.model = 'clf-small'),
hot AS (SELECT row_id, question_id, label, v.t, pow(greatest(p, 1e-15), 1 / v.t) AS x FROM pt, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) AS v(t)),
hn AS (SELECT *, x / sum(x) OVER (PARTITION BY row_id, question_id, t) AS q FROM hot),
ce AS (SELECT t, -sum(g.yn * ln(greatest(coalesce(hn.q, 0), 1e-15))) AS ce FROM gl2 g JOIN hn USING (row_id, question_id, label) GROUP BY t),
best AS (SELECT arg_min(t, (ce, t)) AS t FROM ce),
s1 AS (SELECT round(p * 4096) / 4096 AS x, sum(y) AS y, count(*) AS n FROM pt WHERE question_id = 'verdict' AND p > 0 GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM s1), c2 AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM s2),
v2 AS (SELECT a.i AS j, z.i AS k, (z.cy - a.cy + a.y) / (z.cn - a.cn + a.n) AS v FROM c2 a JOIN c2 z ON z.i >= a.i), m2 AS (SELECT j, k, min(v) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM v2),
fit AS (SELECT x, max(m) AS y, s2.i FROM s2 JOIN m2 ON m2.k = s2.i AND m2.j <= s2.i GROUP BY ALL),
lo AS (SELECT pt.*, f.x AS x0, f.y AS y0, f.i FROM pt ASOF LEFT JOIN fit f ON pt.p >= f.x WHERE question_id = 'verdict'),
mp AS (SELECT row_id, question_id, label, pos, lo.y AS y, CASE WHEN p <= 0 THEN p WHEN x0 IS NULL THEN (SELECT arg_min(y, x) FROM fit) WHEN h.x IS NULL THEN y0 ELSE y0 + (h.y - y0) * (p - x0) / (h.x - x0) END AS q, p FROM lo LEFT JOIN (SELECT i - 1 AS i, x, y FROM fit) h USING (i)),
al AS (SELECT 'none' AS method, row_id, question_id, pos, y, p AS q FROM pt
  UNION ALL SELECT 'temperature', row_id, question_id, pos, y, pow(p, 1 / best.t) FROM pt, best
  UNION ALL SELECT 'isotonic', row_id, question_id, pos, y, CASE WHEN sum(q) OVER w > 0 THEN q ELSE (p > 0)::INT END FROM mp WINDOW w AS (PARTITION BY row_id) UNION ALL SELECT 'isotonic', row_id, question_id, pos, y, p FROM pt WHERE question_id <> 'verdict'),
an AS (SELECT *, q / sum(q) OVER w AS z FROM al WINDOW w AS (PARTITION BY method, row_id, question_id)),
tp AS (SELECT method, row_id, question_id, max(z) AS top, arg_min(y, pos) FILTER (z = mx) AS mass FROM (SELECT *, max(z) OVER (PARTITION BY method, row_id, question_id) AS mx FROM an) GROUP BY ALL)
""" + _ece("tp", "method", "top", "mass", _edges("top", True), "ece_soft"),
    "x01_event_window_stream": """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 10) AS total FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL '1 hour', any_value(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
    "m12_temperature_grid": BASE + """, hot AS (SELECT model, row_id, question_id, label, v.t, pow(greatest(pn, 1e-15), 1 / v.t) AS x FROM pn CROSS JOIN (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) AS v(t)),
hn AS (SELECT *, x / sum(x) OVER (PARTITION BY model, row_id, question_id, t) AS q FROM hot),
ce AS (SELECT t.model, t.row_id, t.question_id, hn.t, -sum(yn * ln(greatest(hn.q, 1e-15))) AS ce FROM t JOIN hn ON hn.model = t.model AND hn.row_id = t.row_id AND hn.question_id = t.question_id AND hn.label = t.label GROUP BY ALL)
SELECT model, t, round(avg(ce), 10) AS loss FROM ce GROUP BY model, t""",
    "m15_carve": f"WITH {_ONE}, {_CARVE} SELECT group_id, n FROM c",
    "m16_centroids": f"WITH {_CENTERS} SELECT * FROM a",
    "m16_centroid_eval": f"WITH {_CENTERS} SELECT gold, count(*) AS n, round(avg((gold = pred)::INT), 10) AS accuracy FROM a GROUP BY gold",
    "j06_recovered_states": f"""WITH {_ONE}, s AS (SELECT row_id, question_id, coalesce(meta->>'$.gt_row_id', row_id) AS g FROM sft_rows)
SELECT s.row_id, s.question_id, s.g AS gt_row_id, o.row_id IS NOT NULL AS found, CASE WHEN json_valid(o.state) THEN o.state->>'$.claim' END AS claim FROM s LEFT JOIN o ON o.row_id = s.g""",
    "j09_without_carve": f"""WITH {_ONE}, {_CARVE}
SELECT row_id, question_id FROM sft_rows s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.group_id = s.group_id)
AND NOT EXISTS (SELECT 1 FROM fixture x WHERE lower(trim(x.split)) = 'val' AND x.row_id = coalesce(s.meta->>'$.gt_row_id', s.row_id))""",
    "g05_straddling": """SELECT group_id AS key, string_agg(s, ',' ORDER BY s) AS splits FROM (
  SELECT DISTINCT group_id, CASE WHEN lower(trim(split)) IN ('dev', 'validation') THEN 'val' ELSE lower(trim(split)) END AS s FROM fixture WHERE group_id IS NOT NULL AND split IS NOT NULL)
GROUP BY group_id HAVING count(*) > 1""",
    "g07_prompt_alignment": f"WITH {GOLD.strip()} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM gg",
    "x01_event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 10) AS total FROM events GROUP BY ALL",
    "x02_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events))
GROUP BY user_id, k""",
}
