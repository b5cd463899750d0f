"""Queries of scalar functions, projections and text over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, text
from ..operators import chat, etl, gates, metrics, scoring
from ..plans import planning
from ..plans.runtime import table
from .building import _ONE, _one
from .metrics import GOLD, _gold, _preds, rounded

#: The SQL of states: claim and evidence lines of JSON ones, and the rendered text.
STATES = f"""{_ONE},
st AS (SELECT row_id, source, split, group_id, ord, state, CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state END AS j FROM o),
el AS (SELECT row_id, i, e, CASE json_type(e) WHEN 'OBJECT' THEN coalesce(nullif(e->>'$.title', '') || ': ', '') || coalesce(e->>'$.text', '') ELSE coalesce(e->>'$', '') END AS line
  FROM (SELECT row_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT row_id, from_json(json_extract(j, '$.evidence'), '["JSON"]') AS l FROM st WHERE json_type(j, '$.evidence') = 'ARRAY'))),
ls AS (SELECT row_id, string_agg(i || '. ' || line, chr(10) ORDER BY i) AS numbered, string_agg(line, chr(10) ORDER BY i) AS premise FROM el GROUP BY row_id),
ex AS (SELECT row_id, nullif(concat_ws(',', '"as_of":' || json_extract(j, '$.as_of')::VARCHAR,
    '"retrieval":' || ('{{"index":{{"name":' || json_extract(j, '$.retrieval.index.name')::VARCHAR || ',"shard":' || json_extract(j, '$.retrieval.index.shard')::VARCHAR || '}},"k":' || json_extract(j, '$.retrieval.k')::VARCHAR
      || ',"scores":' || regexp_replace(json_extract(j, '$.retrieval.scores')::VARCHAR, '(\\.[0-9]*[1-9])0+([],])|\\.0([],])', '\\1\\2\\3', 'g') || '}}')), '') AS more FROM st WHERE j IS NOT NULL),
tx AS (SELECT st.*, j->>'$.claim' AS claim, premise, CASE WHEN j IS NULL OR j->>'$.claim' IS NULL THEN state
    ELSE 'Claim: ' || (j->>'$.claim') || chr(10) || 'Evidence:' || chr(10) || coalesce(numbered, '(none)') || coalesce(chr(10) || '{{' || more || '}}', '') END AS text
  FROM st LEFT JOIN ls USING (row_id) LEFT JOIN ex USING (row_id))""".replace("{{", "{").replace("}}", "}")
#: Claim and passages of the rendered text, and what stays the same in another spelling.
CANON = "lower(trim(regexp_replace(translate(nfc_normalize({}), '‘’“”', '''''\"\"'), '\\s+', ' ', 'g')))".format
PARSED = """
pa AS (SELECT *, starts_with(ltrim(text), 'Claim:') AND contains(text, chr(10) || 'Evidence:') AND trim(split_part(split_part(text, chr(10) || 'Evidence:', 1), 'Claim:', 2)) <> '' AS parsed,
    trim(substr(split_part(ltrim(text), chr(10) || 'Evidence:', 1), 7)) AS c, substr(text, strpos(text, chr(10) || 'Evidence:') + 10) AS body FROM {rows}),
pi AS (SELECT {key}, list_filter(list_transform(string_split_regex(body, '\\n[ \\t]*[0-9]+\\.[ \\t]+'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '' AND x <> '(none)') AS items FROM pa WHERE parsed)""".format
#: Answers of each question, in order: (row_id, question_id, kind, instructions, i, label, definition).
OPTIONS = f"""{_ONE},
q AS (SELECT row_id, e.key AS question_id, e.value AS q FROM (SELECT row_id, unnest(map_entries(questions)) AS e FROM o)),
op AS (
  SELECT row_id, question_id, q.kind AS kind, q.instructions AS t, i, x AS label, q.criteria::JSON->>('$."' || x || '"') AS d FROM (SELECT *, unnest(json_keys(q.criteria)) AS x, generate_subscripts(json_keys(q.criteria), 1) AS i FROM q WHERE q.kind = 'choice')
  UNION ALL SELECT row_id, question_id, q.kind, q.instructions, i + 1, CAST(i AS VARCHAR), q.criteria::JSON->>('$[' || i || ']') FROM q, LATERAL (SELECT unnest(range(json_array_length(q.criteria)::BIGINT)) AS i) WHERE q.kind = 'score'
  UNION ALL SELECT row_id, question_id, q.kind, q.instructions, i, x, q.criteria::JSON->>('$.' || x) FROM q, (VALUES (1, 'yes'), (2, 'no')) AS v(i, x) WHERE q.kind = 'noul')"""
_SPACES = OPTIONS + ", sp AS (SELECT row_id, question_id, any_value(kind) AS kind, list(label ORDER BY i) AS space FROM op GROUP BY ALL)"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, question_id, q, space) of every record's questions."""
    rows = _one(spark, d, "questions").select("row_id", F.explode("questions").alias("question_id", "q"))
    return rows.withColumn("space", text.label_space(F.col("q.kind"), F.col("q.criteria")))


def _long(df: DataFrame, answer: Column, *keys: str) -> DataFrame:
    """One row for each label of an answer."""
    return rounded(df.select(*keys, F.explode(answer).alias("e")).select(*keys, "e.label", "e.p"))


def _options(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    rows = _questions(spark, d).select("row_id", "question_id", F.posexplode(text.option_texts(q["instructions"], q["kind"], q["criteria"])).alias("place", "text"))
    return rows.select("row_id", "question_id", "place", F.md5("text").alias("text"))


def _tokens(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(x.alias("label"), F.split(x, "_").alias("ids")))


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sequences of parts, each part of length n with log-probability -n / 10."""
    logps = F.transform("space", lambda x: F.struct(x.alias("label"), F.transform(F.split(x, "_"), lambda w: -F.length(w) / 10.0).alias("logps")))
    return _long(_questions(spark, d), dist.sequence_scores(logps), "row_id", "question_id")


def _modes(spark: SparkSession, d: str) -> DataFrame:
    """How labels can be read out: parts of a label as its tokens, cut to their first letter so that some collide."""
    short = F.transform("space", lambda x: F.struct(x.alias("label"), F.transform(F.split(x, "_"), lambda w: F.left(w, F.lit(1))).alias("ids")))
    rows = _questions(spark, d)
    return rows.select("row_id", "question_id", dist.readout_mode(_tokens(F.col("space"))).alias("mode"), dist.readout_mode(short).alias("short_mode"), F.array_join(dist.collisions(short), ",").alias("collisions"))


def _nli(spark: SparkSession, d: str) -> DataFrame:
    """The answers over three labels read as an entailment model's, for each question kind that has a map."""
    rows = _preds(spark, d).where(dist.is_valid(F.col("raw")) & F.array_contains(dist.labels(F.col("raw")), "supported"))
    kinds = F.explode(F.array(F.lit("choice"), F.lit("noul"))).alias("kind")
    rows = rows.select("model", "row_id", "question_id", kinds, *(dist.p_of(F.col("raw"), F.lit(x)).alias(x) for x in ("supported", "refuted", "not_enough_info")))
    return _long(rows, dist.from_nli(F.col("kind"), F.col("supported"), F.col("refuted"), F.col("not_enough_info")), "model", "row_id", "question_id", "kind")


def _no_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _questions(spark, d).where(F.array_contains("space", "no") | F.array_contains("space", "not_enough_info"))
    return rows.select("row_id", "question_id", dist.argmax(dist.without_evidence(F.col("space"))).alias("label"))


def _raw_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scorer outputs as an index (the last label) and as scores (lengths of the labels)."""
    index = dist.from_index(F.col("space"), F.size("space") - 1)
    scores = dist.from_scores(F.col("space"), F.transform("space", lambda x: F.length(x).cast("double")))
    rows = _questions(spark, d)
    both = [_long(rows.withColumn("form", F.lit(name)), answer, "row_id", "question_id", "form") for name, answer in (("index", index), ("scores", scores))]
    return both[0].unionByName(both[1])


def _soft_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_rows")
    half = F.map_filter("target_probs", lambda k, _: k != "refuted")
    return _long(rows, dist.over_space(dist.from_map(half), F.array_sort("label_space")), "row_id", "question_id")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _preds(spark, d).where("raw is not null")
    both = [_long(rows.withColumn("form", F.lit(name)), dist.candidates(F.col("raw"), flag), "model", "row_id", "question_id", "form") for name, flag in (("raw", False), ("rescaled", True))]
    return both[0].unionByName(both[1])


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    """Words of the user turn and of the answer as tokens: 40 in all, then padded to 64."""
    rows = table(spark, d, "sft_rows").select("row_id", "question_id", F.split(F.get("messages", F.lit(1))["content"], " ").alias("prompt"), F.split("label", "_").alias("completion"))
    rows = rows.withColumn("ids", dist.truncated(F.col("prompt"), F.col("completion"), 40))
    padded = dist.left_padded(F.transform("ids", lambda x: F.length(x)), F.lit(64), 0)
    rows = rows.select("row_id", "question_id", F.size("ids").alias("kept"), F.element_at("ids", -1).alias("last"), padded.alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return rows.select("row_id", "question_id", "kept", "last", F.size("p.ids").alias("length"), total(F.col("p.mask")).alias("mask"), total(F.col("p.positions")).alias("positions"))


def _rubrics(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    rows = _questions(spark, d).withColumn("levels", text.rubric(text.question_text(q["instructions"], q["kind"], q["criteria"])))
    return rows.select("row_id", "question_id", F.coalesce(F.array_join("levels", "|"), F.lit("-")).alias("levels"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("doc_id is not null and text is not null")
    picked = text.selected_sentences(F.split("text", r"\. "), F.array(F.lit(2), F.lit(0), F.lit(2), F.lit(-1), F.lit(99999)))
    return rows.select("doc_id", F.md5(picked).alias("text")).distinct()


def _arm_names(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import arms

    files = table(spark, d, "predictions").select(F.concat(F.lit("runs/v2.1/preds_"), "model", F.lit(".jsonl")).alias("file"))
    return arms(files)


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """Words of the rendered prompts, by source."""
    rows = table(spark, d, "sft_rows").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("?")))
    words = F.size(F.filter(F.split(F.array_join(F.transform("messages", lambda m: m["content"]), " "), r"\s+"), lambda w: w != ""))
    return rounded(metrics.length_stats(rows, ["source"], words, 200))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "state").where(F.get_json_object("state", "$.claim").isNotNull())
    found = etl.claim_evidence(rows)
    return found.select("row_id", F.md5("claim").alias("claim"), F.size("texts").alias("texts"), F.md5(F.array_join("texts", "\n")).alias("joined"))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return etl.selected(table(spark, d, "fixture"), split=["val", "dev", "validation"], source=["fever", "scifact"], label_source="ground_truth").select("row_id", "ord")


def _keys(spark: SparkSession, d: str, key: Column) -> DataFrame:
    """Records by an identity key: the size of each class, without the key itself."""
    rows = _one(spark, d, "state").select("row_id", key.alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id")).where("n > 1").select("row_id", "n")


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    """Noul targets with the keys true and false, renamed to yes and no."""
    rows = _gold(spark, d).where("question_id = 'backed'").select("row_id", F.map_from_entries(F.transform("target", lambda e: F.struct(F.when(e["label"] == "yes", "true").otherwise("false").alias("k"), e["p"].alias("v")))).alias("m"))
    return rounded(rows.select("row_id", F.explode(text.noul_keys(F.col("m"))).alias("label", "p")))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = gates.state_signatures(_one(spark, d, "state"), F.col("state"))
    return rows.where("parsed").groupBy("set_sig").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sig").alias("orders"), F.min("row_id").alias("row_id")).where("n > 1").drop("set_sig")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.parsed_prompts(table(spark, d, "sft_rows"))
    return rows.select("row_id", "question_id", "claim", F.coalesce(F.size("evidence"), F.lit(-1)).alias("passages"), F.md5(F.array_join("evidence", "|")).alias("evidence"))


def _passes(spark: SparkSession, d: str) -> DataFrame:
    """Model passes by readout mode: one a question if the labels' first parts differ, else one a label."""
    found = scoring.passes(_questions(spark, d).select("row_id", "question_id", F.col("space").alias("labels")))
    return found.groupBy("question_id", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("passes").alias("passes"))


def _sorted_labels(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("row_id", "question_id", F.array_join(F.array_sort(dist.labels(F.col("target"))), ",").alias("labels"), F.array_max(dist.labels(F.col("target"))).alias("last"))


def _stops(spark: SparkSession, d: str) -> DataFrame:
    """The values of each user's events, in order, as a history of losses."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("h"))
    return rows.select("user_id", planning.stopping_epoch(F.transform("h", lambda e: e["value"]), 3).alias("stop"))


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    rows = planning.numbered(_one(spark, d)).select("row_id", F.posexplode(planning.cycle(F.col("i"), 9, 4)).alias("turn", "arm"))
    return rows.select("row_id", "turn", "arm")


def _one_hot(spark: SparkSession, d: str) -> DataFrame:
    rows = _gold(spark, d).withColumn("hot", dist.one_hot(dist.labels(F.col("target")), F.col("gold")))
    out = _long(rows.withColumn("given", dist.is_one_hot(F.col("target"))), F.col("hot"), "row_id", "question_id", "given")
    return out


QUERIES = {
    "p05_premise": lambda s, d: _one(s, d, "state").where(F.get_json_object("state", "$.claim").isNotNull()).select("row_id", F.md5(text.premise(F.col("state"))).alias("premise")),
    "p06_option_texts": _options,
    "p10_claim_evidence": _claims,
    "p11_selected": _selected,
    "p12_without_test": lambda s, d: gates.without_test(table(s, d, "fixture").where("row_id is not null")).select("row_id", "ord"),
    "p14_one_hot": _one_hot,
    "p23_state_keys": lambda s, d: _keys(s, d, text.state_key(F.col("state"))),
    "p24_cache_keys": lambda s, d: _keys(s, d, text.cache_key(F.lit("m"), F.col("state"), F.lit("{}"))),
    "p25_noul_keys": _renamed,
    "r03_signatures": _signatures,
    "r05_parse_prompts": _parsed,
    "r07_rubrics": _rubrics,
    "r08_sentences": _sentences,
    "r09_arm_names": _arm_names,
    "r10_lengths": _lengths,
    "f06_sequence_scores": _sequence,
    "f07_readout_modes": _modes,
    "f13_nli": _nli,
    "f14_no_evidence": _no_evidence,
    "f15_raw_scores": _raw_scores,
    "f18_soft_targets": _soft_targets,
    "f20_candidates": _candidates,
    "f21_truncated_padded": _truncated,
    "m17_passes": _passes,
    "o01_sorted_labels": _sorted_labels,
    "w05_cycles": _cycles,
    "w11_stops": _stops,
}

_PRED_LABELS = """
pr AS (SELECT * FROM predictions WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id, question_id, model ORDER BY ord DESC) = 1),
pl AS (SELECT row_id, question_id, model, pos, e.key AS label, e.value AS p FROM (SELECT *, unnest(m) AS e, generate_subscripts(m, 1) AS pos FROM (SELECT *, map_entries(probs) AS m FROM pr)))"""
_CLASSES = f"""WITH {STATES},
tree AS (SELECT row_id, string_agg(fullkey || '=' || coalesce(atom::VARCHAR, type), chr(1) ORDER BY fullkey) AS key FROM st, json_tree(st.j) WHERE j IS NOT NULL GROUP BY row_id
  UNION ALL SELECT row_id, state FROM st WHERE j IS NULL)
SELECT min(row_id) AS row_id, count(*) AS n FROM tree GROUP BY key HAVING count(*) > 1"""
SQL = {
    "p05_state_text": f"WITH {STATES} SELECT row_id, sha256(text) AS text FROM tx",
    "p05_premise": f"WITH {STATES} SELECT row_id, md5(coalesce(premise, '')) AS premise FROM tx WHERE claim IS NOT NULL",
    "p06_option_texts": f"WITH {OPTIONS} SELECT row_id, question_id, CAST(i - 1 AS INTEGER) AS place, md5(trim(t) || chr(10) || label || coalesce(': ' || nullif(d, ''), '')) AS text FROM op",
    "p10_claim_evidence": f"""WITH {STATES}, tt AS (SELECT row_id, CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.text' WHEN 'VARCHAR' THEN e->>'$' END AS t, i FROM el)
SELECT tx.row_id, md5(claim) AS claim, CAST(coalesce(n, 0) AS INTEGER) AS texts, md5(coalesce(t, '')) AS joined FROM tx
LEFT JOIN (SELECT row_id, count(*) AS n, string_agg(t, chr(10) ORDER BY i) AS t FROM tt WHERE t IS NOT NULL GROUP BY row_id) USING (row_id) WHERE claim IS NOT NULL""",
    "p11_selected": "SELECT row_id, ord FROM fixture WHERE lower(trim(split)) IN ('val', 'dev', 'validation') AND lower(trim(source)) IN ('fever', 'scifact') AND lower(trim(label_source)) = 'ground_truth'",
    "p12_without_test": "SELECT row_id, ord FROM fixture WHERE row_id IS NOT NULL AND coalesce(lower(trim(split)), '') <> 'test'",
    "p14_one_hot": f"""WITH {GOLD.strip()} SELECT row_id, question_id, n = 1 AND top = 1 AS given, label, (label = gold)::INT::DOUBLE AS p
FROM gn JOIN gg USING (row_id, question_id) JOIN (SELECT row_id, question_id, count(*) FILTER (yn = 1) AS n, max(yn) AS top FROM gn GROUP BY ALL) USING (row_id, question_id)""",
    "p23_state_keys": _CLASSES,
    "p24_cache_keys": _CLASSES,
    "p25_noul_keys": f"WITH {GOLD.strip()} SELECT row_id, label, round(yn, 10) AS p FROM gn WHERE question_id = 'backed'",
    "r03_signatures": f"""WITH {STATES}, {PARSED(rows='tx', key='row_id').strip()},
k AS (SELECT row_id, {CANON('c')} AS c, list_transform(items, lambda x: {CANON('x')}) AS l FROM pi JOIN pa USING (row_id))
SELECT min(row_id) AS row_id, count(*) AS n, count(DISTINCT l) AS orders FROM k GROUP BY c, list_sort(l) HAVING count(*) > 1""",
    "r05_parse_prompts": f"""WITH u AS (SELECT row_id, question_id, list_filter(messages, lambda m: m.role = 'user')[1].content AS u FROM sft_rows),
t AS (SELECT row_id, question_id, CASE WHEN contains(u, chr(10) || 'State:' || chr(10)) THEN substr(u, strpos(u, chr(10) || 'State:' || chr(10)) + 8) END AS text FROM u), {PARSED(rows='t', key='row_id, question_id').strip()}
SELECT row_id, question_id, CASE WHEN parsed THEN c END AS claim, CAST(coalesce(len(items), -1) AS INTEGER) AS passages, md5(array_to_string(items, '|')) AS evidence FROM pa LEFT JOIN pi USING (row_id, question_id)""",
    "r07_rubrics": f"""WITH {OPTIONS}
SELECT row_id, question_id, CASE WHEN min(kind) = 'score' THEN string_agg(d, '|' ORDER BY i) ELSE '-' END AS levels FROM op GROUP BY ALL""",
    "r08_sentences": r"""SELECT DISTINCT doc_id, md5(array_to_string(list_filter([s[1], s[3]], lambda x: x IS NOT NULL), ' ')) AS text FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)""",
    "r09_arm_names": "SELECT DISTINCT model AS arm, 'runs/v2.1/preds_' || model || '.jsonl' AS file FROM predictions",
    "r10_lengths": r"""WITH w AS (SELECT coalesce(lower(trim(source)), '?') AS source, len(list_filter(string_split_regex(array_to_string(list_transform(messages, lambda m: m.content), ' '), '\s+'), lambda x: x <> '')) AS l FROM sft_rows)
SELECT source, count(*) AS n, round(avg(l), 10) AS mean, quantile_disc(l, 0.5) AS p50, quantile_disc(l, 0.95) AS p95, max(l) AS most, count(*) FILTER (l > 200) AS over FROM w GROUP BY source""".replace(" AS over ", ' AS "over" '),
    "f06_sequence_scores": f"""WITH {OPTIONS}, x AS (SELECT row_id, question_id, label, exp(-length(replace(label, '_', '')) / 10.0::DOUBLE) AS x FROM op)
SELECT row_id, question_id, label, round(x / sum(x) OVER (PARTITION BY row_id, question_id), 10) AS p FROM x""",
    "f07_readout_modes": f"""WITH {OPTIONS}, x AS (SELECT row_id, question_id, split_part(label, '_', 1) AS f, left(label, 1) AS g, count(*) OVER (PARTITION BY row_id, question_id, left(label, 1)) AS k FROM op)
SELECT row_id, question_id, CASE WHEN count(DISTINCT f) = count(*) THEN 'first_token' ELSE 'sequence' END AS mode, CASE WHEN count(DISTINCT g) = count(*) THEN 'first_token' ELSE 'sequence' END AS short_mode,
coalesce(string_agg(DISTINCT g, ',' ORDER BY g) FILTER (k > 1), '') AS collisions FROM x GROUP BY ALL""",
    "f13_nli": f"""WITH {_PRED_LABELS.strip()},
g AS (SELECT model, row_id, question_id, sum(p) FILTER (label = 'supported') AS e, coalesce(sum(p) FILTER (label = 'refuted'), 0) AS c, coalesce(sum(p) FILTER (label = 'not_enough_info'), 0) AS n
  FROM pl GROUP BY ALL HAVING count(*) FILTER (p IS NULL OR isnan(p) OR isinf(p) OR p < 0) = 0 AND sum(p) > 0 AND count(*) FILTER (label = 'supported') > 0)
SELECT model, row_id, question_id, 'choice' AS kind, v.label, round(v.p, 10) AS p FROM g, LATERAL (VALUES ('supported', e), ('refuted', c), ('not_enough_info', n)) AS v(label, p)
UNION ALL SELECT model, row_id, question_id, 'noul', v.label, round(v.p, 10) FROM g, LATERAL (VALUES ('yes', e), ('no', c + n)) AS v(label, p)""",
    "f14_no_evidence": f"WITH {_SPACES} SELECT row_id, question_id, CASE WHEN list_contains(space, 'not_enough_info') THEN 'not_enough_info' ELSE 'no' END AS label FROM sp WHERE list_contains(space, 'not_enough_info') OR list_contains(space, 'no')",
    "f15_raw_scores": f"""WITH {OPTIONS}
SELECT row_id, question_id, 'index' AS form, label, (i = max(i) OVER w)::INT::DOUBLE AS p FROM op WINDOW w AS (PARTITION BY row_id, question_id)
UNION ALL SELECT row_id, question_id, 'scores', label, round(length(label) / sum(length(label)) OVER (PARTITION BY row_id, question_id), 10) FROM op""",
    "f18_soft_targets": """WITH t AS (SELECT row_id, question_id, x AS label, CASE WHEN x <> 'refuted' THEN coalesce(target_probs[x], 0) ELSE 0 END AS p FROM (SELECT *, unnest(label_space) AS x FROM sft_rows)),
s AS (SELECT *, sum(p) OVER (PARTITION BY row_id, question_id) AS s FROM t) SELECT row_id, question_id, label, round(p / s, 10) AS p FROM s WHERE s > 0""",
    "f20_candidates": f"""WITH {_PRED_LABELS.strip()}, k AS (SELECT *, CASE WHEN p IS NULL OR isnan(p) OR p < 0 THEN 0 ELSE p END AS q FROM pl),
s AS (SELECT *, sum(q) OVER w AS s, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY row_id, question_id, model))
SELECT model, row_id, question_id, v.form, label, round(CASE WHEN s <= 0 THEN 1.0::DOUBLE / n WHEN v.form = 'raw' THEN q ELSE q / s END, 10) AS p FROM s, (VALUES ('raw'), ('rescaled')) AS v(form)""",
    "f21_truncated_padded": """WITH t AS (SELECT row_id, question_id, len(string_split(messages[2].content, ' ')) AS n, string_split(label, '_') AS c FROM sft_rows),
k AS (SELECT row_id, question_id, CAST(least(n, greatest(40 - len(c), 0)) + len(c) AS INTEGER) AS kept, c[-1] AS last FROM t)
SELECT row_id, question_id, kept, last, CAST(64 AS INTEGER) AS length, kept AS mask, CAST(kept * (kept - 1) / 2 AS INTEGER) AS positions FROM k""",
    "m17_passes": f"""WITH {OPTIONS}, x AS (SELECT row_id, question_id, count(*) AS l, count(DISTINCT split_part(label, '_', 1)) = count(*) AS plain FROM op GROUP BY ALL)
SELECT question_id, CASE WHEN plain THEN 'first_token' ELSE 'sequence' END AS mode, count(*) AS n, CAST(sum(CASE WHEN plain THEN 1 ELSE l END) AS BIGINT) AS passes FROM x GROUP BY ALL""",
    "o01_sorted_labels": f"WITH {GOLD.strip()} SELECT row_id, question_id, string_agg(label, ',' ORDER BY label) AS labels, max(label) AS last FROM gn GROUP BY ALL",
    "w05_cycles": f"WITH {_ONE} SELECT row_id, CAST(t AS INTEGER) AS turn, CAST((i + t) % 9 AS INTEGER) AS arm FROM (SELECT row_id, row_number() OVER (ORDER BY ord) - 1 AS i FROM o), range(4) AS r(t)",
    "w11_stops": """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
f AS (SELECT user_id, -1::BIGINT AS k, 'infinity'::DOUBLE AS best, 0 AS waited FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT f.user_id, e.k, CASE WHEN e.value < best - 1e-4::DOUBLE THEN e.value ELSE best END, CASE WHEN e.value < best - 1e-4::DOUBLE THEN 0 ELSE waited + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, CAST(min(k) FILTER (waited >= 3) AS INTEGER) AS stop FROM f GROUP BY user_id""",
}
