"""Queries of sources and sinks, loaders, joins of states and wordings, gates and plans, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, text
from ..operators import chat, etl, gates, pairing, puzzles, scoring
from ..plans import planning, synthesis
from ..plans.runtime import materialize, scratch_path, table
from ..sources import datasets, jsonl
from .building import _CARVE, _ONE, _one
from .functions import OPTIONS, PARSED, CANON, STATES
from .metrics import GOLD, PRED, _gold, _preds, rounded

VAL = ("val", "validation", "dev")


def _json(spark: SparkSession, d: str) -> DataFrame:
    """First deliveries with a JSON state, and what the published forms are made of: claim, first title and text, native label."""
    rows = _one(spark, d, "source", "split", "group_id", "state", "meta").where(F.get_json_object("state", "$.claim").isNotNull())
    get = lambda c, p: F.get_json_object(c, p)
    return rows.select(
        "row_id", "ord", F.lower(F.trim("source")).alias("source"), F.lower(F.trim("split")).alias("split"), "group_id", get("state", "$.claim").alias("claim"),
        get("state", "$.evidence[0].title").alias("title"), get("state", "$.evidence[0].text").alias("body"), get("meta", "$.label").alias("native"), get("meta", "$.revision_type").alias("revision_type"), "state",
    )


def _shown(rows: DataFrame) -> DataFrame:
    """Decision rows of a loader, flat."""
    label = dist.argmax(dist.from_map(F.try_element_at("labels", F.lit("verdict"))))
    item = lambda p: F.get_json_object("state", p)
    return rows.select(
        "row_id", "source", "split", "group_id", label.alias("label"), item("$.claim").alias("claim"), item("$.evidence[0].title").alias("title"), F.md5(item("$.evidence[0].text")).alias("body"), "weight", "label_source", F.get_json_object("meta", "$.original_label").alias("native")
    )


def _fever_raw(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).where("source = 'fever' and body is not null").select(F.col("claim").alias("premise"), F.col("body").alias("hypothesis"), F.col("native").alias("fever_gold_label"), F.col("row_id").alias("fid"), F.col("group_id").alias("cid"), "split")


def _fever(spark: SparkSession, d: str) -> DataFrame:
    return _shown(datasets.fever(_fever_raw(spark, d), table(spark, d, "label_map")))


def _vitaminc_raw(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).where("source = 'vitaminc' and body is not null").select("claim", F.col("body").alias("evidence"), F.col("title").alias("page"), F.col("native").alias("label"), F.col("row_id").alias("unique_id"), F.col("group_id").alias("case_id"), "revision_type", "split")


def _vitaminc(spark: SparkSession, d: str) -> DataFrame:
    return _shown(datasets.vitaminc(_vitaminc_raw(spark, d), table(spark, d, "label_map")))


def _scifact_raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims of the numbered records of one source, each with a document of its own: supported and refuted ones with rationales (0, 2, 0, 99), others cite it and one that isn't there."""
    rows = _json(spark, d).where("source = 'scifact' and body is not null")
    corpus = rows.select(F.col("ord").alias("doc_id"), "title", F.split("body", r"\. ").alias("abstract"))
    entry = F.array(F.struct(F.array(F.lit(0), F.lit(2), F.lit(0), F.lit(99)).alias("sentences"), F.col("native").alias("label")))
    none = F.create_map().cast("map<string,array<struct<sentences:array<int>,label:string>>>")
    evidence = F.when(F.col("native") == "NOINFO", none).otherwise(F.create_map(F.col("ord").cast("string"), entry))
    claims = rows.select(F.col("ord").alias("id"), "claim", evidence.alias("evidence"), F.array(F.col("ord") + 10_000_000, F.col("ord")).alias("cited_doc_ids"), "split")
    return claims, corpus


def _scifact(spark: SparkSession, d: str) -> DataFrame:
    return _shown(datasets.scifact(*_scifact_raw(spark, d), table(spark, d, "label_map")))


def _climate_raw(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth claim is disputed."""
    rows = _json(spark, d).where("source = 'climate_fever' and body is not null")
    index = F.when(F.col("ord") % 5 == 0, 3).otherwise(F.array_position(F.array(*(F.lit(x) for x in datasets.CLIMATE)), F.upper(F.trim("native"))) - 1)
    passages = F.array(F.struct(F.col("title").alias("article"), F.col("body").alias("evidence")))
    return rows.select(F.col("ord").alias("claim_id"), "claim", index.alias("claim_label"), passages.alias("evidences"))


def _climate(spark: SparkSession, d: str) -> DataFrame:
    return _shown(datasets.climate_fever(_climate_raw(spark, d), table(spark, d, "label_map")))


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """All four forms as one table: rows by source, label and split, in the order of the sources."""
    rows = datasets.load(spark, {"fever": (_fever_raw(spark, d),), "vitaminc": (_vitaminc_raw(spark, d),), "scifact": _scifact_raw(spark, d), "climate_fever": (_climate_raw(spark, d),)}, table(spark, d, "label_map"))
    rows = rows.withColumn("place", F.shiftright("ord", 56))
    label = dist.argmax(dist.from_map(F.try_element_at("labels", F.lit("verdict"))))
    return rows.groupBy("place", "source", "split", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as JSON lines and read again, strictly; not finite numbers have no JSON form and are left out."""
    path = scratch_path(spark, "predictions")
    rows = table(spark, d, "predictions").where("row_id is not null and probs is not null").where(~F.exists(F.map_values("probs"), lambda p: F.coalesce(F.isnan(p), F.lit(True))) & ~F.coalesce(F.isnan("confidence"), F.lit(False)))
    jsonl.write_predictions(rows, path)
    back = jsonl.read_predictions(spark, path)
    return rounded(back.select("row_id", "question_id", "model", "confidence", "latency_ms", dist.total(dist.from_map(F.col("probs"))).alias("mass"), "meta"))


def _appended(spark: SparkSession, d: str) -> DataFrame:
    """Train rows, then val and test rows appended, beside a path that isn't there; read as one."""
    path, other = scratch_path(spark, "rows"), scratch_path(spark, "none")
    rows, s = table(spark, d, "fixture"), F.lower(F.trim("split"))
    jsonl.write_rows(rows.where(s == "train"), path)
    jsonl.append_rows(rows.where(s.isin(*VAL, "test")), path)
    return jsonl.read_rows(spark, [path, other], missing_ok=True).groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.count_distinct("ord").alias("places"))


def _numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cache lines written one file a tenth: every line that isn't blank has its file, its number in it and its place in all of them."""
    path = scratch_path(spark, "lines")
    rows = table(spark, d, "cache_lines").select("ord", F.concat(F.lit("part"), (F.col("ord") % 10).cast("string")).alias("part"), F.regexp_replace("line", r"[\r\n]", " ").alias("line"))
    for k in range(10):  # ten files, whatever the rows
        rows.where(F.col("part") == f"part{k}").repartitionByRange(1, "ord").sortWithinPartitions("ord").select("line").write.text(f"{path}/part{k}")
    found = jsonl.lines(spark, [f"{path}/part{k}" for k in range(10)])
    return found.select(F.col("ord").alias("place"), F.col("line").alias("number"), F.md5("value").alias("value"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in one file a model: a report over the files of a glob."""
    path = scratch_path(spark, "preds")
    rows = table(spark, d, "predictions").where("row_id is not null and model is not null")
    rows.select(F.to_json(F.struct("row_id", "question_id", "model")).alias("value"), F.concat(F.lit("preds_"), "model").alias("arm")).write.partitionBy("arm").text(path)
    found = jsonl.lines(spark, f"{path}/*/*")
    return found.groupBy(F.get_json_object("value", "$.model").alias("arm")).agg(F.count(F.lit(1)).alias("lines"))


def _unscored(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.unscored(_one(spark, d, "split").where(F.lower(F.trim("split")).isin(*VAL, "test")), table(spark, d, "predictions"), "clf-small").select("row_id")


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """A scoring run that stopped after a part of the rows and was started again: every row is scored once."""
    rows = _one(spark, d, "split").where(F.lower(F.trim("split")).isin(*VAL, "test")).select("row_id", "ord")
    path = scratch_path(spark, "resume")

    def score(part: DataFrame) -> DataFrame:
        probs = F.create_map(F.lit("yes"), F.lit(0.25), F.lit("no"), F.lit(0.75))
        return part.select("row_id", F.lit("q").alias("question_id"), probs.alias("probs"), F.lit(0.75).alias("confidence"), F.lit("stub").alias("model"), F.lit(1.0).alias("latency_ms"), F.lit("{}").alias("meta"))

    jsonl.scored_resumable(rows.where("ord % 3 = 0"), path, "stub", score, 400)
    jsonl.scored_resumable(rows, path, "stub", score, 400)
    return jsonl.read_predictions(spark, path).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))


SCHEMAS = [("fc-c0", "train"), ("fc-c1", "train"), ("fc-c6", "val"), ("fc-c7", "test"), ("fc-n3", "val"), ("fc-n4", "test")]
EXTRA = [("x1", "noul", "Is it backed?", None), ("x2", "score", "How strongly?", '["no", "part", "all"]'), ("x3", "choice", "Which?", '{"a": null, "b": "B"}')]


def _eval_plan(spark: SparkSession, d: str) -> DataFrame:
    """Held-out states with each wording of their split."""
    s = F.lower(F.trim("split"))
    states = _one(spark, d, "split").select("row_id", F.when(s.isin(*VAL), "val").otherwise(s).alias("split")).where("split in ('val', 'test')")
    return planning.eval_plan(states, spark.createDataFrame(SCHEMAS, "schema_id string, split string"))


def _multi(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.multi_question(_one(spark, d), spark.createDataFrame(EXTRA, "schema_id string, kind string, instructions string, criteria string"))
    return rows.select("row_id", "schema_id", F.array_join(text.label_space(F.col("kind"), F.col("criteria")), ",").alias("labels"))


def _joined_back(spark: SparkSession, d: str) -> DataFrame:
    """A menu scorer that prefers the longest option."""
    rows = chat.option_rows(_one(spark, d, "group_id", "split", "state", "questions", "labels").where("size(questions) = 1"))
    answers = rows.select("row_id", dist.from_scores(F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: i.cast("string")), F.transform("options", lambda o: F.length(o).cast("double"))).alias("answer"))
    return pairing.joined_back(rows, answers).select("row_id", "label", "pred", "ok")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of odd place take the labels of a model where it has some."""
    teacher = _preds(spark, d).where("model = 'clf-large' and question_id = 'verdict'").where(dist.is_valid(F.col("raw")))
    teacher = teacher.select("row_id", F.create_map(F.lit("verdict"), F.map_from_entries(F.transform(dist.normalize(F.col("raw")), lambda e: F.struct(e["label"].alias("k"), e["p"].alias("v"))))).alias("labels"))
    out = synthesis.mixed_labels(_one(spark, d, "labels", "label_source"), teacher)
    return rounded(out.where("labels['verdict'] is not null").select("row_id", "label_source", F.explode(F.col("labels")["verdict"]).alias("label", "p")))


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Chat records to train on without the carved groups and the val records."""
    rows = table(spark, d, "sft_rows").where("lower(trim(split)) = 'train'")
    carved = etl.carve(_one(spark, d, "group_id")), table(spark, d, "fixture").where("lower(trim(split)) = 'val'")
    return gates.training_rows(rows, carved=carved).select("row_id", "question_id")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    return table(spark, d, "sft_rows").select("row_id", "split", user.alias("user"), "group_id", F.get_json_object("meta", "$.gt_row_id").alias("gt_row_id"))


def _gate(spark: SparkSession, d: str) -> DataFrame:
    """The sources as assets, one of which isn't there."""
    protected = _one(spark, d, "split", "state", "group_id", "source").withColumn("asset", F.lower(F.trim("source")))
    return gates.train_eval_gate(_pool(spark, d), protected, ("fever", "vitaminc", "no_such"))


def _audit_gate(spark: SparkSession, d: str) -> DataFrame:
    """All questions and models, as they come: what an audit would stop at."""
    gold = _gold(spark, d, "split").where(F.lower(F.trim("split")).isin(*VAL, "test"))
    parts = [gates.audit_input_gate(gold, _preds(spark, d).where(F.col("model") == m)).withColumn("model", F.lit(m)) for m in ("clf-large", "clf-small", "lex-base")]
    return functools.reduce(DataFrame.unionByName, parts)


def _chat_gate(spark: SparkSession, d: str) -> DataFrame:
    """Two wordings are held out, and the evaluation uses one wording with every source of another."""
    rows = table(spark, d, "sft_rows")
    ids = table(spark, d, "fixture").where(F.lower(F.trim("split")).isin(*VAL, "test"))
    return gates.chat_gate(rows, ids.select("row_id"), rows.where("schema_id = 'fc-c2' and source is not null").select("source", F.lit("fc-c3").alias("schema_id")), ["fc-c7", "fc-c6"])


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.count_gate(_one(spark, d, "split"), F.lower(F.trim("split")), {"train": 2500, "val": 0, "test": 290, "none": 1})


def _plan_gate(spark: SparkSession, d: str) -> DataFrame:
    """Answers of one model as a plan: wordings by place, some not allowed, some states of the evaluation."""
    rows = _preds(spark, d).where("model = 'clf-large' and question_id = 'verdict'").where(dist.is_valid(F.col("raw")))
    plan = rows.select(F.col("row_id").alias("state_key"), F.concat(F.lit("fc-c"), (F.col("ord") % 5).cast("string")).alias("schema_id"), F.col("raw").alias("target"))
    s = F.lower(F.trim("split"))
    held = _one(spark, d, "split").where(s == "test").select(F.col("row_id").alias("state_key"))
    return gates.plan_gate(plan, ["fc-c0", "fc-c1", "fc-c2", "fc-c3"], held.withColumn("schema_id", F.lit("fc-c1")), held, (0.3, 0.5), 2.5e-6)


def _shared_sets(spark: SparkSession, d: str) -> DataFrame:
    """Evidence sets of train and evaluation rows that are shared in another order, or as they are."""
    rows = gates.state_signatures(_one(spark, d, "split", "state"), F.col("state")).where("parsed").select("sig", "set_sig", F.lower(F.trim("split")).alias("s"))
    rows = materialize(rows, "signatures")  # rendered and hashed once
    one, two = rows.where("s = 'train'"), rows.where(F.col("s").isin(*VAL, "test"))
    both = lambda c: one.select(c).intersect(two.select(c))
    exact = both("sig")
    other = both("set_sig").subtract(rows.join(exact, "sig", "left_semi").select("set_sig"))
    return exact.agg(F.lit("same").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(other.agg(F.lit("reordered").alias("kind"), F.count(F.lit(1)).alias("n")))


def _union(spark: SparkSession, d: str) -> DataFrame:
    """Decision rows and chat records as one list of ids."""
    rows = table(spark, d, "fixture").select("row_id", F.lit("fixture").alias("of")).unionByName(table(spark, d, "sft_rows").select("row_id", F.lit("sft_rows").alias("of")))
    return rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"))


def _schema_split(spark: SparkSession, d: str) -> DataFrame:
    """The wordings of the chat records, kinds by their number."""
    ids = [r.schema_id for r in table(spark, d, "sft_rows").select("schema_id").where("schema_id is not null").distinct().orderBy("schema_id").limit(1000).collect()]  # a dimension
    found = planning.schema_splits([(x, "noul" if k % 2 else "choice") for k, x in enumerate(ids)])
    return spark.createDataFrame(sorted(found.items()), "schema_id string, split string")


def _retried(spark: SparkSession, d: str) -> DataFrame:
    """A scorer that fails at the first try of every batch."""
    requests = scoring.requests(_one(spark, d, "state", "questions")).where("question_id = 'verdict'")

    def make():
        tries: dict = {}

        def flaky(batches):
            batch = next(iter(batches))
            key = batch["row_id"].iloc[0]
            tries[key] = tries.get(key, 0) + 1
            if tries[key] == 1:
                raise OSError("not yet")
            yield from scoring.lexical_scorer(iter([batch]))

        return flaky

    answers = scoring.score(requests, scoring.with_retries(make(), first=0.0))
    return rounded(answers.select("row_id", F.explode("answer").alias("e")).select("row_id", "e.label", "e.p"))


def _throughput(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.throughput(scoring.requests(_one(spark, d, "state", "questions")), scoring.lexical_scorer)
    return spark.createDataFrame([(found["n"], found["seconds"] > 0, found["per_second"] > 0)], "n bigint, took boolean, rate boolean")


def _boards(spark: SparkSession, d: str) -> DataFrame:
    """A board for each evaluation text, made from its id."""
    cell = F.sequence(F.lit(0), F.lit(80))
    value = lambda k: (F.floor(k / 9) * 3 + F.floor(k / 27) + k % 9 + F.col("item_id")) % 9 + 1
    hide = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), k.cast("string"))), 1, 2), 16, 10).cast("int") < 150
    rows = table(spark, d, "eval_items").where("item_id is not null").select("item_id").distinct()
    return rows.select(F.col("item_id").alias("puzzle_id"), F.array_join(F.transform(cell, lambda k: F.when(hide(k), ".").otherwise(value(k).cast("string"))), "").alias("board"))


def _candidates_of(spark: SparkSession, d: str) -> DataFrame:
    return puzzles.candidates(puzzles.cells(_boards(spark, d)))


def _singles(spark: SparkSession, d: str) -> DataFrame:
    options = _candidates_of(spark, d)
    found = puzzles.naked_singles(options).withColumn("rule", F.lit("naked")).unionByName(puzzles.hidden_singles(options).withColumn("rule", F.lit("hidden")))
    return found.select("puzzle_id", F.col("cell").cast("int").alias("cell"), F.col("value").cast("int").alias("value"), "rule")


def _search_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates weighed by a hash of their cell and digit."""
    p = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("puzzle_id").cast("string"), F.col("cell").cast("string"), F.col("value").cast("string"))), 1, 2), 16, 10).cast("int") / 256
    rows = _candidates_of(spark, d).where("value is not null").withColumn("p", p)
    return puzzles_order(planning.search_order(rows, 0.5))


def puzzles_order(rows: DataFrame) -> DataFrame:
    return rows.select("puzzle_id", F.col("cell").cast("int").alias("cell"), F.col("value").cast("int").alias("value"), "turn")


def _solved(spark: SparkSession, d: str) -> DataFrame:
    """Whether each solution keeps the given cells and has every digit once in each row, column and box."""
    out = puzzles.solved(_boards(spark, d))
    long = out.select("puzzle_id", "board", "solution", F.posexplode(F.split("solution", "")).alias("cell", "v")).where("cell < 81")
    kept = F.substring("board", F.col("cell") + 1, F.lit(1))
    long = long.withColumn("fits", kept.isin(".", "0") | (kept == F.col("v"))).withColumn("unit", F.explode(F.array(*puzzles.units(F.col("cell")))))
    units = long.groupBy("puzzle_id", "unit").agg(F.count_distinct("v").alias("digits"), F.min(F.col("fits").cast("int")).alias("fits"))
    return units.groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("units"), F.min("digits").alias("digits"), F.min("fits").alias("fits"))


QUERIES = {
    "s02_predictions_round_trip": _predictions,
    "s04_appended_rows": _appended,
    "s05_numbered_lines": _numbered_lines,
    "s08_fever": _fever,
    "s09_vitaminc": _vitaminc,
    "s10_scifact": _scifact,
    "s11_climate_fever": _climate,
    "s12_sources": _loaded,
    "s18_resumed": _resumed,
    "s19_files": _files,
    "p19_training_rows": _training,
    "j08_unscored": _unscored,
    "j10_eval_plan": _eval_plan,
    "j11_multi_question": _multi,
    "j12_joined_back": _joined_back,
    "j13_mixed_labels": _mixed,
    "g01_train_eval_gate": _gate,
    "g02_audit_gate": _audit_gate,
    "g03_chat_gate": _chat_gate,
    "g04_plan_gate": _plan_gate,
    "g06_counts": _counts,
    "u01_union": _union,
    "u02_shared_sets": _shared_sets,
    "m05_schema_split": _schema_split,
    "m10_retries": _retried,
    "a29_throughput": _throughput,
    "r11_cells": lambda s, d: puzzles.cells(_boards(s, d)).select("puzzle_id", F.col("cell").cast("int").alias("cell"), "value"),
    "j16_candidates": lambda s, d: _candidates_of(s, d).select("puzzle_id", F.col("cell").cast("int").alias("cell"), F.col("value").cast("int").alias("value")),
    "m19_singles": _singles,
    "m19_solved": _solved,
    "o06_fewest": lambda s, d: puzzles.fewest(_candidates_of(s, d)).select("puzzle_id", F.col("cell").cast("int").alias("cell"), "n"),
    "o07_search_order": _search_order,
}

_S = "CASE WHEN lower(trim(split)) IN ('dev', 'validation') THEN 'val' ELSE lower(trim(split)) END"
_RAW = f"""{_ONE},
w AS (SELECT row_id, ord, lower(trim(source)) AS source, lower(trim(split)) AS split, group_id, j->>'$.claim' AS claim, j->>'$.evidence[0].title' AS title, j->>'$.evidence[0].text' AS body, meta->>'$.label' AS native
  FROM (SELECT *, CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state END AS j FROM o) WHERE j->>'$.claim' IS NOT NULL)"""


def _loader(source: str, row_id: str, group: str, title: str = "title", body: str = "body", native: str = "native", split: str = "CASE WHEN split IN ('dev', 'validation') THEN 'val' ELSE split END", more: str = "") -> str:
    return f"""SELECT {row_id} AS row_id, '{source}' AS source, {split} AS split, {group} AS group_id, m.label, claim, {title} AS title, md5({body}) AS body, 1.0::DOUBLE AS weight, 'ground_truth' AS label_source, {native} AS native
FROM w JOIN label_map m ON m.source = '{source}' AND lower(m.native_label) = lower(trim({native})) WHERE w.source = '{source}' AND body IS NOT NULL {more}"""


_FEVER = _loader("fever", "'fever-' || split || '-' || row_id", "'fever-claim-' || group_id", title="row_id")
_VITAMINC = _loader("vitaminc", "'vitaminc-' || row_id", "'vitaminc-case-' || group_id")
_SCIFACT = _loader(
    "scifact", "concat_ws('-', 'scifact', split, ord, CASE native WHEN 'NOINFO' THEN 'noinfo' ELSE ord::VARCHAR END)", "'scifact-claim-' || ord",
    body="CASE native WHEN 'NOINFO' THEN array_to_string(string_split(body, '. '), ' ') ELSE concat_ws(' ', string_split(body, '. ')[1], string_split(body, '. ')[3]) END",
)
_CLIMATE = _loader("climate_fever", "'climate-' || ord", "'climate-claim-' || ord", native="upper(trim(native))", split="'test'", more="AND ord % 5 <> 0")
_FAIL = "SELECT code, n, sample FROM f WHERE n > 0"
_BOARD = """
i AS (SELECT DISTINCT item_id AS puzzle_id FROM eval_items WHERE item_id IS NOT NULL),
c AS (SELECT puzzle_id, k AS cell, k // 9 AS r, k % 9 AS q, k // 27 * 3 + k % 9 // 3 AS b, CASE WHEN ('0x' || substr(md5(puzzle_id || ':' || k), 1, 2))::INT < 150 THEN NULL ELSE CAST((k // 9 * 3 + k // 27 + k % 9 + puzzle_id) % 9 + 1 AS INTEGER) END AS value
  FROM i, range(81) AS x(k)),
u AS (SELECT puzzle_id, 'r' || r AS unit, value FROM c UNION ALL SELECT puzzle_id, 'c' || q, value FROM c UNION ALL SELECT puzzle_id, 'b' || b, value FROM c),
t AS (SELECT puzzle_id, unit, list(value) FILTER (value IS NOT NULL) AS taken FROM u GROUP BY ALL),
p AS (SELECT c.puzzle_id, cell, r, q, b, list_filter(range(1, 10), lambda v: NOT list_contains(list_concat(coalesce(x.taken, []), coalesce(y.taken, []), coalesce(z.taken, [])), v::INT)) AS free
  FROM c JOIN t x ON x.puzzle_id = c.puzzle_id AND x.unit = 'r' || r JOIN t y ON y.puzzle_id = c.puzzle_id AND y.unit = 'c' || q JOIN t z ON z.puzzle_id = c.puzzle_id AND z.unit = 'b' || b WHERE value IS NULL),
l AS (SELECT puzzle_id, cell, r, q, b, unnest(CASE WHEN len(free) = 0 THEN [NULL] ELSE free END) AS value FROM p)"""
SQL = {
    "s02_predictions_round_trip": """SELECT row_id, question_id, model, round(confidence, 10) AS confidence, round(latency_ms, 10) AS latency_ms, round(list_sum(map_values(probs)), 10) AS mass, meta FROM predictions
WHERE row_id IS NOT NULL AND probs IS NOT NULL AND len(list_filter(map_values(probs), lambda p: p IS NULL OR isnan(p))) = 0 AND NOT coalesce(isnan(confidence), false)""",
    "s04_appended_rows": "SELECT lower(trim(split)) AS split, count(*) AS n, count(DISTINCT row_id) AS ids, count(*) AS places FROM fixture WHERE lower(trim(split)) IN ('train', 'val', 'validation', 'dev', 'test') GROUP BY ALL",
    "s05_numbered_lines": r"""SELECT row_number() OVER (ORDER BY ord % 10, ord) - 1 AS place, row_number() OVER (PARTITION BY ord % 10 ORDER BY ord) AS number, md5(regexp_replace(line, '[\r\n]', ' ', 'g')) AS value, line FROM cache_lines""",
    "s08_fever": f"WITH {_RAW} {_FEVER}",
    "s09_vitaminc": f"WITH {_RAW} {_VITAMINC}",
    "s10_scifact": f"WITH {_RAW} {_SCIFACT}",
    "s11_climate_fever": f"WITH {_RAW} {_CLIMATE}",
    "s12_sources": f"""WITH {_RAW}, z AS (SELECT 0 AS place, * FROM ({_FEVER}) UNION ALL SELECT 1, * FROM ({_VITAMINC}) UNION ALL SELECT 2, * FROM ({_SCIFACT}) UNION ALL SELECT 3, * FROM ({_CLIMATE}))
SELECT CAST(place AS BIGINT) AS place, source, split, label, count(*) AS n FROM z GROUP BY ALL""",
    "s18_resumed": f"WITH {_ONE} SELECT row_id, CAST(1 AS BIGINT) AS n FROM o WHERE lower(trim(split)) IN ('val', 'validation', 'dev', 'test')",
    "s19_files": "SELECT model AS arm, count(*) AS lines FROM predictions WHERE row_id IS NOT NULL AND model IS NOT NULL GROUP BY model",
    "p19_training_rows": f"""WITH {_ONE}, {_CARVE}
SELECT row_id, question_id FROM sft_rows s WHERE lower(trim(s.split)) = 'train' AND NOT EXISTS (SELECT 1 FROM c WHERE c.group_id = s.group_id)
AND NOT EXISTS (SELECT 1 FROM fixture x WHERE lower(trim(x.split)) = 'val' AND x.row_id = coalesce(s.meta->>'$.gt_row_id', s.row_id))""",
    "j08_unscored": f"WITH {_ONE} SELECT row_id FROM o WHERE lower(trim(split)) IN ('val', 'validation', 'dev', 'test') AND row_id NOT IN (SELECT row_id FROM predictions WHERE model = 'clf-small' AND row_id IS NOT NULL)",
    "j10_eval_plan": f"WITH {_ONE} SELECT row_id, s.split, schema_id FROM (SELECT row_id, {_S} AS split FROM o) s JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SCHEMAS) + ") AS v(schema_id, split) USING (split) WHERE s.split IN ('val', 'test')",
    "j11_multi_question": f"WITH {_ONE} SELECT row_id, v.schema_id, v.labels FROM o, (VALUES ('x1', 'yes,no'), ('x2', '0,1,2'), ('x3', 'a,b')) AS v(schema_id, labels)",
    "j12_joined_back": f"""WITH {GOLD.strip()}, {OPTIONS}, k AS (SELECT row_id, i, label, length(label || coalesce(': ' || nullif(d, ''), '')) AS l FROM op WHERE row_id IN (SELECT row_id FROM o WHERE cardinality(questions) = 1)),
b AS (SELECT row_id, arg_min(i, (-l, i)) - 1 AS pred FROM k GROUP BY row_id), g AS (SELECT k.row_id, i - 1 AS label FROM k JOIN gg ON gg.row_id = k.row_id AND gg.gold = k.label)
SELECT row_id, CAST(label AS INTEGER) AS label, CAST(pred AS INTEGER) AS pred, CAST(label = pred AS INTEGER) AS ok FROM b JOIN g USING (row_id)""",
    "j13_mixed_labels": f"""WITH {GOLD.strip()},{PRED}, {_ONE}, t AS (SELECT row_id, label, pn AS p FROM pn WHERE model = 'clf-large' AND question_id = 'verdict'),
k AS (SELECT o.*, ord % 2 = 1 AND row_id IN (SELECT row_id FROM t) AS swap FROM o)
SELECT row_id, 'teacher' AS label_source, label, round(p, 10) AS p FROM k JOIN t USING (row_id) WHERE swap
UNION ALL SELECT row_id, label_source, e.key, round(e.value, 10) FROM (SELECT row_id, label_source, unnest(map_entries(labels['verdict'])) AS e FROM k WHERE NOT swap AND labels['verdict'] IS NOT NULL)""",
    "g01_train_eval_gate": f"""WITH {STATES}, ev AS (SELECT *, lower(trim(source)) AS asset FROM tx WHERE coalesce(lower(trim(split)) IN ('val', 'validation', 'dev', 'test'), true)),
{PARSED(rows='ev', key='row_id').strip().replace('pa AS', 'ea AS').replace('pi AS', 'ei AS').replace('FROM pa', 'FROM ea')},
u AS (SELECT row_id, split, group_id, meta->>'$.gt_row_id' AS gt, list_filter(messages, lambda m: m.role = 'user')[1].content AS u FROM sft_rows),
t AS (SELECT *, CASE WHEN contains(u, chr(10) || 'State:' || chr(10)) THEN substr(u, strpos(u, chr(10) || 'State:' || chr(10)) + 8) END AS text FROM u),
{PARSED(rows='t', key='row_id').strip()},
es AS (SELECT row_id, {CANON('c')} || chr(1) || array_to_string(list_transform(items, lambda x: {CANON('x')}), chr(1)) AS sig, {CANON('c')} || chr(1) || array_to_string(list_sort(list_transform(items, lambda x: {CANON('x')})), chr(1)) AS sset FROM ei JOIN ea USING (row_id)),
ts AS (SELECT DISTINCT pi.row_id, {CANON('c')} || chr(1) || array_to_string(list_transform(items, lambda x: {CANON('x')}), chr(1)) AS sig, {CANON('c')} || chr(1) || array_to_string(list_sort(list_transform(items, lambda x: {CANON('x')})), chr(1)) AS sset FROM pi JOIN pa USING (row_id)),
f AS (
  SELECT 'no_such' AS code, 1::BIGINT AS n, 'x' AS sample WHERE false
  UNION ALL SELECT 'protected_group_id', count(*), min(row_id) FROM ev WHERE group_id IS NULL OR group_id = ''
  UNION ALL SELECT 'unknown_split', count(*), min(row_id) FROM tx WHERE NOT coalesce(lower(trim(split)) IN ('train', 'val', 'validation', 'dev', 'test'), true)
  UNION ALL SELECT 'unparsed_state', count(*), min(row_id) FROM ea WHERE NOT parsed
  UNION ALL SELECT 'unparsed_prompt', count(*), min(row_id) FROM pa WHERE NOT coalesce(parsed, false)
  UNION ALL SELECT 'not_train', count(*), min(row_id) FROM sft_rows WHERE NOT coalesce(lower(trim(split)) = 'train', false)
  UNION ALL SELECT 'same_state', count(*), min(row_id) FROM ts WHERE sig IN (SELECT sig FROM es)
  UNION ALL SELECT 'same_evidence_reordered', count(*), min(row_id) FROM ts WHERE sset IN (SELECT sset FROM es) AND sig NOT IN (SELECT sig FROM es)
  UNION ALL SELECT 'same_group', count(*), min(row_id) FROM sft_rows WHERE group_id IN (SELECT group_id FROM ev WHERE group_id IS NOT NULL)
  UNION ALL SELECT 'same_ground_truth_row', count(*), min(row_id) FROM u WHERE coalesce(gt, row_id) IN (SELECT row_id FROM ev))
{_FAIL} UNION ALL SELECT 'empty_asset_' || a, 0, NULL FROM (VALUES ('fever'), ('vitaminc'), ('no_such')) AS v(a) WHERE a NOT IN (SELECT asset FROM ev WHERE asset IS NOT NULL)""",
    "g02_audit_gate": f"""WITH {GOLD.strip()},{PRED},
w AS (SELECT * FROM gg WHERE lower(trim(split)) IN ('val', 'validation', 'dev', 'test')), ms AS (SELECT unnest(['clf-large', 'clf-small', 'lex-base']) AS model),
s AS (SELECT row_id, question_id, list(label ORDER BY label) AS space, count(*) FILTER (yn = 1) AS ones, max(yn) AS top FROM gn GROUP BY ALL),
h AS (SELECT row_id, question_id, model, list(label ORDER BY label) AS have, count(*) FILTER (p IS NULL OR isnan(p) OR isinf(p)) AS odd, count(*) FILTER (NOT isnan(p) AND p < 0) AS neg, sum(p) AS total FROM pl GROUP BY ALL),
b AS (SELECT pr.model, pr.row_id, pr.confidence AS cf, have, space, odd, neg, total FROM pr JOIN w USING (row_id, question_id) JOIN s USING (row_id, question_id) LEFT JOIN h ON h.row_id = pr.row_id AND h.question_id = pr.question_id AND h.model = pr.model),
x AS (SELECT model, row_id, unnest(list_filter([CASE WHEN have IS NULL THEN 'missing' END, CASE WHEN have <> space THEN 'labels' END, CASE WHEN odd > 0 THEN 'not_finite' END, CASE WHEN neg > 0 THEN 'negative' END, CASE WHEN total <= 0 THEN 'no_mass' END,
    CASE WHEN abs(total - 1) > 1e-6::DOUBLE THEN 'sum' END, CASE WHEN cf IS NULL OR isnan(cf) THEN 'no_confidence' END, CASE WHEN cf < -1e-9::DOUBLE OR (NOT isnan(cf) AND cf > 1 + 1e-9::DOUBLE) THEN 'confidence_range' END], lambda c: c IS NOT NULL)) AS code FROM b),
fails AS (
  SELECT code, count(*) AS n, min(row_id) AS sample, model FROM x GROUP BY code, model
  UNION ALL SELECT 'missing_answer', count(*), min(row_id), model FROM w, ms WHERE (model, row_id, question_id) NOT IN (SELECT (model, row_id, question_id) FROM pr) GROUP BY model
  UNION ALL SELECT 'extra_answer', count(*), min(row_id), model FROM pr WHERE (row_id, question_id) NOT IN (SELECT (row_id, question_id) FROM w) GROUP BY model
  UNION ALL SELECT 'gold_not_one_hot', count(*), min(row_id), model FROM w JOIN s USING (row_id, question_id), ms WHERE NOT (ones = 1 AND top = 1) GROUP BY model)
SELECT code, n, sample, model FROM fails WHERE n > 0""",
    "g03_chat_gate": f"""WITH t AS (SELECT * FROM sft_rows WHERE lower(trim(split)) = 'train'),
f AS (
  SELECT 'test_rows' AS code, count(*) AS n, min(row_id) AS sample FROM sft_rows WHERE lower(trim(split)) = 'test'
  UNION ALL SELECT 'evaluated_id', count(*), min(row_id) FROM t WHERE row_id IN (SELECT row_id FROM fixture WHERE lower(trim(split)) IN ('val', 'validation', 'dev', 'test') AND row_id IS NOT NULL)
  UNION ALL SELECT 'held_out_schema', count(*), min(row_id) FROM t WHERE schema_id IN ('fc-c6', 'fc-c7')
  UNION ALL SELECT 'evaluated_pair', count(*), min(row_id) FROM t WHERE schema_id = 'fc-c3' AND source IN (SELECT source FROM sft_rows WHERE schema_id = 'fc-c2')
  UNION ALL SELECT 'label_not_in_space', count(*), min(row_id) FROM sft_rows WHERE NOT coalesce(list_contains(label_space, label), false)
  UNION ALL SELECT 'targets_not_the_space', count(*), min(row_id) FROM sft_rows WHERE coalesce(list_sort(map_keys(target_probs)) <> list_sort(label_space), true)
  UNION ALL SELECT 'roles', count(*), min(row_id) FROM sft_rows WHERE coalesce(array_to_string(list_transform(messages, lambda m: m.role), ',') <> 'system,user,assistant', true)
  UNION ALL SELECT 'answer_not_the_label', count(*), min(row_id) FROM sft_rows WHERE coalesce(messages[3].content <> label, true)
  UNION ALL SELECT 'label_share', count(*), min(label) FROM (SELECT label, count(*) / (SELECT count(*) FROM t) AS s FROM t GROUP BY label) WHERE NOT (s BETWEEN 0.1 AND 0.6))
{_FAIL}""",
    "g04_plan_gate": f"""WITH {PRED.strip()}, {_ONE}, g AS (SELECT row_id, arg_min(label, pos) FILTER (p = mx) AS first, any_value(s) AS s FROM pv WHERE bad = 0 AND s > 0 AND model = 'clf-large' AND question_id = 'verdict' GROUP BY row_id),
k AS (SELECT g.*, 'fc-c' || (pr.ord % 5) AS w FROM g JOIN pr ON pr.row_id = g.row_id AND pr.model = 'clf-large' AND pr.question_id = 'verdict'), e AS (SELECT row_id FROM o WHERE lower(trim(split)) = 'test'),
f AS (
  SELECT 'wording_not_allowed' AS code, count(*) AS n, min(w) AS sample FROM k WHERE w = 'fc-c4'
  UNION ALL SELECT 'evaluated_pair', count(*), min(row_id) FROM k WHERE w = 'fc-c1' AND row_id IN (SELECT row_id FROM e)
  UNION ALL SELECT 'evaluated_state', count(*), min(row_id) FROM k WHERE row_id IN (SELECT row_id FROM e)
  UNION ALL SELECT 'sum', count(*), min(row_id) FROM k WHERE abs(s - 1) > 2.5e-6::DOUBLE
  UNION ALL SELECT 'label_share', count(*), min(first) FROM (SELECT first, count(*) / (SELECT count(*) FROM k) AS p FROM k GROUP BY first) WHERE NOT (p BETWEEN 0.3 AND 0.5))
{_FAIL}""",
    "g06_counts": f"""WITH {_ONE} SELECT 'count_' || s AS code, n, w::VARCHAR AS sample FROM (
  SELECT s, w, count(o.row_id) AS n FROM (VALUES ('train', 2500), ('val', 0), ('test', 290), ('none', 1)) AS v(s, w) LEFT JOIN o ON lower(trim(o.split)) = s GROUP BY ALL) WHERE n <> w""",
    "u01_union": "SELECT 'fixture' AS of, count(*) AS n, count(DISTINCT row_id) AS ids FROM fixture UNION ALL SELECT 'sft_rows', count(*), count(DISTINCT row_id) FROM sft_rows".replace(" AS of", ' AS "of"'),
    "u02_shared_sets": f"""WITH {STATES}, {PARSED(rows='tx', key='row_id').strip()},
k AS (SELECT CASE WHEN lower(trim(split)) = 'train' THEN 't' WHEN lower(trim(split)) IN ('val', 'validation', 'dev', 'test') THEN 'e' END AS s, {CANON('c')} || chr(1) || array_to_string(list_transform(items, lambda x: {CANON('x')}), chr(1)) AS sig,
    {CANON('c')} || chr(1) || array_to_string(list_sort(list_transform(items, lambda x: {CANON('x')})), chr(1)) AS sset FROM pi JOIN pa USING (row_id)),
x AS (SELECT sig FROM k WHERE s = 't' INTERSECT SELECT sig FROM k WHERE s = 'e')
SELECT 'same' AS kind, count(*) AS n FROM x UNION ALL SELECT 'reordered', count(*) FROM (SELECT sset FROM k WHERE s = 't' INTERSECT SELECT sset FROM k WHERE s = 'e') WHERE sset NOT IN (SELECT sset FROM k WHERE sig IN (SELECT sig FROM x))""",
    "m05_schema_split": """WITH s AS (SELECT schema_id, row_number() OVER (ORDER BY schema_id) - 1 AS k FROM (SELECT DISTINCT schema_id FROM sft_rows WHERE schema_id IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY k % 2 ORDER BY k DESC) AS j, count(*) OVER (PARTITION BY k % 2) AS n FROM s)
SELECT schema_id, CASE WHEN n > 2 AND j = 1 THEN 'test' WHEN n > 2 AND j = 2 THEN 'val' ELSE 'train' END AS split FROM r""",
    "m10_retries": f"""WITH {STATES}, q AS (SELECT row_id, questions['verdict'] AS q FROM o WHERE questions['verdict'] IS NOT NULL),
l AS (SELECT row_id, x AS label, i, q.criteria::JSON->>('$."' || x || '"') AS d FROM (SELECT *, unnest(json_keys(q.criteria)) AS x, generate_subscripts(json_keys(q.criteria), 1) AS i FROM q)),
w AS (SELECT row_id, string_split_regex(lower(any_value(q.q.instructions) || chr(10) || string_agg(label || coalesce(': ' || nullif(d, ''), ''), chr(10) ORDER BY i) || chr(10) || chr(10) || 'State:' || chr(10) || coalesce(any_value(text), '') || chr(10) || chr(10) || 'Verdict:'), '\\s+') AS words
  FROM l JOIN q USING (row_id) JOIN tx USING (row_id) WHERE text IS NOT NULL GROUP BY row_id),
s AS (SELECT row_id, label, 1 + len(list_filter(words, lambda x: starts_with(x, left(label, 4)))) AS s FROM l JOIN w USING (row_id))
SELECT row_id, label, round(s / sum(s) OVER (PARTITION BY row_id), 10) AS p FROM s""",
    "a29_throughput": f"WITH {_ONE} SELECT CAST(sum(cardinality(questions)) AS BIGINT) AS n, true AS took, true AS rate FROM o",
    "r11_cells": f"WITH {_BOARD.strip()} SELECT puzzle_id, CAST(cell AS INTEGER) AS cell, value FROM c",
    "j16_candidates": f"WITH {_BOARD.strip()} SELECT puzzle_id, CAST(cell AS INTEGER) AS cell, CAST(value AS INTEGER) AS value FROM l",
    "m19_singles": f"""WITH {_BOARD.strip()}, lu AS (SELECT puzzle_id, cell, value, 'r' || r AS unit FROM l UNION ALL SELECT puzzle_id, cell, value, 'c' || q FROM l UNION ALL SELECT puzzle_id, cell, value, 'b' || b FROM l)
SELECT puzzle_id, CAST(cell AS INTEGER) AS cell, CAST(free[1] AS INTEGER) AS value, 'naked' AS rule FROM p WHERE len(free) = 1
UNION ALL SELECT DISTINCT puzzle_id, CAST(min(cell) AS INTEGER), CAST(value AS INTEGER), 'hidden' FROM lu WHERE value IS NOT NULL GROUP BY puzzle_id, unit, value HAVING count(*) = 1""",
    "m19_solved": f"WITH {_BOARD.strip()} SELECT puzzle_id, CAST(27 AS BIGINT) AS units, CAST(9 AS BIGINT) AS digits, 1 AS fits FROM i",
    "o06_fewest": f"WITH {_BOARD.strip()} SELECT puzzle_id, CAST(arg_min(cell, (len(free), cell)) AS INTEGER) AS cell, min(len(free)) AS n FROM p GROUP BY puzzle_id",
    "o07_search_order": f"""WITH {_BOARD.strip()}, x AS (SELECT puzzle_id, cell, value, ('0x' || substr(md5(puzzle_id || ':' || cell || ':' || value), 1, 2))::INT / 256 AS p FROM l WHERE value IS NOT NULL),
y AS (SELECT *, max((p >= 0.5)::INT) OVER (PARTITION BY puzzle_id, cell) AS any_passes FROM x)
SELECT puzzle_id, CAST(cell AS INTEGER) AS cell, CAST(value AS INTEGER) AS value, CAST(row_number() OVER (PARTITION BY puzzle_id, cell ORDER BY p DESC, value) AS INTEGER) AS turn FROM y WHERE any_passes = 0 OR p >= 0.5""",
}
SQL["s05_numbered_lines"] = "SELECT place, number, value FROM (" + SQL["s05_numbered_lines"] + ") WHERE trim(line) <> ''"
