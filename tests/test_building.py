"""Sources, flat tables, record building, splits, plans, gates, chat records, scoring and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quorate.functions import dist
from quorate.operators import chat, etl, gates, scoring
from quorate.operators.components import connected_components
from quorate.operators.nested import children, flat_tables
from quorate.plans import planning
from quorate.plans.runtime import drop_scratch, materialize, scratch_path
from quorate.sources import datasets, jsonl
from quorate.streaming import caches

CHOICE = {"kind": "choice", "instructions": "Which?", "criteria": '{"supported": "yes it is", "refuted": null, "nei": ""}'}
NOUL = {"kind": "noul", "instructions": "Is it?", "criteria": None}


def test_flat_tables(fixture_rows):
    rows = [
        {"row_id": "a", "state": json.dumps({"claim": "C", "evidence": [{"title": "T", "text": "x"}, {"text": None}, "bare", None, 5, {"title": "only"}, {"text": ""}, '{"text": "in a string"}']}),
         "questions": {"q/1": CHOICE, "s": {"kind": "score", "instructions": "s", "criteria": '["lo", "hi"]'}, "n": NOUL}, "labels": {"q/1": {"supported": 1.0, "nei": None}, "s": None}, "meta": '{"arm": "z", "teacher": {"m": 1}}'},
        {"row_id": "b", "state": "Claim: plain", "questions": None, "labels": {}, "meta": "[]"},
        {"row_id": "c", "state": '{"claim": "x", "evidence": {"text": "no list"}}', "meta": "{broken"},
        {"row_id": "d", "state": None}, {"row_id": None, "state": '{"evidence": ["x"]}'}, {"row_id": "e", "state": json.dumps({"evidence": ["w " * 200000]})},
    ]
    table = fixture_rows(rows + rows[:1]).withColumn("pos", F.lit(1)).withColumn("key", F.lit(2)).withColumn("value", F.lit("clash"))
    assert {tuple(r) for r in children(table).collect()} == {
        ("a", "evidence", "0"), ("a", "evidence", "2"), ("a", "evidence", "6"), ("a", "evidence", "7"), ("e", "evidence", "0"),
        ("a", "question", "q/1"), ("a", "question", "s"), ("a", "question", "n"), ("a", "label", "q/1/supported"), ("a", "label", "q/1/nei"),
    }
    flat = flat_tables(table)
    first = {r.pos: (r.title, r.text) for r in flat.evidence.where("row_id = 'a' and ord = 0").collect()}
    assert first == {0: ("T", "x"), 2: (None, "bare"), 6: (None, ""), 7: (None, '{"text": "in a string"}')}
    assert {(r.question_id, r.pos, r.option, r.definition) for r in flat.criteria.where("ord = 0").collect()} == {("q/1", 0, "supported", "yes it is"), ("q/1", 1, "refuted", None), ("q/1", 2, "nei", ""), ("s", 0, "0", "lo"), ("s", 1, "1", "hi")}
    assert {(r.path, r.value) for r in flat.meta.where("ord = 0").collect()} == {("arm", "z"), ("teacher", '{"m":1}')}
    heads = {r.row_id: r for r in flat.records.where("ord < 6").collect()}
    assert (heads["a"].claim, heads["a"].evidence_count, heads["a"].question_count, heads["a"].label_count) == ("C", 4, 3, 2)
    assert heads["b"].plain_text == "Claim: plain" and heads["d"].evidence_count == 0 and heads["c"].claim == "x"
    assert children(fixture_rows([])).count() == 0 and flat_tables(fixture_rows([]).drop("ord")).records.count() == 0


def test_components(spark):
    import random

    rng = random.Random(0)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_jsonl_round_trip(spark, fixture_rows, tmp_path, state):
    rows = [{"row_id": "a", "source": "s", "split": "train", "group_id": "g", "state": state('q"\\\n', "x"), "questions": {"v": CHOICE, "n": NOUL}, "labels": {"v": {"z": 0.25, "a": 0.75}}, "weight": 2.0, "label_source": None, "meta": '{"k": [1, 2]}'},
            {"row_id": "b", "source": "s", "split": "val", "group_id": "g", "state": "plain {text", "questions": {"n": NOUL}, "labels": {"n": {"yes": 1.0, "no": 0.0}}, "weight": None, "meta": None}]
    at = f"file://{tmp_path}/rows"
    assert jsonl.write_rows(fixture_rows(rows), at) == 2 and jsonl.write_rows(fixture_rows(rows[:1]), at, "append") == 1
    lines = [json.loads(r.value) for r in spark.read.text(at).collect()]
    one = next(x for x in lines if x["row_id"] == "a")
    assert one["state"] == json.loads(rows[0]["state"]) and one["questions"]["v"]["criteria"]["refuted"] is None and one["meta"] == {"k": [1, 2]}
    back = {r.row_id: r for r in jsonl.read_rows(spark, at).collect()}
    assert json.loads(back["a"].state) == json.loads(rows[0]["state"]) and back["b"].state == "plain {text" and back["b"].weight == 1.0 and back["b"].meta == "{}"
    # Python's dict loses its order on the way in, JSON keeps it on the way out.
    order = [json.loads(r.value)["labels"]["v"] for r in spark.read.text(at).where("value like '%\"a\"%'").limit(1).collect()]
    kept = jsonl.read_rows(spark, at).where("row_id = 'a'").select(F.map_keys(F.col("labels")["v"]).alias("k")).first().k
    assert kept == list(order[0])


def test_strict_reading(spark, tmp_path):
    good = {"row_id": "a", "question_id": "v", "probs": {"z": 0.5, "y": 0.5}, "confidence": None, "model": "m", "latency_ms": None, "meta": {}}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n\n")
    r = jsonl.read_predictions(spark, f"file://{tmp_path}/p.jsonl").select(F.map_keys("probs").alias("k")).collect()
    assert [x.k for x in r] == [["z", "y"]]
    for bad in ('{"row_id": "a"', '{"row_id": "a", "question_id": "v", "probs": {"z": 1, "z": 0}, "model": "m"}', '{"question_id": "v", "probs": {"z": 1}}'):
        (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n" + bad + "\n")
        with pytest.raises(Exception, match="bad.jsonl"):
            jsonl.read_predictions(spark, f"file://{tmp_path}/bad.jsonl").collect()
    assert jsonl.read_predictions(spark, [f"file://{tmp_path}/none.jsonl"], missing_ok=True).count() == 0
    with pytest.raises(Exception):
        jsonl.read_predictions(spark, f"file://{tmp_path}/none.jsonl").count()


def test_cache_view_and_stream(spark, tmp_path):
    answer = lambda c: {"distributions": {"v": {"yes": c, "no": 1 - c}}, "confidence": c, "usage": {"input_tokens": 3}, "latency_ms": 1.0, "model": "m"}
    rows = [(0, json.dumps({"key": "a", "answer": answer(0.1)})), (1, ""), (2, '{"key": "a", "ans'), (5, json.dumps({"key": "a", "answer": answer(0.9)})), (3, json.dumps({"key": "a", "answer": answer(0.3)})), (4, json.dumps({"key": "b"})), (6, json.dumps({"key": "c", "answer": answer(0.5)}))]
    table = spark.createDataFrame(rows, "ord long, line string")
    want = {"a": 0.9, "c": 0.5}
    assert {r.key: r.answer.confidence for r in jsonl.cache_view(table).collect()} == want
    at, target = f"file://{tmp_path}/lines", f"file://{tmp_path}/cache"
    table.where("ord < 4").write.parquet(at)
    caches.upsert_cache(caches.stream_of(spark, at, table.schema), target)
    table.where("ord >= 4").write.mode("append").parquet(at)
    last = caches.upsert_cache(caches.stream_of(spark, at, table.schema), target)
    assert {r.key: r.answer.confidence for r in spark.read.parquet(last).collect()} == want


def test_event_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=7 * k), k % 3, "ab"[k % 2], float(k)) for k in range(200)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, event_type string, value double")
    at = f"file://{tmp_path}/events"
    table.coalesce(1).write.parquet(at)
    got = {tuple(r) for r in caches.run_once(caches.event_counts(caches.stream_of(spark, at, table.schema)), "w").collect()}
    full = {tuple(r) for r in caches.event_counts(table).collect()}
    assert got < full and len(full) - len(got) <= 4  # the last window stays open
    assert caches.sessions(table).count() == 3


def test_report_is_all_or_nothing(tmp_path):
    at = tmp_path / "x" / "r.json"
    jsonl.write_report(str(at), {"b": 1, "a": 2})
    assert at.read_text().index('"a"') < at.read_text().index('"b"')
    with pytest.raises(TypeError):
        jsonl.write_report(str(at), {"b": object()})
    assert json.loads(at.read_text()) == {"a": 2, "b": 1} and len(list(at.parent.iterdir())) == 1
    import hashlib

    assert jsonl.checksum(str(at), 3) == hashlib.sha256(at.read_bytes()).hexdigest()


@pytest.fixture(scope="module")
def label_map(spark):
    return spark.createDataFrame([("fever", "SUPPORTS", "supported"), ("fever", "REFUTES", "refuted"), ("vitaminc", "SUPPORTS", "supported"), ("scifact", "SUPPORT", "supported"), ("scifact", "CONTRADICT", "refuted"), ("scifact", "NOINFO", "not_enough_info"), ("climate_fever", "SUPPORTS", "supported"), ("climate_fever", "REFUTES", "refuted")], "source string, native_label string, label string")


def test_loaders(spark, label_map):
    fever = spark.createDataFrame([("P", "H", "SUPPORTS", 7, 1, "dev"), ("P", "H2", "??", 8, 1, "train")], "premise string, hypothesis string, fever_gold_label string, fid int, cid int, split string")
    rows = datasets.fever(fever, label_map).collect()
    assert [(r.row_id, r.group_id, r.split, json.loads(r.state)) for r in rows] == [("fever-dev-7", "fever-claim-1", "val", {"claim": "P", "evidence": [{"title": "7", "text": "H"}]})]
    assert rows[0].labels["verdict"] == {"supported": 1.0, "refuted": 0.0, "not_enough_info": 0.0}
    rationale = "array<struct<sentences:array<int>,label:string>>"
    claims = spark.createDataFrame([
        (1, "c1", {"10": [([2, 0], "SUPPORT"), ([0, 9], "SUPPORT")], "99": [([0], "SUPPORT")], "11": [([0], "SUPPORT"), ([1], "CONTRADICT")]}, [10], "train"),
        (2, "c2", {}, [11, 99, 10], "dev"), (3, "c3", None, [], "test"),
    ], f"id int, claim string, evidence map<string,{rationale}>, cited_doc_ids array<int>, split string")
    corpus = spark.createDataFrame([(10, "T10", ["a", "b", "c"]), (11, "T11", ["d", "e"])], "doc_id int, title string, abstract array<string>")
    got = {r.row_id: [(e.get("title"), e["text"]) for e in json.loads(r.state)["evidence"]] for r in datasets.scifact(claims, corpus, label_map).collect()}
    assert got == {"scifact-train-1-10": [("T10", "a c")], "scifact-dev-2-noinfo": [("T11", "d e"), ("T10", "a b c")], "scifact-test-3-noinfo": []}
    climate = spark.createDataFrame([(1, "c", 0, [("A", "x"), ("B", "y")]), (2, "d", 3, [("A", "x")])], "claim_id int, claim string, claim_label int, evidences array<struct<article:string,evidence:string>>")
    assert [json.loads(r.state)["evidence"][1]["title"] for r in datasets.climate_fever(climate, label_map).collect()] == ["B"]
    vitaminc = spark.createDataFrame([("c", "e", "p", "SUPPORTS", "u", "k", "real", "validation")], "claim string, evidence string, page string, label string, unique_id string, case_id string, revision_type string, split string")
    both = datasets.load(spark, {"fever": (fever,), "vitaminc": (vitaminc,), "scifact": (claims, corpus)}, label_map, most=2)
    assert both.where("source = 'scifact'").count() == 2 and both.where("split = 'val' and source = 'vitaminc'").count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        datasets.load(spark, {"x": ()}, label_map)


def test_deduplication(fixture_rows, state):
    rows = [{"row_id": "a", "state": state("The Claim!", "One.", "two")}, {"row_id": "b", "state": state("the  claim", "TWO", "one", "one")}, {"row_id": "c", "state": state("the claim", "one")}, {"row_id": "d", "state": state("The claim", "two", "ONE")}]
    for table in (fixture_rows(rows), fixture_rows(rows).repartition(5)):
        out = {r.row_id: (r.dup_count, r.dropped_row_ids) for r in etl.deduplicated(table, etl.dedupe_key(F.col("state"), F.col("row_id"))).collect()}
        assert out == {"a": (3, ["b", "d"]), "c": (None, None)}
    same = [dict(rows[0], row_id=r, ord=o) for r, o in (("y", 1), ("x", 1), ("z", 2))]  # equal order: one survivor, by id
    blank = [{"row_id": f"n{k}", "state": s, "ord": 9} for k, s in enumerate([None, "", "?!", "Some Text", "some  text"])]
    got = {r.row_id: r.dropped_row_ids for r in etl.deduplicated(fixture_rows(same + blank), etl.dedupe_key(F.col("state"), F.col("row_id"))).collect()}
    assert got == {"x": ["y", "z"], "n0": None, "n1": None, "n2": None, "n3": ["n4"]}


def test_splits_and_caps(spark):
    sizes = spark.createDataFrame([(f"g{k}", 1 + k % 5) for k in range(60)], "component string, n long")
    split = {r.component: r.split for r in etl.greedy_splits(sizes).collect()}
    total = {s: sum(1 + k % 5 for k in range(60) if split[f"g{k}"] == s) for s in ("train", "val", "test")}
    assert len(split) == 60 and abs(total["train"] - 144) <= 5 and abs(total["val"] - 18) <= 5
    rows = spark.createDataFrame([(f"g{k}", k * 10 + j) for k in range(20) for j in range(1 + k % 4)], "group_id string, ord long")
    assert {r.component: r.split for r in etl.greedy_splits(sizes, most=7).collect()} == split  # in nine ranges, each of seven or so
    capped = etl.capped_groups(rows, 17).collect()
    assert sorted(etl.capped_groups(rows, 17, at_once=3).collect()) == sorted(capped)
    assert len(capped) <= 17 and all(sum(r.group_id == g for r in capped) == 1 + int(g[1:]) % 4 for g in {r.group_id for r in capped})
    assert etl.capped_groups(rows, 1000).count() == rows.count()
    big = spark.createDataFrame([("g", k) for k in range(9)], "group_id string, ord long")
    assert [r.ord for r in etl.capped_groups(big, 4).collect()] == [0, 1, 2, 3]
    ratio = [r.split for r in etl.ratio_splits(rows.select("group_id"), "group_id").collect()]
    assert (ratio.count("train"), ratio.count("val"), ratio.count("test")) == (16, 2, 2)
    carved = etl.carve(rows, 0.3).collect()
    assert 15 <= sum(r.n for r in carved) <= 18


def test_planning(spark):
    schemas = [(f"c{k}", "choice") for k in range(8)] + [("n0", "noul"), ("n1", "noul")]
    s = planning.schema_splits(schemas)
    assert [x for x in s if s[x] == "val"] == ["c6"] and [x for x in s if s[x] == "test"] == ["c7"]
    states = spark.createDataFrame([(f"{label}{k}", label, k % 4 == 0) for label, n in (("a", 8), ("b", 100), ("c", 100)) for k in range(n)], "state_key string, label string, synthetic boolean")
    twice = spark.createDataFrame([("a1", "b", False), ("b1", "b", True), ("b1", "c", False)], states.schema)  # under two labels, found and synthetic
    got = planning.quota_plan(states.unionByName(twice), ["s1", "s2", "s3"], ["a", "b", "c"], 150).collect()
    assert len(got) == len({(r.state_key, r.schema_id) for r in got}) == 150
    planned = [sum(r.label == x for r in got) for x in "abc"]
    assert planned[0] < 50 and planned[1] == (150 - planned[0]) // 2
    rows = spark.createDataFrame([(k, 100) for k in range(50)], "ord long, tokens int")
    kept = planning.within_budget(rows, 1000.0, price=1.0, block=7)
    assert sorted(r.ord for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    runs = planning.runs(spark.createDataFrame([("u", k, v) for k, v in enumerate("aabba")], "u string, k int, v string"), "v", "k", ["u"])
    assert [r.run for r in runs.orderBy("k").collect()] == [1, 1, 2, 2, 3]
    assert planning.estimate(rows) == pytest.approx(50 * 450 * 0.042 / 1e6)


POOL = "row_id string, split string, user string, group_id string, gt_row_id string"


@pytest.fixture(scope="module")
def gate(spark, fixture_rows, state):
    prompt = lambda claim, *lines: "Which?\na\nb\n\nState:\nClaim: " + claim + "\nEvidence:\n" + ("\n".join(f"{k}. {x}" for k, x in enumerate(lines, 1)) or "(none)")
    base = [{"row_id": "e1", "split": "val", "group_id": "ge", "state": state("the claim", "one", "two")}, {"row_id": "e2", "split": "train", "group_id": "gt", "state": state("other", "three")}]

    def run(pool, protected=base):
        pool = spark.createDataFrame([(r.get("row_id", "t1"), r.get("split", "train"), r.get("user", prompt("new", "t: x")), r.get("group_id"), r.get("gt")) for r in pool], POOL)
        return {r.code for r in gates.train_eval_gate(pool, fixture_rows(protected)).collect()}

    return run, prompt, base


def test_train_eval_gate(gate, state):
    run, prompt, base = gate
    assert run([{}]) == set()
    assert run([{"user": prompt("other", "t: three")}]) == set()  # a training source
    assert run([{"user": prompt("the claim", "t: else")}, {"user": prompt("unlike", "t: one")}]) == set()
    assert run([{"user": prompt("The  CLAIM", "t: one", "t: two")}]) == {"same_state"}
    assert run([{"user": prompt("the claim", "t: two", "t: one")}]) == {"same_evidence_reordered"}
    assert run([{"group_id": "ge"}]) == {"same_group"} and run([{"gt": "e1"}]) == {"same_ground_truth_row"} and run([{"row_id": "e1"}]) == {"same_ground_truth_row"}
    assert run([]) == {"empty_pool"} and run([{}], base[1:]) == {"no_protected_rows"}
    assert run([{"split": "val"}]) == {"not_train"} and run([{"user": "no state"}]) == {"unparsed_prompt"}
    assert run([{}], base + [{"row_id": "e3", "split": "val", "group_id": "g3", "state": "nothing"}]) == {"unparsed_state"}
    assert run([{}], base + [{"row_id": "e3", "split": "dump", "group_id": "g3", "state": state("x", "y")}]) == {"unknown_split"}
    assert run([{}], base + [{"row_id": "e3", "split": "test", "group_id": "g3", "state": state("no evidence")}]) == set()
    with pytest.raises(ValueError, match="x: 1"):
        gates.check(SparkLike())


class SparkLike:
    def collect(self):
        from pyspark.sql import Row

        return [Row(code="x", n=1, sample="s")]


def test_chat_records(fixture_rows, spark, state):
    rows = [{"row_id": "a", "split": "train", "source": "s", "group_id": "g", "state": state("C", "x"), "questions": {"v": CHOICE}, "labels": {"v": {"nei": 0.5, "supported": 1.5, "refuted": 0.0}}, "meta": '{"gt_row_id": "a"}'}]
    r = chat.chat_records(fixture_rows(rows)).first()
    assert r.label == "supported" and r.label_space == ["supported", "refuted", "nei"] and r.target_probs == {"supported": 0.75, "refuted": 0.0, "nei": 0.25}
    assert [m.role for m in r.messages] == ["system", "user", "assistant"] and r.messages[1].content.endswith("State:\nClaim: C\nEvidence:\n1. t: x")
    chats = chat.chat_records(fixture_rows(rows))
    assert chat.parsed_prompts(chats).first().evidence == ["t: x"] and chat.recovered_states(chats, fixture_rows(rows)).first().found
    empty = spark.createDataFrame([], "row_id string"), spark.createDataFrame([], "source string, schema_id string")
    assert {x.code for x in gates.chat_gate(chats, *empty, held_out=["default"], share=(0.0, 1.0)).collect()} == {"held_out_schema"}
    assert {x.code for x in gates.chat_gate(chats, chats.select("row_id"), empty[1], []).collect()} == {"evaluated_id", "label_share"}
    bad = [dict(rows[0], labels={"v": {"supported": 1.0}})]
    with pytest.raises(Exception, match="not the space"):
        chat.chat_records(fixture_rows(bad)).collect()
    assert chat.option_rows(fixture_rows(rows)).first().label == 0
    with pytest.raises(Exception, match="not one choice"):
        chat.option_rows(fixture_rows([dict(rows[0], questions={"v": CHOICE, "n": NOUL})])).collect()


def test_scoring_and_cache(fixture_rows, spark, state):
    rows = [{"row_id": f"r{k}", "state": state("same claim", "supported by this"), "questions": {"v": CHOICE}} for k in range(3)]
    requests = scoring.requests(fixture_rows(rows))
    empty = spark.createDataFrame([], f"key string, answer {dist.NONE}, latency_ms double")
    both, new = scoring.answered(requests, empty, "m", scoring.lexical_scorer)
    got = both.collect()
    assert len(got) == 3 and not any(r.cached for r in got) and new.count() == 1 and sum(e.p for e in got[0].answer) == pytest.approx(1)
    again, none = scoring.answered(requests, materialize(new, "cache"), "m", scoring.lexical_scorer)
    assert all(r.cached for r in again.collect()) and none.count() == 0
    assert scoring.passes(requests).first().passes == 1


def test_scratch_is_removed(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    drop_scratch()
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_registry(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and all(callable(f) for f in names.values())
    assert e.entry(spark).count() > 0


def test_every_record_meets_every_extra_question(spark):
    from quorate.operators import chat

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "row_id string, state string")
    schemas = spark.range(1200).selectExpr("concat('s', id) AS schema_id", "'choice' AS kind", "'pick' AS instructions", "'c' AS criteria")
    found = chat.multi_question(rows, schemas)
    assert found.columns == ["row_id", "state", "schema_id", "kind", "instructions", "criteria"]
    assert found.distinct().count() == 2400
    assert chat.multi_question(rows, schemas.where("false")).count() == 0


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"row_id": f"b{k}", "question_id": "q", "probs": {"x": 1.0}}) for k in range(50)) + "\n")
    (tmp_path / "a.jsonl").write_text("\n" + json.dumps({"row_id": "a0", "question_id": "q", "probs": {"x": 1.0}}) + "\n")
    found = jsonl.lines(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]).orderBy("ord").collect()
    assert [(r.file, r.line) for r in found] == [("a.jsonl", 2)] + [("b.jsonl", k + 1) for k in range(50)]
    assert [r.row_id for r in jsonl.read_predictions(spark, str(tmp_path / "*.jsonl")).orderBy("ord").limit(2).collect()] == ["a0", "b0"]
    (tmp_path / "c.jsonl").write_text("\n\nnot json\n")
    with pytest.raises(Exception, match="c.jsonl:3:not json"):
        jsonl.read_predictions(spark, str(tmp_path / "c.jsonl")).collect()


def test_budgets_are_checked_before_and_after(spark, tmp_path):
    rows = spark.createDataFrame([(k, 100) for k in range(50)], "ord long, tokens int")
    assert planning.affordable(rows, 1.0).count() == 50
    with pytest.raises(ValueError, match="budget"):
        planning.affordable(rows, 1e-9)
    with pytest.raises(ValueError, match="6 of 50"):
        planning.written_within_budget(rows, str(tmp_path / "out"), 1000.0, price=1.0)
    assert not (tmp_path / "out").exists()
    assert planning.written_within_budget(rows, str(tmp_path / "out"), 10000.0, price=1.0) == 50
    history = spark.createDataFrame([(h,) for h in ([3.0, 2.0, 2.0, 2.0], [1.0], [], [1.0, 0.5, 0.49999, 0.6, 0.4], [1.0, 2.0, 2.0, 0.1])], "h array<double>")
    got = [r[0] for r in history.select(planning.stopping_epoch(F.col("h"), 2)).collect()]
    assert got == [planning.stopped_at(r.h, 2) for r in history.collect()] == [3, None, None, 3, 2]


def test_shared_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    from quorate.plans import runtime

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Fake)
    import os

    with runtime.scratch_scope():
        path = runtime.materialize(spark.range(3), "scoped").inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)
