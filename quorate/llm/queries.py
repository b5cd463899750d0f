"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import scratch_path, table
from .group_splits import State, adopt_splits, assign_splits, record_splits
from .language import languages, wrong_labels
from .leakage import leaked_items
from .mixing import balance, mix_sources
from .near_duplicates import near_duplicates, record_groups, record_pairs
from .overlap import overlap_pairs, overlap_report, split_name
from .quota_sample import bounds, quota_sample
from .tokenize import decode, encode


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_pairs(near_duplicates(table(spark, sf_dir, "fixture")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_groups(near_duplicates(table(spark, sf_dir, "fixture")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_pairs(table(spark, sf_dir, "fixture"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "fixture"))


def _mix(spark: SparkSession, sf_dir: str):
    return mix_sources(table(spark, sf_dir, "fixture"), table(spark, sf_dir, "mix_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report.where("short").select("source", "label_source")


def p2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).chosen


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cube method keeps: weight, words and number of draws of each pair against what is expected.

    The flight keeps all three; the landing of at most three records a pair can miss the
    expected weight by their weights, and words and draws by a few records' worth.
    """
    mix = _mix(spark, sf_dir)
    return balance(table(spark, sf_dir, "fixture"), mix)


def _sample(spark: SparkSession, sf_dir: str):
    return quota_sample(*(table(spark, sf_dir, x) for x in ("fixture", "label_map", "category_targets")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report.where("short").select("source", "label", "arm")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).chosen


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's sample against its bounds, and the sample against its size."""
    return bounds(_sample(spark, sf_dir))


def _splits(spark: SparkSession, sf_dir: str):
    return assign_splits(table(spark, sf_dir, "fixture"), table(spark, sf_dir, "split_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).groups.where("linked").select("group_id", "root_group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_splits(table(spark, sf_dir, "fixture"), _splits(spark, sf_dir))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the records that each split got, in whole percents."""
    groups = _splits(spark, sf_dir).groups
    total = groups.agg(F.sum("records").alias("total"))
    per = groups.groupBy("split").agg(F.sum("records").alias("records"))
    return per.crossJoin(F.broadcast(total)).select("split", F.round(F.col("records") / F.col("total"), 2).alias("share"))  # one row


def _early(rows: DataFrame) -> DataFrame:
    """The rows of the first half of the time of ingestion."""
    at = F.unix_micros("ingested_at")
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    return rows.where(at < F.lit(((ends.a or 0) + (ends.b or 0)) // 2))


def _reloaded(state: State, spark: SparkSession) -> State:
    path = scratch_path(spark, "split_state")
    state.save(path)
    return State.load(spark, path)


def p5_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the rows, then all of them: records of each group, and whether known ones kept their split."""
    rows, targets = table(spark, sf_dir, "fixture"), table(spark, sf_dir, "split_targets")
    first = _reloaded(assign_splits(_early(rows), targets), spark)
    second = assign_splits(rows, targets, first)
    before = first.groups.select("group_id", F.col("split").alias("before"))
    return second.groups.join(before, "group_id", "left").select("group_id", "records", F.col("before").isNotNull().alias("known"), F.coalesce(F.col("before") == F.col("split"), F.lit(False)).alias("same_split"))


def p5_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits that the first half of the rows name are taken over, then all rows come: what joins, and what is quarantined."""
    rows = table(spark, sf_dir, "fixture")
    first = _reloaded(adopt_splits(_early(rows), split_name(F.col("split"))), spark)
    groups = assign_splits(rows, table(spark, sf_dir, "split_targets"), first).groups
    kept = groups.groupBy("root_group_id").agg(F.max(F.when(F.col("status") == "kept", F.col("split"))).alias("known_split"))
    return groups.join(kept, "root_group_id").select("group_id", "root_group_id", "status", "known_split", "records")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(p7_ids(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("edits = 0 and window = 12").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(table(spark, sf_dir, "documents"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))[0]


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))[1]


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_RECORDS = """
  SELECT row_id, lower(trim(any_value(source))) AS s, lower(trim(any_value(label_source))) AS l, coalesce(any_value(weight), 1.0) AS weight,
         any_value(meta) AS meta
  FROM fixture WHERE row_id IS NOT NULL GROUP BY row_id"""
_CLAIMS = r"""
  SELECT row_id, coalesce(group_id, row_id) AS g, epoch_us(ingested_at) < (SELECT (epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2 FROM fixture) AS early,
    CASE WHEN lower(trim(split)) IN ('validation', 'dev') THEN 'val' ELSE lower(trim(split)) END AS split,
    CASE WHEN group_id IS NOT NULL AND json_valid(state) AND json_type(state) = 'OBJECT' THEN nullif(trim(regexp_replace(lower(state->>'$.claim'), '[^\p{L}\p{N}_]+', ' ', 'g')), '') END AS k
  FROM fixture WHERE row_id IS NOT NULL"""
# The fill of a first run: components of several records one by one, those of one record by hash parts (small tables: more than 1 / 16,384 of all records is several).
_FILLED = f"""
r AS ({_CLAIMS}),
c AS (SELECT DISTINCT g, k FROM r WHERE k IS NOT NULL),
e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM c x JOIN c y USING (k) WHERE x.g <> y.g),
w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
root AS (SELECT z.g, least(z.g, coalesce(min(w.b), z.g)) AS croot FROM (SELECT DISTINCT g FROM r) z LEFT JOIN w ON w.a = z.g GROUP BY z.g),
z AS (SELECT croot, count(DISTINCT (r.g, r.row_id)) AS n FROM r JOIN root USING (g) GROUP BY croot),
t AS (SELECT list(split ORDER BY split) AS names, list(target_share / (SELECT sum(target_share) FROM split_targets) * (SELECT sum(n)::DOUBLE FROM z) ORDER BY split) AS want FROM split_targets),
big AS (SELECT croot, n, row_number() OVER (ORDER BY n DESC, md5(croot)) AS i FROM z WHERE n > greatest(1.0, (SELECT sum(n) FROM z) / 16384.0)),
f(i, croot, s, lacks) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, want FROM t
  UNION ALL SELECT big.i, big.croot, p.s, list_transform(lacks, lambda x, j: CASE WHEN j = p.s THEN x - big.n ELSE x END)
  FROM f JOIN big ON big.i = f.i + 1, LATERAL (SELECT len(lacks) + 1 - list_position(list_reverse(lacks), list_max(lacks)) AS s) p),
last AS (SELECT names, lacks FROM f, t ORDER BY i DESC LIMIT 1),
o AS (SELECT list(x.s ORDER BY x.l DESC, x.s) AS names, list(greatest(x.l, 0) ORDER BY x.l DESC, x.s) AS lacks FROM (SELECT unnest(names) AS s, unnest(lacks) AS l FROM last) x),
b AS (SELECT bucket, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY bucket) AS i FROM (SELECT ('0x' || substr(md5('split:' || croot), 1, 3))::INT AS bucket FROM z ANTI JOIN big USING (croot)) GROUP BY bucket),
h(i, bucket, k, lacks) AS (
  SELECT 0::BIGINT, -1, 1, lacks FROM o
  UNION ALL SELECT b.i, b.bucket, p.k, list_transform(lacks, lambda x, j: CASE WHEN j = p.k THEN x - b.n ELSE x END)
  FROM h JOIN b ON b.i = h.i + 1, LATERAL (SELECT CASE WHEN h.k < 2 AND lacks[1] < b.n / 2 THEN CASE WHEN lacks[2] < b.n / 2 THEN 3 ELSE 2 END WHEN h.k = 2 AND lacks[2] < b.n / 2 THEN 3 ELSE h.k END AS k) p),
s AS (SELECT croot, names[s] AS split FROM f, last WHERE i > 0
  UNION ALL SELECT croot, o.names[h.k] FROM z ANTI JOIN big USING (croot) JOIN h ON h.bucket = ('0x' || substr(md5('split:' || croot), 1, 3))::INT, o)"""
_WORDS = r"""
k AS (SELECT * FROM fixture WHERE row_id IS NOT NULL AND state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ord) = 1),
j AS (SELECT row_id, split, source, state, CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state END AS j FROM k),
v AS (SELECT row_id, string_agg(CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.text' ELSE e->>'$' END, ' ') AS t FROM (
  SELECT row_id, unnest(from_json(json_extract(j, '$.evidence'), '["JSON"]')) AS e FROM j WHERE json_type(j, '$.evidence') = 'ARRAY') GROUP BY row_id),
c AS (SELECT j.row_id, CASE WHEN lower(trim(split)) IN ('validation', 'dev') THEN 'val' ELSE lower(trim(split)) END AS split, lower(trim(source)) AS source,
    CASE WHEN j IS NULL THEN state ELSE concat_ws(' ', j->>'$.claim', t) END AS content FROM j LEFT JOIN v USING (row_id)),
s AS (SELECT row_id, split, source, list_sort(list_distinct(list_transform(regexp_extract_all(nfc_normalize(content), '[\p{L}\p{N}]+'), lambda w: lower(w)))) AS s FROM c),
w AS (SELECT row_id, split, len(s) AS n, unnest(s) AS w FROM s),
p AS (SELECT a.row_id AS a, b.row_id AS b, a.split AS sa, b.split AS sb, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM w a JOIN w b USING (w) WHERE a.row_id < b.row_id GROUP BY ALL HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
x AS (SELECT * FROM p WHERE (sa = 'train' AND sb IN ('val', 'test')) OR (sb = 'train' AND sa IN ('val', 'test')))"""
SQL = {
    "p1_found": f"WITH {_WORDS.strip()} SELECT a AS row_id_a, b AS row_id_b FROM p",
    "p1_groups": f"""WITH RECURSIVE {_WORDS.strip()}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS m FROM r GROUP BY a), l AS (SELECT e.a, count(DISTINCT y.s) FILTER (y.s <> x.s) AS n FROM e JOIN s x ON x.row_id = e.a JOIN s y ON y.row_id = e.b GROUP BY e.a)
SELECT z.row_id, least(z.row_id, coalesce(g.m, z.row_id)) AS group_row_id, coalesce(l.n, 0) AS n_links FROM (SELECT DISTINCT row_id FROM fixture WHERE row_id IS NOT NULL) z LEFT JOIN g ON g.a = z.row_id LEFT JOIN l ON l.a = z.row_id""",
    "p6_found": f"WITH {_WORDS.strip()} SELECT a AS row_id_a, b AS row_id_b FROM x",
    "p6_report": f"""WITH {_WORDS.strip()}, h AS (SELECT CASE WHEN sa = 'train' THEN b ELSE a END AS row_id, count(*) AS n, max(similarity) AS m FROM x GROUP BY ALL)
SELECT split, source, count(*) AS records, count(n) AS overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs, max(m) AS highest FROM c LEFT JOIN h USING (row_id) WHERE split IN ('val', 'test') GROUP BY ALL""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_balance": f"""
WITH r AS ({_RECORDS}),
m AS (SELECT t.source, t.label_source, t.target_share, t.max_repeat, count(r.row_id) AS records, coalesce(sum(r.weight), 0) AS w FROM mix_targets t LEFT JOIN r ON r.s = lower(trim(t.source)) AND r.l = lower(trim(t.label_source)) GROUP BY ALL),
e AS (SELECT *, CASE WHEN w > 0 THEN least(max_repeat, target_share * sum(w) OVER () / w) ELSE 0 END AS ratio FROM m)
SELECT source, label_source, records, round(w, 6) AS weight, round(w * ratio, 6) AS expected, CAST(floor(ratio + 1e-12) AS INTEGER) AS least_copies, true AS weight_met, true AS words_met, true AS draws_met, true AS copies_met FROM e""",
    "p3_bounds": f"""
WITH r AS ({_RECORDS}),
c AS (SELECT r.row_id, r.s, lower(trim(k.label)) AS l, coalesce(nullif(lower(trim(r.meta->>'$.arm')), ''), 'plain') AS a
      FROM r JOIN label_map k ON r.s = lower(trim(k.source)) AND lower(trim(r.meta->>'$.label')) = lower(trim(k.native_label))),
m AS (SELECT t.source, t.label, t.arm, t.target_share, t.min_rows, count(DISTINCT c.row_id) AS available
      FROM category_targets t LEFT JOIN c ON c.s = lower(trim(t.source)) AND c.l = lower(trim(t.label)) AND c.a = lower(trim(t.arm)) GROUP BY ALL),
z AS (SELECT 0.25 * sum(available) AS size FROM m)
SELECT source, label, arm, available, least(min_rows, available) AS least, round(greatest(min_rows, target_share * size), 6) AS asked, true AS within, CAST(greatest(round(size - 1e-9), (SELECT sum(least(min_rows, available)) FROM m)) AS BIGINT) AS total FROM m, z""".replace(" AS least,", ' AS "least",').replace(" AS within,", ' AS "within",'),
    "p2_found": f"""
WITH r AS ({_RECORDS}),
m AS (SELECT t.source, t.label_source, t.target_share, t.max_repeat, coalesce(sum(r.weight), 0) AS w
      FROM mix_targets t LEFT JOIN r ON r.s = lower(trim(t.source)) AND r.l = lower(trim(t.label_source)) GROUP BY ALL)
SELECT source, label_source FROM m WHERE w * max_repeat < target_share * (SELECT sum(w) FROM m)""",
    "p3_found": f"""
WITH r AS ({_RECORDS}),
c AS (SELECT r.row_id, r.s, lower(trim(k.label)) AS l, coalesce(nullif(lower(trim(r.meta->>'$.arm')), ''), 'plain') AS a
      FROM r JOIN label_map k ON r.s = lower(trim(k.source)) AND lower(trim(r.meta->>'$.label')) = lower(trim(k.native_label))),
m AS (SELECT t.source, t.label, t.arm, t.target_share, t.min_rows, count(DISTINCT c.row_id) AS n
      FROM category_targets t LEFT JOIN c ON c.s = lower(trim(t.source)) AND c.l = lower(trim(t.label)) AND c.a = lower(trim(t.arm)) GROUP BY ALL)
SELECT source, label, arm FROM m WHERE n < min_rows OR n < target_share * (0.25 * (SELECT sum(n) FROM m))""",
    "p5_found": f"""
WITH RECURSIVE c AS (SELECT DISTINCT g, k FROM ({_CLAIMS}) WHERE k IS NOT NULL),
e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM c x JOIN c y USING (k) WHERE x.g <> y.g),
w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a)
SELECT a AS group_id, least(a, min(b)) AS root_group_id FROM w GROUP BY a""",
    "p5_splits": f"""WITH RECURSIVE {_FILLED.strip()}
SELECT r.row_id, s.split FROM (SELECT DISTINCT row_id, g FROM r) r JOIN root USING (g) JOIN s USING (croot)""",
    "p5_shares": "SELECT split, round(target_share / sum(target_share) OVER (), 2) AS share FROM split_targets",
    "p5_second_run": f"""WITH r AS ({_CLAIMS})
SELECT g AS group_id, count(DISTINCT row_id) AS records, bool_or(early) AS known, bool_or(early) AS same_split FROM r GROUP BY g""",
    "p5_quarantine": f"""
WITH RECURSIVE r AS ({_CLAIMS}),
old AS (SELECT g, min(split) AS split FROM r WHERE early GROUP BY g HAVING min(split) = max(split)),
sc AS (SELECT DISTINCT k, g, old.split FROM r JOIN old USING (g) WHERE early AND k IS NOT NULL),
own AS (SELECT DISTINCT k, g, old.split FROM r LEFT JOIN old USING (g) WHERE k IS NOT NULL),
contested AS (SELECT k FROM sc GROUP BY k HAVING min(split) <> max(split)),
clashing AS (SELECT k FROM (SELECT k, split FROM sc UNION ALL SELECT k, split FROM own WHERE split IS NOT NULL) GROUP BY k HAVING min(split) <> max(split)),
known AS (SELECT * FROM sc UNION SELECT * FROM own WHERE split IS NULL OR k NOT IN (SELECT k FROM clashing)),
tainted AS (SELECT DISTINCT g FROM known WHERE split IS NULL AND k IN (SELECT k FROM contested)),
free AS (SELECT * FROM known WHERE k NOT IN (SELECT k FROM contested) AND g NOT IN (SELECT g FROM tainted)),
e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM free x JOIN free y USING (k) WHERE x.g <> y.g),
w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
n AS (SELECT z.g, any_value(z.split) AS split, least(z.g, coalesce(min(w.b), z.g)) AS comp FROM (SELECT DISTINCT r.g, old.split FROM r LEFT JOIN old USING (g)) z LEFT JOIN w ON w.a = z.g GROUP BY z.g),
p AS (SELECT comp, min(split) AS lo, max(split) AS hi FROM n GROUP BY comp),
touched AS (SELECT DISTINCT n.comp FROM free JOIN n USING (g) WHERE k IN (SELECT k FROM known WHERE g IN (SELECT g FROM tainted))),
q AS (SELECT n.g, n.split, n.comp, p.lo, p.lo <> p.hi AS clash, n.split IS NULL AND (n.g IN (SELECT g FROM tainted) OR coalesce(p.lo <> p.hi, false) OR (p.lo IS NULL AND n.comp IN (SELECT comp FROM touched))) AS out
      FROM n JOIN p USING (comp))
SELECT q.g AS group_id, CASE WHEN out OR coalesce(clash, false) THEN q.g ELSE comp END AS root_group_id, CASE WHEN out THEN 'quarantined' WHEN q.split IS NOT NULL THEN 'kept' ELSE 'new' END AS status,
  CASE WHEN out THEN NULL WHEN q.split IS NOT NULL THEN q.split ELSE lo END AS known_split, c.records FROM q JOIN (SELECT g, count(DISTINCT row_id) AS records FROM r GROUP BY g) c USING (g)""",
}


def oracle_sql() -> dict:
    return dict(SQL)
