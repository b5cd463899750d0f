"""Queries of the flat tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import children, flat_tables
from ..plans.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(table(spark, sf_dir, "fixture"))


def _flat(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(flat_tables(table(spark, sf_dir, "fixture")), name)

    return query


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without raw, which keeps an element's JSON in sorted keys."""
    return flat_tables(table(spark, sf_dir, "fixture")).evidence.drop("raw")


QUERIES = {"p4_found": p4_found, "p4_evidence": p4_evidence} | {f"p4_{x}": _flat(x) for x in ("records", "questions", "criteria", "labels", "meta")}

_STATE = "CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN state END"
_EVIDENCE = f"""
  SELECT row_id, ord, i - 1 AS pos, CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.title' END AS title,
         CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' WHEN 'OBJECT' THEN e->>'$.text' END AS text, e
  FROM (SELECT row_id, ord, unnest(l) AS e, generate_subscripts(l, 1) AS i
        FROM (SELECT row_id, ord, from_json(json_extract({_STATE}, '$.evidence'), '["JSON"]') AS l FROM fixture
              WHERE json_type({_STATE}, '$.evidence') = 'ARRAY'))"""
_QUESTIONS = """
  SELECT row_id, ord, i - 1 AS pos, q.key AS question_id, q.value.kind AS kind, q.value.instructions AS instructions, q.value.criteria AS criteria
  FROM (SELECT row_id, ord, unnest(m) AS q, generate_subscripts(m, 1) AS i FROM (SELECT row_id, ord, map_entries(questions) AS m FROM fixture))"""
_LABELS = """
  SELECT row_id, ord, question_id, i - 1 AS pos, e.key AS label, e.value AS probability
  FROM (SELECT row_id, ord, question_id, unnest(m) AS e, generate_subscripts(m, 1) AS i
        FROM (SELECT row_id, ord, l.key AS question_id, map_entries(l.value) AS m
              FROM (SELECT row_id, ord, unnest(map_entries(labels)) AS l FROM fixture)))"""
SQL = {
    "p4_found": f"""
SELECT DISTINCT row_id, child, child_key FROM (
  SELECT row_id, 'evidence' AS child, CAST(pos AS VARCHAR) AS child_key FROM ({_EVIDENCE}) WHERE text IS NOT NULL
  UNION ALL SELECT row_id, 'question', question_id FROM ({_QUESTIONS})
  UNION ALL SELECT row_id, 'label', question_id || '/' || label FROM ({_LABELS}))""",
    "p4_records": f"""
SELECT f.row_id, f.ord, s.j->>'$.claim' AS claim, CASE WHEN s.j IS NULL THEN f.state END AS plain_text, CAST(coalesce(e.n, 0) AS INTEGER) AS evidence_count,
  CAST(coalesce(len(map_entries(f.questions)), 0) AS INTEGER) AS question_count, CAST(coalesce(l.n, 0) AS INTEGER) AS label_count
FROM fixture f JOIN (SELECT ord, {_STATE} AS j FROM fixture) s USING (ord)
LEFT JOIN (SELECT ord, count(*) AS n FROM ({_EVIDENCE}) WHERE text IS NOT NULL GROUP BY ord) e USING (ord)
LEFT JOIN (SELECT ord, count(*) AS n FROM ({_LABELS}) GROUP BY ord) l USING (ord) WHERE f.row_id IS NOT NULL""",
    "p4_evidence": f"SELECT row_id, ord, CAST(pos AS INTEGER) AS pos, title, text FROM ({_EVIDENCE}) WHERE text IS NOT NULL",
    "p4_criteria": f"""
WITH q AS (SELECT * FROM ({_QUESTIONS}) WHERE json_valid(criteria))
SELECT row_id, ord, question_id, CAST(i - 1 AS INTEGER) AS pos, k AS option, criteria::JSON->>('$."' || k || '"') AS definition
FROM (SELECT *, unnest(json_keys(criteria)) AS k, generate_subscripts(json_keys(criteria), 1) AS i FROM q WHERE json_type(criteria) = 'OBJECT')
UNION ALL SELECT row_id, ord, question_id, CAST(i AS INTEGER), CAST(i AS VARCHAR), criteria::JSON->>('$[' || i || ']') FROM q, LATERAL (SELECT unnest(range(json_array_length(criteria)::BIGINT)) AS i) WHERE json_type(criteria) = 'ARRAY'""",
    "p4_meta": """
SELECT row_id, ord, k AS path, meta::JSON->>('$."' || k || '"') AS value FROM (
  SELECT row_id, ord, meta, unnest(json_keys(meta)) AS k FROM fixture WHERE row_id IS NOT NULL AND json_valid(meta) AND json_type(meta) = 'OBJECT')""",
    "p4_questions": f"SELECT row_id, ord, CAST(pos AS INTEGER) AS pos, question_id, kind, instructions, criteria FROM ({_QUESTIONS})",
    "p4_labels": f"SELECT row_id, ord, question_id, CAST(pos AS INTEGER) AS pos, label, probability FROM ({_LABELS})",
}

