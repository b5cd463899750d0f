"""Requests and answers of a decision service, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist


def request_problems(questions: Column) -> Column:
    """What is wrong with a request's questions (map of id to kind, instructions, criteria): names with the question's id."""
    kind = lambda q: F.lower(F.coalesce(q["kind"], F.lit("choice")))
    empty = lambda q: F.coalesce(F.trim(q["criteria"]).isin("", "{}", "[]", "null"), F.lit(True))
    each = F.transform(F.map_entries(questions), lambda e: F.when(~kind(e["value"]).isin("choice", "noul", "score"), F.concat(e["key"], F.lit(": unknown kind"))).when((kind(e["value"]) != "noul") & empty(e["value"]), F.concat(e["key"], F.lit(": no criteria"))))
    return F.when(questions.isNull() | (F.size(questions) == 0), F.array(F.lit("no questions"))).otherwise(F.array_compact(each))


def flat_state(state: Column) -> Column:
    """A JSON list of messages as its contents, one under another; any other state as it is."""
    v = F.try_parse_json(state)
    messages = F.try_variant_get(v, "$", "array<variant>")
    parts = F.transform(messages, lambda m: F.when(F.substring_index(F.schema_of_variant(m), "<", 1) == "OBJECT", F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit(""))))
    return F.when(F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1) == "ARRAY", F.lit(False)), F.array_join(parts, "\n")).otherwise(state)


def answers(rows: DataFrame) -> DataFrame:
    """rows (…, kind, answer) with the typed answers: choice, noul or score, of which the kind's is set."""
    a = F.col("answer")
    rounded = lambda x, n: F.bround(x, n)
    probs = F.transform(a, lambda e: dist.entry(e["label"], F.bround(e["p"], 6)))
    conf = rounded(dist.top(a), 4)
    return rows.select(
        "*",
        F.when(F.col("kind") == "choice", F.struct(dist.argmax(a).alias("choice"), probs.alias("probabilities"), conf.alias("confidence"))).alias("choice"),
        F.when(F.col("kind") == "noul", F.struct(rounded(dist.p_of(a, F.lit("yes")), 6).alias("noul"))).alias("noul"),
        F.when(F.col("kind") == "score", F.struct(rounded(dist.expected_score(a), 4).alias("score"), probs.alias("probabilities"), conf.alias("confidence"))).alias("score"),
    )


def flattened(rows: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in at)).alias(sep.join(at)))

    walk(rows.schema, [])
    return rows.select(*out)
