"""Questions, states and keys as text, Column to Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .dist import bind

#: Words that aren't text in this data: what marks an empty evidence list (fixed value).
EMPTY = "(none)"


def norm_claim(x: Column) -> Column:
    """Lower-cased, each run of other than letters, digits and _ one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " "))


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def canon(x: Column) -> Column:
    """NFC, straight quotes, white space collapsed, trimmed, lower-cased; null is ''."""
    straight = F.translate(nfc(F.coalesce(x, F.lit(""))), "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(straight, r"(?U)\s+", " ")))


def signature(claim: Column, lines: Column) -> Column:
    """sha256 of canonical claim and lines, in order."""
    return F.sha2(F.concat_ws("\u0000", F.array(claim), lines), 256)


def set_signature(claim: Column, lines: Column) -> Column:
    """The same of the lines as a multiset."""
    return signature(claim, F.array_sort(lines))


def dedupe_key(claim: Column, texts: Column) -> Column:
    """Normalised claim and the set of normalised texts, as one string."""
    norm = F.array_sort(F.array_distinct(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: norm_claim(F.coalesce(t, F.lit(""))))))
    return F.concat_ws("\u0000", F.array(norm_claim(F.coalesce(claim, F.lit("")))), norm)


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _first_line(lines: Column, fits) -> Column:
    """The number of the first line (from 0) that fits(line, number); null if none does."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(fits(x, i), i)), lambda i: i.isNotNull()))


def _from_line(lines: Column, number: Column) -> Column:
    return F.array_join(F.slice(lines, number + 1, F.greatest(F.size(lines) - number, F.lit(0))), "\n")


def parse_state(text: Column) -> Column:
    """struct(claim, evidence) of a rendered state; null if it doesn't begin with a claim and go on with an evidence list.

    The claim stands behind the heading of the first line and up to the line that the heading
    of the evidence begins. A line that starts with a number and a dot begins a passage.
    """

    def parsed(lines: Column) -> Column:
        head = _first_line(lines, lambda x, i: (i > 0) & F.ltrim(F.translate(x, "\t", " ")).startswith("Evidence:"))

        def parts(at: Column) -> Column:
            claim = stripped(F.substring(F.array_join(F.slice(lines, F.lit(1), F.greatest(at, F.lit(0))), "\n"), F.lit(len("Claim:") + 1), F.lit(2**31 - 1)))
            body = F.split(F.regexp_replace(_from_line(lines, at), r"^[ \t]*Evidence:", ""), "\n")
            marked = F.array_join(F.transform(body, lambda x: F.regexp_replace(x, r"^[ \t]*[0-9]+\.[ \t]+", "\u0001")), "\n")
            items = F.filter(F.transform(F.split(marked, "\u0001"), stripped), lambda s: s != "")
            nothing = (F.size(items) == 1) & (F.get(items, F.lit(0)) == EMPTY)
            return F.when(claim != "", F.struct(claim.alias("claim"), F.when(nothing, F.array().cast("array<string>")).otherwise(items).alias("evidence")))

        return F.when(F.get(lines, F.lit(0)).startswith("Claim:") & head.isNotNull(), bind(head, parts))

    return bind(F.split(F.regexp_replace(text, r"(?U)^\s+", ""), "\n"), parsed)


def parse_prompt(user: Column) -> Column:
    """The state behind the first line that is the heading State:, parsed."""

    def behind(lines: Column) -> Column:
        at = _first_line(lines, lambda x, i: F.trim(F.translate(x, "\t", " ")) == "State:")
        return F.when(at + 1 < F.size(lines), parse_state(_from_line(lines, at + 1)))

    return bind(F.split(user, "\n"), behind)


def rubric(text: Column) -> Column:
    """The levels of a rubric written as `number: text` lines, in numeric order; null unless they are 0, 1, 2 ..."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(\d+:\s+.+)$"), 1)
    rows = F.array_sort(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), F.regexp_extract(x, r"^\d+:\s+(.+)$", 1).alias("t"))))
    return F.when((F.size(rows) > 0) & F.forall(F.transform(rows, lambda r, i: r["n"] == i), lambda b: b), F.transform(rows, lambda r: r["t"]))


def selected_sentences(sentences: Column, index: Column) -> Column:
    """The sentences at the distinct indices, ascending, those out of range left out, joined by blanks."""
    kept = F.filter(F.array_sort(F.array_distinct(index)), lambda i: (i >= 0) & (i < F.size(sentences)))
    return F.array_join(F.transform(kept, lambda i: F.get(sentences, i)), " ")


def arm_name(file: Column) -> Column:
    """File stem without a leading preds_."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1), "^preds_", "")


def _choice(criteria: Column) -> Column:
    return F.map_entries(F.from_json(criteria, "map<string,string>"))


def options(kind: Column, criteria: Column) -> Column:
    """array<struct<label, definition>>: a question's answers in order; an empty definition is null."""
    pair = lambda label, d: F.struct(label.alias("label"), F.nullif(d, F.lit("")).alias("definition"))
    given = F.from_json(criteria, "map<string,string>")
    noul = F.transform(F.array(F.lit("yes"), F.lit("no")), lambda x: pair(x, F.try_element_at(given, x)))
    score = F.transform(F.from_json(criteria, "array<string>"), lambda d, i: pair(i.cast("string"), d))
    return F.when(kind == "noul", noul).when(kind == "choice", F.transform(_choice(criteria), lambda e: pair(e["key"], e["value"]))).when(kind == "score", score)


def label_space(kind: Column, criteria: Column) -> Column:
    return F.transform(options(kind, criteria), lambda o: o["label"])


def option_line(o: Column) -> Column:
    return F.concat(o["label"], F.coalesce(F.concat(F.lit(": "), o["definition"]), F.lit("")))


def question_text(instructions: Column, kind: Column, criteria: Column) -> Column:
    """Instructions, then a line for each label."""
    return F.array_join(F.concat(F.array(instructions), F.transform(options(kind, criteria), option_line)), "\n")


def option_texts(instructions: Column, kind: Column, criteria: Column) -> Column:
    """One text for each label: the trimmed instructions and the label's line."""
    head = F.regexp_replace(instructions, r"^\s+|\s+$", "")
    return F.transform(options(kind, criteria), lambda o: F.concat(head, F.lit("\n"), option_line(o)))


def _is_object(state: Column) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(F.try_parse_json(state)), "<", 1) == "OBJECT", F.lit(False))


def evidence_lines(state: Column) -> Column:
    """The evidence of a JSON state as `title: text` lines or bare texts, in order, with empty ones."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(state), "$.evidence", "array<variant>"), F.array().cast("array<variant>"))

    def line(v: Column) -> Column:
        kind = F.substring_index(F.schema_of_variant(v), "<", 1)
        title, text = F.try_variant_get(v, "$.title", "string"), F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))
        titled = F.concat(F.coalesce(F.concat(F.nullif(title, F.lit("")), F.lit(": ")), F.lit("")), text)
        return F.when(kind == "OBJECT", titled).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))

    return F.transform(items, line)


def state_text(state: Column) -> Column:
    """A state as text: claim, numbered evidence or (none); plain text as it is; other JSON with sorted keys.

    Keys besides claim and evidence follow as one JSON line with sorted keys.
    """
    v = F.try_parse_json(state)
    claim = F.try_variant_get(v, "$.claim", "string")
    lines = evidence_lines(state)
    numbered = F.when(F.size(lines) == 0, F.array(F.lit(EMPTY))).otherwise(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin("claim", "evidence"))
    fields = F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.concat(quoted(k), F.lit(":"), F.to_json(F.try_element_at(rest, k))))
    more = F.when(F.size(rest) > 0, F.array(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(F.concat(F.lit("Claim: "), claim), F.lit("Evidence:")), numbered, more), "\n")
    return F.when(_is_object(state) & claim.isNotNull(), whole).when(_is_object(state), F.to_json(v)).otherwise(state)


def user_text(instructions: Column, kind: Column, criteria: Column, state: Column) -> Column:
    """The question, then the state under a State: header."""
    return F.concat(question_text(instructions, kind, criteria), F.lit("\n\nState:\n"), state_text(state))


def eval_prompt(instructions: Column, kind: Column, criteria: Column, state: Column) -> Column:
    return F.concat(user_text(instructions, kind, criteria, state), F.lit("\n\nVerdict:"))


def quoted(x: Column) -> Column:
    """A string as JSON text; null is null."""
    one = F.to_json(F.array(x))
    return F.when(x.isNull(), "null").otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def premise(state: Column) -> Column:
    """All evidence lines of a state, one under another."""
    return F.array_join(evidence_lines(state), "\n")


def state_key(state: Column) -> Column:
    """A JSON state with sorted keys, or the text itself: equal for equal states."""
    return F.coalesce(F.to_json(F.try_parse_json(state)), state)


def cache_key(model: Column, state: Column, questions: Column) -> Column:
    """sha256 that names a request; questions are JSON text. Internal: equal only among this engine's keys."""
    return F.sha2(F.concat_ws("\u0000", model, state_key(state), state_key(questions)), 256)


def noul_keys(m: Column) -> Column:
    """yes and no for true and false, in a map's keys."""
    return F.transform_keys(m, lambda k, _: F.when(k == "true", "yes").when(k == "false", "no").otherwise(k))
