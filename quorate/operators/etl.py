"""Building decision records: labels, deduplication, groups, caps and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.runtime import materialize
from .components import connected_components


def hash_order(seed: int, *columns: str) -> Column:
    """A permutation that depends on seed and keys alone, the same in other engines: md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def native_labels(rows: DataFrame, label_map: DataFrame, source: str = "source", label: str = "native") -> DataFrame:
    """Rows with their common label; those whose native label has no entry are dropped."""
    m = label_map.select(F.lower(F.trim("source")).alias("_s"), F.lower(F.trim("native_label")).alias("_n"), F.col("label").alias("common"))
    keyed = rows.withColumn("_s", F.lower(F.trim(source))).withColumn("_n", F.lower(F.trim(label)))
    return keyed.join(m.where("_s is not null and _n is not null").dropDuplicates(["_s", "_n"]), ["_s", "_n"]).drop("_s", "_n")


def one_hot_labels(label: Column, space: list[str]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(x) for x in space)), F.array(*(F.when(label == x, 1.0).otherwise(0.0) for x in space)))


def claim_and_texts(state: Column) -> tuple[Column, Column]:
    """The claim of a JSON state, and its evidence texts without titles."""
    v = F.try_parse_json(state)
    items = F.coalesce(F.try_variant_get(v, "$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda e: F.substring_index(F.schema_of_variant(e), "<", 1)
    texts = F.transform(items, lambda e: F.when(kind(e) == "OBJECT", F.try_variant_get(e, "$.text", "string")).otherwise(F.try_variant_get(e, "$", "string")))
    return F.try_variant_get(v, "$.claim", "string"), F.filter(texts, lambda t: t.isNotNull())


def deduplicated(rows: DataFrame, key: Column, order: str = "ord", row_id: str = "row_id") -> DataFrame:
    """The first row of each key by (order, row_id), with dup_count (null if alone) and the ids it replaces, in order.

    One aggregation: of equal rows one stays. A key that holds a large part of the rows makes
    one long list of ids, as it is asked for.
    """
    place = F.struct(F.col(order).alias("o"), F.col(row_id).alias("r"))
    groups = rows.groupBy(F.sha2(key, 256).alias("_k")).agg(F.min_by(F.struct(*rows.columns), place).alias("_first"), F.array_sort(F.collect_list(place)).alias("_all"))
    n = F.size("_all")
    dropped = F.when(n > 1, F.transform(F.slice("_all", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: x["r"]))
    return groups.select("_first.*", dropped.alias("dropped_row_ids"), F.when(n > 1, n.cast("bigint")).alias("dup_count"))


def dedupe_key(state: Column, row_id: Column) -> Column:
    """Claim and evidence texts of a JSON state, else the text, normalised; the row's own id where nothing is left to compare."""
    claim, texts = claim_and_texts(state)
    plain = F.nullif(text.norm_claim(F.coalesce(state, F.lit(""))), F.lit(""))
    return F.when(claim.isNotNull(), text.dedupe_key(claim, texts)).when(plain.isNotNull(), F.concat(F.lit("text "), plain)).otherwise(F.concat(F.lit("row "), row_id))


def claim_evidence(rows: DataFrame) -> DataFrame:
    """rows with claim and evidence texts; a state without a claim is an error that names the row."""
    claim, texts = claim_and_texts(F.col("state"))
    told = F.when(claim.isNull(), F.raise_error(F.concat(F.lit("no claim and evidence: "), F.coalesce("row_id", F.lit("?"))))).otherwise(claim)
    return rows.withColumn("claim", told).withColumn("texts", texts)


def selected(rows: DataFrame, **wanted: str | list[str] | None) -> DataFrame:
    """Rows whose columns (split, source, label_source, ...) have one of the wanted values, trimmed and lower-cased; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.lower(F.trim(column)).isin([value] if isinstance(value, str) else list(value)))
    return rows


def claim_components(rows: DataFrame, claim: Column, group: str = "group_id") -> DataFrame:
    """(group_id, component): groups connected by an equal normalised claim; the smallest group names the component."""
    keyed = rows.select(F.col(group).alias("g"), text.norm_claim(claim).alias("c")).where("g is not null and c <> ''").distinct()
    least = keyed.groupBy("c").agg(F.min("g").alias("m"), F.max("g").alias("x")).where("m <> x")
    edges = keyed.join(least, "c").where("g <> m").select(F.col("g").alias("a"), F.col("m").alias("b"))
    roots = connected_components(edges)
    return keyed.select("g").distinct().join(roots, F.col("g") == F.col("node"), "left").select(F.col("g").alias(group), F.coalesce("root", "g").alias("component"))


def _folded(sizes: DataFrame, key: str, seed: int, most: int, fold, schema: str, state: list):
    """Goes through (key, n) in hash order in a sequence of hash ranges of about `most` keys, one task each; yields each range's rows.

    fold(pdf of h, k, n; state) gives the rows and the state for the next range, or None to
    stop. Only the state crosses the driver, so the rule is exact for any number of keys and
    no task holds more than a range.
    """
    spark = sizes.sparkSession
    keyed = sizes.select(hash_order(seed, key).alias("h"), F.col(key).cast("string").alias("k"), F.col("n").cast("double").alias("n"))
    keyed, count = materialize(keyed.withColumn("p", F.conv(F.substring("h", 1, 6), 16, 10).cast("bigint")), "keyed", rows=True)
    parts = max(1, -(-count // most))
    for i in range(parts):
        part = keyed if parts == 1 else keyed.where((F.col("p") >= i * 2**24 // parts) & (F.col("p") < (i + 1) * 2**24 // parts))
        at = list(state)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows, after = fold(pdf.sort_values(["h", "k"]), at)
            end = pd.DataFrame([{"_end": True, "_state": None if after is None else [float(x) for x in after]}])
            return pd.concat([rows.assign(_end=False, _state=None), end], ignore_index=True)

        done = materialize(part.drop("p").groupBy().applyInPandas(run, schema + ", _end boolean, _state array<double>"), "folded")
        yield done.where("not _end").drop("_end", "_state")
        last = done.where("_end").select("_state").first()
        if last is None:  # an empty range
            continue
        if last[0] is None:
            return
        state = list(last[0])


def greedy_splits(sizes: DataFrame, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42, key: str = "component", most: int = 2_000_000) -> DataFrame:
    """Components in hash order go one by one to the split that lacks most; the first of equal lacks.

    The rule is sequential: (component, size), and nothing else, pass in hash ranges of about
    `most` components, and the splits' counts are handed from range to range.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    targets = [r * total for r in ratios]

    def fold(pdf: pd.DataFrame, counts: list[float]):
        out = []
        for n in pdf["n"].tolist():
            lacks = [t - c for t, c in zip(targets, counts)]
            i = lacks.index(max(lacks))
            counts[i] += n
            out.append(names[i])
        return pd.DataFrame({key: pdf["k"], "split": out}), counts

    out = None
    for part in _folded(sizes, key, seed, most, fold, f"`{key}` string, split string", [0.0] * len(targets)):
        out = part if out is None else out.unionByName(part)
    return out


def capped_groups(rows: DataFrame, most: int, seed: int = 42, group: str = "group_id", order: str = "ord", at_once: int = 2_000_000) -> DataFrame:
    """At most `most` rows without splitting groups: in hash order a group that would overflow is skipped, unless it is the first.

    An oversized first group is cut by order. Only the groups' sizes pass through the
    sequential rule, in hash ranges of about at_once groups, and none once the cap is reached.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= most:
        return rows

    def fold(pdf: pd.DataFrame, state: list[float]):
        taken, out = state[0], []
        for k, n in pdf[["k", "n"]].itertuples(index=False):
            if taken and taken + n > most:
                continue
            out.append(k)
            taken += n
            if taken >= most:
                return pd.DataFrame({group: pd.Series(out, dtype=object)}), None
        return pd.DataFrame({group: pd.Series(out, dtype=object)}), [taken]

    kept = None
    for part in _folded(sizes, group, seed, at_once, fold, f"`{group}` string", [0.0]):
        kept = part if kept is None else kept.unionByName(part)
    # A null group is a group too.
    out = rows.join(kept.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    return out.orderBy(order).limit(most) if out.count() > most else out


def ratio_splits(keys: DataFrame, key: str, ratios: tuple[float, float] = (0.8, 0.1), seed: int = 43) -> DataFrame:
    """(key, split) by place in hash order: the first int(r0 n) train, the next int(r1 n) val, the rest test.

    Places come from counts of hash prefixes and ranks inside one prefix, so that no task
    sorts all keys.
    """
    one = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("h", hash_order(seed, key))
    one = one.withColumn("p", F.substring("h", 1, 3))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = one.groupBy("p").agg(F.count(F.lit(1)).alias("m")).withColumn("s", F.coalesce(F.sum("m").over(before), F.lit(0)))  # at most 4096 rows
    n = F.lit(one.count())
    placed = one.join(F.broadcast(starts), "p").withColumn("i", F.col("s") + F.row_number().over(Window.partitionBy("p").orderBy("h", key)) - 1)
    a = F.floor(n * F.lit(ratios[0]))
    b = a + F.floor(n * F.lit(ratios[1]))
    return placed.select(key, F.when(F.col("i") < a, "train").when(F.col("i") < b, "val").otherwise("test").alias("split"))


def carve(rows: DataFrame, share: float = 0.15, seed: int = 42, group: str = "group_id") -> DataFrame:
    """Groups in hash order up to int(share n) rows; the last one may overshoot. Returns (group, n)."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    keyed = sizes.withColumn("h", hash_order(seed, group)).withColumn("p", F.substring("h", 1, 3))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("p").agg(F.sum("n").alias("m")).withColumn("s", F.coalesce(F.sum("m").over(before), F.lit(0)))  # at most 4096 rows
    inside = Window.partitionBy("p").orderBy("h", group).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.join(F.broadcast(starts), "p").withColumn("sofar", F.col("s") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return run.where(F.col("sofar") < int(total * share)).select(group, "n")


def without_carve(rows: DataFrame, groups: DataFrame, ids: DataFrame, group: str = "group_id", gt: Column | None = None) -> DataFrame:
    """Rows whose group isn't carved and whose ground-truth id isn't; rows with null keys stay."""
    gt = F.coalesce(F.get_json_object("meta", "$.gt_row_id"), F.col("row_id")) if gt is None else gt
    kept = rows.join(groups.select(group), group, "left_anti").withColumn("_gt", gt)
    return kept.join(ids.select(F.col("row_id").alias("_gt")), "_gt", "left_anti").drop("_gt")
