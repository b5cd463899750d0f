"""Samples that match target category proportions: allocation down a category tree, draws by permuted dense rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .mixing import key_of


@dataclass(frozen=True)
class Params:
    """fraction: size of the sample as a share of the eligible records. ranges: hash ranges of
    a leaf that are counted; only the range where the quota ends is ranked. most_targets:
    rows of the target table that the driver takes.
    """

    fraction: float = 0.25
    ranges: int = 4096
    most_targets: int = 100_000
    seed: int = 29


def _fit(total: float, share: list[float], low: list[float], high: list[float]) -> list[float]:
    """Parts proportional to share, each within its bounds, that add up to total as far as the bounds let them."""
    if total <= sum(low):
        return list(low)
    if total >= sum(high):
        return list(high)
    weight = [s if s > 0 else 1e-12 for s in share]
    lo, hi = 0.0, max(h / w for h, w in zip(high, weight)) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(h, max(b, mid * w)) for w, b, h in zip(weight, low, high)) < total:
            lo = mid
        else:
            hi = mid
    return [min(h, max(b, hi * w)) for w, b, h in zip(weight, low, high)]


def allocate(leaves: list[tuple[tuple[str, ...], float, int, int]], total: float) -> list[int]:
    """Quotas of the leaves (path, share, least, available), handed down a tree of their paths.

    A node's children divide its quota by their shares, none above what its subtree holds nor
    below what its leaves must have. So what one leaf lacks goes first to its siblings, and
    only what those cannot give either goes a level up, to the cousins. Shares are rounded by
    largest remainder.
    """
    quota = [0.0] * len(leaves)

    def down(nodes: list[int], depth: int, size: float) -> None:
        if depth == len(leaves[nodes[0]][0]):
            for k, x in zip(nodes, _fit(size, [leaves[k][1] for k in nodes], [min(leaves[k][2], leaves[k][3]) for k in nodes], [leaves[k][3] for k in nodes])):
                quota[k] = x
            return
        by: dict[str, list[int]] = {}
        for k in nodes:
            by.setdefault(leaves[k][0][depth], []).append(k)
        groups = list(by.values())
        parts = _fit(size, *([sum(f(leaves[k]) for k in g) for g in groups] for f in (lambda x: x[1], lambda x: min(x[2], x[3]), lambda x: x[3])))
        for g, x in zip(groups, parts):
            down(g, depth + 1, x)

    if leaves:
        down(list(range(len(leaves))), 0, total)
    whole = [int(q + 1e-9) for q in quota]
    spare = int(round(min(sum(quota), total if total > sum(whole) else sum(quota)))) - sum(whole)
    for k in sorted(range(len(leaves)), key=lambda k: (whole[k] - quota[k], leaves[k][0])):
        if spare > 0 and whole[k] < leaves[k][3] and quota[k] - whole[k] > 1e-9:
            whole[k] += 1
            spare -= 1
    return whole


@dataclass
class Sample:
    chosen: DataFrame  #: row_id, source, label, arm
    report: DataFrame  #: one row per target row, with what it asked, had and got


def categories(records: DataFrame, label_map: DataFrame) -> DataFrame:
    """(row_id, s, l, a): keys of source, common label (label_map of meta.label) and arm (`plain` if meta has none)."""
    meta = F.when(F.col("meta").isNotNull(), F.col("meta"))
    rows = records.where("row_id is not null").select(
        "row_id", key_of("source").alias("s"), key_of(F.get_json_object(meta, "$.label")).alias("native"), F.coalesce(F.nullif(key_of(F.get_json_object(meta, "$.arm")), F.lit("")), F.lit("plain")).alias("a")
    )
    names = label_map.select(key_of("source").alias("s"), key_of("native_label").alias("native"), key_of("label").alias("l")).where("s is not null and native is not null")
    names = names.groupBy("s", "native").agg(F.min("l").alias("l"))
    return rows.join(names, ["s", "native"]).select("row_id", "s", "l", "a")


def quota_sample(records: DataFrame, label_map: DataFrame, targets: DataFrame, params: Params = Params()) -> Sample:
    """A sample of records (row_id, source, meta) whose shares by source, label and arm follow targets.

    Its size is fraction x the records of any target category. Each category asks for its
    share and at least min_rows; what it cannot give is passed on by `allocate`. A leaf's
    records are permuted by a hash of their id and those up to its quota in dense rank are
    drawn, so that a record delivered twice takes one place. Only totals of the
    categories reach the driver, and only the range where a quota ends is ranked, whatever a leaf's size.

    Null sources, labels without an entry in label_map and unmatched categories take no part;
    null min_rows and shares are 0; target rows of one key are added up. Empty tables give an
    empty sample and a report of zeros.
    """
    spark, p = records.sparkSession, params
    wanted = targets.groupBy(key_of("source").alias("s"), key_of("label").alias("l"), key_of("arm").alias("a")).agg(
        F.min("source").alias("source"), F.min("label").alias("label"), F.min("arm").alias("arm"),
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.sum(F.coalesce("min_rows", F.lit(0))).alias("least"),
    )
    plan = wanted.where("s is not null and l is not null and a is not null").orderBy("s", "l", "a").limit(p.most_targets + 1).collect()
    if len(plan) > p.most_targets:
        raise ValueError(f"more than {p.most_targets} target rows")
    keys = spark.createDataFrame([(r.s, r.l, r.a, k) for k, r in enumerate(plan)], "s string, l string, a string, target int")
    rows = categories(records, label_map).join(F.broadcast(keys), ["s", "l", "a"]).groupBy("row_id").agg(F.min("target").alias("target"))
    ranges = min(p.ranges, max(1, 2_000_000 // max(1, len(plan))))  # so that the counts stay few for any number of targets
    place = F.xxhash64(F.lit(p.seed), "row_id")
    rows = rows.select("target", "row_id", place.alias("place"), F.pmod(F.shiftrightunsigned(place, 20), F.lit(ranges)).cast("int").alias("range"))
    rows = materialize(rows, "sample_rows")
    counts = rows.groupBy("target", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("target").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # p.ranges rows a target
    counts = materialize(counts.withColumn("taken", before), "sample_counts")
    found = {r.target: r.n for r in counts.groupBy("target").agg(F.sum("n").alias("n")).collect()}  # a row a target
    there = [found.get(k, 0) for k in range(len(plan))]
    size = p.fraction * sum(there)
    quota = allocate([((r.s, r.l), float(r.share), int(r.least), n) for r, n in zip(plan, there)], size)
    lines = []
    for k, r in enumerate(plan):
        ask = max(float(r.least), float(r.share) * size)
        short = there[k] < r.least or there[k] < float(r.share) * size
        lines.append((k, r.source, r.label, r.arm, float(r.share), int(r.least), there[k], ask, short))
    # The range where each quota ends, one row a target.
    quotas = F.broadcast(spark.createDataFrame([(k, int(q)) for k, q in enumerate(quota)], "target int, quota bigint"))
    ends = counts.join(quotas, "target").where("taken + n > quota").groupBy("target").agg(F.min(F.struct("range", (F.col("quota") - F.col("taken")).alias("more"))).alias("e"))
    cut = quotas.join(ends, "target", "left").select("target", F.coalesce("e.range", F.lit(ranges)).alias("end"), F.coalesce("e.more", F.lit(0)).alias("more"))
    rows = rows.join(F.broadcast(cut), "target")
    last = rows.where(F.col("range") == F.col("end")).withColumn("rank", F.dense_rank().over(Window.partitionBy("target", "range").orderBy("place", "row_id")))
    drawn = rows.where(F.col("range") < F.col("end")).select("row_id", "target").unionByName(last.where("rank <= more").select("row_id", "target"))
    lined = spark.createDataFrame(lines, "target int, source string, label string, arm string, target_share double, min_rows int, available bigint, asked double, short boolean")
    got = drawn.groupBy("target").agg(F.count(F.lit(1)).alias("drawn"))
    report = lined.join(got, "target", "left")
    whole = max(1, sum(quota))
    report = report.select("source", "label", "arm", "target_share", "min_rows", "available", "asked", "short", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.coalesce("drawn", F.lit(0)) / F.lit(float(whole))).alias("share"))
    return Sample(drawn.join(F.broadcast(lined.select("target", "source", "label", "arm")), "target").select("row_id", "source", "label", "arm"), report)


def bounds(sample: Sample) -> DataFrame:
    """(source, label, arm, available, least, asked, within, total): whether each draw lies between what the category must and can give, and the whole sample."""
    whole = sample.report.agg(F.sum("drawn").alias("total"))
    low = F.least(F.col("min_rows").cast("bigint"), F.col("available"))
    rows = sample.report.crossJoin(F.broadcast(whole))  # one row
    return rows.select("source", "label", "arm", "available", low.alias("least"), F.round("asked", 6).alias("asked"), F.col("drawn").between(low, F.col("available")).alias("within"), "total")
