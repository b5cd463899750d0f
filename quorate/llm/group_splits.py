"""Splits that keep related records together, over an incremental table of components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.runtime import materialize

#: Parts of the hash range (three hexadecimal digits) that are cut between splits; the shares are met to about 1 / BUCKETS.
BUCKETS = 4096


def claim_of(state: Column) -> Column:
    """The claim of a JSON state, lower-cased, each run of other than letters, digits and _ one blank, trimmed.

    Null for plain-text states, missing claims and claims without any letter or digit.
    """
    text = F.regexp_replace(F.lower(F.get_json_object(state, "$.claim")), r"[^\p{L}\p{N}_]+", " ")
    return F.nullif(F.trim(text), F.lit(""))


@dataclass
class State:
    """What one run leaves for the next.

    claims has every pair of a claim and a component that holds it, or a quarantined group
    that does; seen every (record, group) that was counted; held the records that came to a
    known group with a claim of another split.
    """

    groups: DataFrame  #: group_id, root_group_id, split, linked, records, status
    claims: DataFrame  #: c1, c2, node, split, quarantined
    seen: DataFrame  #: group_id, row_id
    held: DataFrame  #: group_id, row_id

    def save(self, path: str) -> None:
        """Writes the tables to a folder of its own; a state that was loaded from it must go to another."""
        for name in ("groups", "claims", "seen", "held"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> State:
        return State(*(spark.read.parquet(f"{path}/{name}") for name in ("groups", "claims", "seen", "held")))


def _claim_rows(records: DataFrame) -> DataFrame:
    """(row_id, group_id, c1, c2): records, with the 128 hash bits of the claim they link by, or null."""
    claim = claim_of(F.col("state"))
    links = claim.isNotNull() & F.col("group_id").isNotNull()
    return records.where("row_id is not null").select(
        "row_id", F.coalesce("group_id", "row_id").alias("group_id"), F.when(links, F.xxhash64(claim)).alias("c1"), F.when(links, F.xxhash64(F.lit("second"), claim)).alias("c2")
    )


def adopt_splits(records: DataFrame, split: Column) -> State:
    """The state of records that have splits already, to go on from: groups whose records name one split keep it.

    Groups whose records name none or several are left out; assign_splits gives them one when
    they are delivered again. Groups that share a claim are not yet joined: the next run
    joins those of one split, and treats a claim of several splits as contested.
    """
    rows = _claim_rows(records.select("row_id", "group_id", "state")).join(records.where("row_id is not null").select("row_id", split.alias("split")).where("split is not null").distinct(), "row_id", "left")
    rows = materialize(rows, "adopted_rows")
    groups = rows.groupBy("group_id").agg(F.count_distinct("row_id").alias("records"), F.min("split").alias("split"), F.max("split").alias("other")).where("split = other")
    groups = groups.select("group_id", F.col("group_id").alias("root_group_id"), "split", F.lit(False).alias("linked"), "records", F.lit("kept").alias("status"))
    groups = materialize(groups, "adopted")
    kept = rows.join(groups.select("group_id", F.col("split").alias("own")), "group_id")
    claims = kept.where("c1 is not null").select("c1", "c2", F.col("group_id").alias("node"), F.col("own").alias("split"), F.lit(False).alias("quarantined")).distinct()
    seen = kept.select("group_id", "row_id").distinct()
    return State(groups, claims, seen, seen.limit(0))


def released(state: State, groups: DataFrame) -> State:
    """The state with the named quarantined groups forgotten, so that they are taken as new once they are delivered again."""
    gone = groups.select("group_id").distinct().join(state.groups.where("status = 'quarantined'").select("group_id"), "group_id", "left_semi")
    gone = materialize(gone, "released")
    named = gone.select(F.col("group_id").alias("node"), F.lit(True).alias("quarantined"))
    return State(
        state.groups.join(gone, "group_id", "left_anti"),
        state.claims.join(named, ["node", "quarantined"], "left_anti").select("c1", "c2", "node", "split", "quarantined"),
        state.seen.join(gone, "group_id", "left_anti"),
        state.held.join(gone, "group_id", "left_anti"),
    )


def _fill(new: DataFrame, kept: DataFrame, targets: DataFrame) -> DataFrame:
    """(croot, split) for new components: they fill what the splits lack.

    Components of over 1 / (4 x BUCKETS) of all records, at most 4 x BUCKETS of them, go
    one by one to the split that lacks most. The others are laid out by hash; the sums of
    BUCKETS hash ranges, all that the driver sees, are cut where a split is full.
    """
    spark = new.sparkSession
    have = {r.split: r.n for r in kept.groupBy("split").agg(F.sum("records").alias("n")).collect()}
    total = (new.agg(F.sum("records")).first()[0] or 0) + sum(have.values())
    rows = targets.where("split is not null and target_share > 0").groupBy("split").agg(F.sum("target_share").alias("share")).orderBy("split").collect()
    if not rows:
        return new.select("croot", F.lit(None).cast("string").alias("split"))
    whole = sum(r.share for r in rows)
    lacks = {r.split: r.share / whole * total - have.get(r.split, 0) for r in rows}
    bound = max(1.0, total / (4 * BUCKETS))
    large = []
    for r in new.where(F.col("records") > bound).orderBy(F.desc("records"), F.md5("croot")).collect():
        best = max(lacks, key=lambda s: (lacks[s], s))
        lacks[best] -= r.records
        large.append((r.croot, best))
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), "croot")), 1, 3), 16, 10).cast("int")
    small = new.where(F.col("records") <= bound).withColumn("bucket", bucket)
    order = sorted(lacks, key=lambda s: -lacks[s])
    cuts, at, left = [], 0, {s: max(0.0, lacks[s]) for s in order}
    for r in small.groupBy("bucket").agg(F.sum("records").alias("n")).orderBy("bucket").collect():
        while at < len(order) - 1 and left[order[at]] < r.n / 2:
            at += 1
        left[order[at]] -= r.n
        cuts.append((r.bucket, order[at]))
    by_bucket = spark.createDataFrame(cuts, "bucket int, split string")
    some = small.join(F.broadcast(by_bucket), "bucket").select("croot", "split")
    return some.unionByName(spark.createDataFrame(large, "croot string, split string"))


def assign_splits(records: DataFrame, targets: DataFrame, state: State | None = None) -> State:
    """Splits for all groups of records (row_id, group_id, state), close to targets (split, target_share).

    Groups that share a claim, directly or along a chain, form a component named by its
    smallest group_id, and a component gets one split. With the state of an earlier run,
    known components keep their split, components of one split are joined by what new records
    share with both, and components without a split fill the deficits. Conflicts never move a
    known group and never leak:

    * A new group is quarantined (status `quarantined`, split null) if it holds a claim that
      known groups of different splits hold, or if its component would tie several splits.
    * A quarantined group links nothing further. It stays so in later runs until it is
      `released`; new groups that share a claim with it, and with no known split, join it.
    * A new record that brings to a known group a claim of another split is held back itself
      (`held`, split null in record_splits) and links nothing.

    A record with a null group_id is a group of its own, named by its row_id, and links
    nothing; nor do plain-text states, missing or empty claims. Repeated rows, in one run or
    a later one, count once. Null row_ids are left out. Empty tables give empty results.
    Claims meet by 128 hash bits.
    """
    rows = materialize(_claim_rows(records), "split_rows")
    fresh_rows = rows.select("group_id", "row_id")
    claims = rows.where("c1 is not null").select("c1", "c2", "group_id")
    if state is None:
        return _first_run(fresh_rows, claims, targets)
    fresh_rows = materialize(fresh_rows.distinct().join(state.seen, ["group_id", "row_id"], "left_anti"), "fresh_rows")
    before = state.groups.select("group_id", F.col("root_group_id").alias("old_root"), F.col("split").alias("old_split"), F.col("linked").alias("old_linked"), F.col("records").alias("before"), F.col("status").alias("old_status"))
    groups = fresh_rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("more")).join(before, "group_id", "full")
    groups = groups.withColumn("records", F.coalesce("more", F.lit(0)) + F.coalesce("before", F.lit(0))).drop("more", "before")
    groups = materialize(groups.withColumn("jailed", F.coalesce(F.col("old_status") == "quarantined", F.lit(False))), "groups")
    # What every component, quarantined group and new group holds, old and new.
    own = claims.distinct().join(groups.select("group_id", "old_root", "old_split", "jailed"), "group_id")
    own = own.select("c1", "c2", F.when(F.col("jailed"), F.col("group_id")).otherwise(F.coalesce("old_root", "group_id")).alias("node"), F.col("old_split").alias("split"), F.col("jailed").alias("quarantined"), (F.col("old_root").isNull() & ~F.col("jailed")).alias("fresh"))
    splits_of = lambda claims: claims.where("split is not null").groupBy("c1", "c2").agg(F.min("split").alias("s"), F.max("split").alias("t")).where("s <> t").select("c1", "c2")
    contested = materialize(splits_of(state.claims), "contested")
    clashing = materialize(splits_of(own.select("c1", "c2", "split").unionByName(state.claims.select("c1", "c2", "split"))), "clashing")
    kept_groups = groups.where("old_split is not null").select("group_id")
    held = rows.join(clashing, ["c1", "c2"], "left_semi").select("group_id", "row_id").distinct().join(kept_groups, "group_id", "left_semi")
    held = held.join(fresh_rows, ["group_id", "row_id"], "left_semi").unionByName(state.held).distinct()
    # A record that is held back brings its group no claim.
    known = own.where("split is null").unionByName(own.where("split is not null").join(clashing, ["c1", "c2"], "left_anti"))
    known = materialize(known.unionByName(state.claims.withColumn("fresh", F.lit(False))).distinct(), "claims")
    # New groups with a contested claim are out before anything is linked.
    tainted = materialize(known.where("fresh").join(contested, ["c1", "c2"], "left_semi").select("node").distinct(), "tainted")
    free = known.where("not quarantined").join(contested, ["c1", "c2"], "left_anti").join(tainted, "node", "left_anti")
    shared = free.groupBy("c1", "c2").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    edges = free.join(shared, ["c1", "c2"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    roots = materialize(connected_components(edges), "roots")
    out = groups.withColumn("node", F.when(F.col("jailed"), F.col("group_id")).otherwise(F.coalesce("old_root", "group_id")))
    out = out.join(roots.select("node", F.col("root").alias("croot")), "node", "left").join(tainted.withColumn("tainted", F.lit(True)), "node", "left")
    out = out.withColumn("out", F.col("jailed") | F.coalesce("tainted", F.lit(False))).withColumn("croot", F.when(F.col("out"), F.col("group_id")).otherwise(F.coalesce("croot", "node")))
    out = materialize(out.drop("tainted"), "groups")
    # Components without a split that touch a quarantined group join it.
    jail = known.where("quarantined").select("c1", "c2").unionByName(known.join(tainted, "node", "left_semi").select("c1", "c2")).distinct()
    touched = free.join(jail, ["c1", "c2"], "left_semi").select("node").distinct().join(out.where("not out").select("node", "croot").distinct(), "node").select("croot").distinct()
    comps = out.where("not out").groupBy("croot").agg(F.sum("records").alias("records"), F.min("old_split").alias("split"), F.max("old_split").alias("other"))
    comps = materialize(comps.join(touched.withColumn("touched", F.lit(True)), "croot", "left").withColumn("touched", F.coalesce("touched", F.lit(False))), "comps")
    filled = _fill(comps.where("split is null and not touched").select("croot", "records"), out.where("old_split is not null").select("records", F.col("old_split").alias("split")), targets)
    decided = comps.where("split is not null").select("croot", "split", (F.col("split") != F.col("other")).alias("clash"))
    decided = decided.unionByName(filled.withColumn("clash", F.lit(False)))
    decided = decided.unionByName(comps.where("split is null and touched").select("croot", "split", F.lit(True).alias("clash")))
    out = out.join(decided, "croot", "left")
    kept = F.col("old_split").isNotNull()
    clash = F.coalesce("clash", F.lit(False))
    quarantined = ~kept & (F.col("out") | clash)
    out = out.select(
        "group_id",
        F.when(quarantined, F.col("group_id")).when(kept & clash, F.col("old_root")).otherwise(F.col("croot")).alias("root_group_id"),
        F.when(kept, F.col("old_split")).when(~quarantined, F.col("split")).alias("split"),
        F.coalesce("old_linked", F.lit(False)).alias("linked"),
        "records",
        F.when(quarantined, "quarantined").when(kept, "kept").otherwise("new").alias("status"),
        "node",
    )
    out = materialize(out, "split_groups")
    joined = out.groupBy("root_group_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("root_group_id", F.lit(True).alias("many"))
    final = out.join(joined, "root_group_id", "left").withColumn("linked", F.col("linked") | F.coalesce("many", F.lit(False)))
    names = out.select("node", "root_group_id", "split", (F.col("status") == "quarantined").alias("quarantined"), "group_id")
    names = names.select("node", F.when(F.col("quarantined"), F.col("group_id")).otherwise(F.col("root_group_id")).alias("to"), "split", "quarantined").distinct()
    saved = known.select("c1", "c2", "node").join(names, "node").select("c1", "c2", F.col("to").alias("node"), "split", "quarantined").distinct()
    seen = state.seen.unionByName(fresh_rows)
    return State(final.select("group_id", "root_group_id", "split", "linked", "records", "status"), saved, seen, held)


def _first_run(rows: DataFrame, claims: DataFrame, targets: DataFrame) -> State:
    """assign_splits without anything known."""
    sizes = rows.groupBy("group_id").agg(F.count_distinct("row_id").alias("records"))
    known = materialize(claims.distinct(), "claims")
    shared = known.groupBy("c1", "c2").agg(F.min("group_id").alias("least"), F.max("group_id").alias("most")).where("least <> most")
    edges = known.join(shared, ["c1", "c2"]).where("group_id <> least").select(F.col("group_id").alias("a"), F.col("least").alias("b"))
    roots = materialize(connected_components(edges), "roots")
    groups = sizes.join(roots.select(F.col("node").alias("group_id"), F.col("root").alias("croot")), "group_id", "left")
    groups = groups.withColumn("linked", F.col("croot").isNotNull()).withColumn("croot", F.coalesce("croot", "group_id"))
    groups = materialize(groups, "groups")
    comps = materialize(groups.groupBy("croot").agg(F.sum("records").alias("records")), "comps")
    filled = _fill(comps, comps.select("records", F.lit(None).cast("string").alias("split")).limit(0), targets)
    out = groups.join(filled, "croot", "left").select("group_id", F.col("croot").alias("root_group_id"), "split", "linked", "records", F.lit("new").alias("status"))
    out = materialize(out, "split_groups")
    saved = known.join(out.select("group_id", "root_group_id", "split"), "group_id").select("c1", "c2", F.col("root_group_id").alias("node"), "split", F.lit(False).alias("quarantined")).distinct()
    seen = rows.distinct()
    return State(out, saved, seen, seen.limit(0))


def record_splits(records: DataFrame, state: State) -> DataFrame:
    """(row_id, split) of every record; null for quarantined groups and records that are held back."""
    rows = records.where("row_id is not null").select("row_id", F.coalesce("group_id", "row_id").alias("group_id")).distinct()
    held = state.held.withColumn("held", F.lit(True))
    rows = rows.join(state.groups.select("group_id", "split"), "group_id", "left").join(held, ["group_id", "row_id"], "left")
    return rows.select("row_id", F.when(F.col("held").isNull(), F.col("split")).alias("split"))
