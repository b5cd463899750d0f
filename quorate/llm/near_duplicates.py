"""Near-duplicate records: ProbMinHash bands, an exact completion for frequent words, exact verification."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.runtime import materialize
from .text import WordHash, content_of, mix64, words_of


@dataclass(frozen=True)
class Params:
    """threshold: least Jaccard similarity of the distinct words.

    bands, rows: bands of a ProbMinHash signature and registers in each. A word that a share f
    of the distinct sets has weighs min(1, cap / f). complete: whether the pairs that bands may
    miss are looked for too, by an exact prefix filter; without it, a pair of weighted
    similarity w goes unfound with a chance of (1 - w ** rows) ** bands.

    width: counters of the hashed document counts, which weigh and order the words: collisions
    cost time, never a pair. block: members of a bucket (of a band or a word) that are paired
    in one task; longer ones are split into pairs of blocks. hits: pairs looked at together, a
    bound on memory only. copies: records of one word set that are expanded in one task; more
    are split. small: as many nodes at most are broadcast (8 bytes each) to filter the word sets.
    """

    threshold: float = 0.6
    bands: int = 24
    rows: int = 3
    cap: float = 0.003
    complete: bool = True
    width: int = 1 << 22
    block: int = 8192
    hits: int = 2_000_000
    copies: int = 4096
    small: int = 500_000


def word_sets(records: DataFrame, id_col: str = "row_id", state_col: str = "state") -> DataFrame:
    """(row_id, node, words): the hashes of each record's distinct words; node names the set.

    Rows with a null id are left out. A record without words has an empty set and node 0.
    """

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            ids, states = batch.column(0), batch.column(1).to_pylist()
            flat, sizes, nodes = [], [], []
            for s in states:
                found = np.unique(np.fromiter((hashes[w] for w in words_of(content_of(s))), np.uint32))
                flat.append(found)
                sizes.append(len(found))
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(flat).view(np.int32) if flat else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(values))],
                names=["row_id", "node", "words"],
            )

    rows = records.select(F.col(id_col).cast("string").alias("row_id"), F.col(state_col).alias("state")).where("row_id is not null")
    return rows.mapInArrow(run, "row_id string, node bigint, words array<int>")


def flat_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Values as uint32 and offsets of an Arrow list<int32> column."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]].astype(np.int32, copy=False).view(np.uint32), offsets - offsets[0]


def distinct_sets(sets: DataFrame) -> DataFrame:
    """(node, words): each word set once, without the empty one."""
    return materialize(sets.where("size(words) > 0").groupBy("node").agg(F.any_value("words").alias("words")), "distinct_sets")


def _buckets(values: np.ndarray, width: int) -> np.ndarray:
    return (mix64(values.astype(np.uint64)) & np.uint64(width - 1)).astype(np.int64)


def word_levels(distinct: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """How common the words of a hash bucket are, in eighths of a doubling (0: in one set at most), and the number of sets."""
    width = p.width
    parts = min(64, width)

    def run(batches):
        counts, sets = np.zeros(width, np.uint32), 0
        for batch in batches:
            sets += batch.num_rows
            counts += np.bincount(_buckets(flat_of(batch.column(0))[0], width), minlength=width).astype(np.uint32)
        packed = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(parts, -1)]
        columns = [pa.array(np.arange(parts, dtype=np.int32)), pa.array(packed, pa.binary()), pa.array(np.full(parts, sets))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "counts", "sets"])

    def add(key, rows):
        n = np.zeros(width // parts, np.int64)
        for x in rows.column("counts"):
            n += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        level = np.where(n > 1, 1 + 8 * np.log2(np.maximum(n, 2) / 2), 0).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary()), "sets": pa.array([sum(rows.column("sets").to_pylist())])})

    sums = distinct.select("words").mapInArrow(run, "part int, counts binary, sets bigint").groupBy("part").applyInArrow(add, "part int, levels binary, sets bigint")
    levels, sets = np.zeros((parts, width // parts), np.uint8), 0
    for r in sums.collect():  # p.width bytes, whatever the corpus
        levels[r.part] = np.frombuffer(r.levels, np.uint8)
        sets = r.sets
    return levels.reshape(-1), sets


def level_weights(sets: int, cap: float) -> np.ndarray:
    """The weight of a word of each level: min(1, cap / its share of the sets)."""
    return np.minimum(1.0, cap * max(1, sets) / np.concatenate([[1.0], 2 * 2 ** (np.arange(255) / 8)]))


def probminhash(values: np.ndarray, offsets: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash signatures (n x m) of weighted sets, many sets at a time.

    Every element has a Poisson process of arrivals whose rate is its weight; each arrival
    falls on a random register, and a register keeps its earliest element. An element stops
    once its arrival is later than all registers of its set (early termination). Two sets
    agree on a register with the probability Jaccard similarity of their weights.
    """
    sizes = np.diff(offsets)
    n, registers = len(sizes), np.uint64(m)
    rec = np.repeat(np.arange(n), sizes)
    first = np.full(n * m, np.inf)
    sig = np.zeros(n * m, np.uint32)
    key = mix64(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mean, at, t = -1.0 / weights, np.zeros(len(values)), 0
    latest = np.full(n, np.inf)
    with np.errstate(over="ignore"):
        while len(rec):
            t += 1
            h = mix64(key + np.uint64(t) * np.uint64(0xD1342543DE82EF95))
            at = at + np.log(((h >> np.uint64(20)).astype(np.float64) + 1.0) * 2.0**-44) * mean
            if t > 1:
                live = at < latest[rec]
                key, mean, at, values, rec, h = (x[live] for x in (key, mean, at, values, rec, h))
                if not len(rec):
                    break
            slot = rec * m + (((h & np.uint64(0xFFFFF)) * registers) >> np.uint64(20)).astype(np.int64)
            np.minimum.at(first, slot, at)
            won = np.flatnonzero(first[slot] == at)
            sig[slot[won]] = values[won]
            owners = rec[np.flatnonzero(np.diff(rec, prepend=-1))]
            latest[owners] = first.reshape(n, m)[owners].max(axis=1)
    return sig.reshape(n, m)


def least_common(threshold: float, a, b):
    """Words that sets of a and b words share at least if their Jaccard similarity reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """The 64-bit keys (n x bands) of a signature's bands."""
    rows = signature.astype(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(rows.shape[2]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def keyed_sets(distinct: DataFrame, levels: np.ndarray, sets: int, p: Params) -> DataFrame:
    """(key, size, left, node): what sets that may reach the threshold have in common.

    The bands of each set's signature come first: they find pairs that share rare words and
    hardly any others, but can miss a pair whose common words are all frequent, such as two
    variants in a family that holds a large part of the rows. For these the rarest words of
    the set follow, so many that no pair of the threshold goes without a common one: sets x
    and y share at least threshold * size(x) words, so the first of them in any fixed order
    of all words is among the size - ceil(threshold * size) + 1 first of x, and likewise of y.
    left counts the words of the set from this one on (all, for a band). Words of one set
    only are left out, as they can't be shared.
    """
    t, step = p.threshold, 1000
    shared = distinct.sparkSession.sparkContext.broadcast((levels, level_weights(sets, p.cap)))  # p.width bytes, whatever the corpus

    def run(batches):
        levels, weights = shared.value
        for part in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            nodes = part.column(0).to_numpy(zero_copy_only=False)
            values, offsets = flat_of(part.column(1))
            sizes = np.diff(offsets).astype(np.int64)
            level = levels[_buckets(values, len(levels))]
            keys = band_keys(probminhash(values, offsets, weights[level], p.bands * p.rows), p.bands).reshape(-1)
            size, node = np.repeat(sizes, p.bands), np.repeat(nodes, p.bands)
            left = size
            if p.complete:
                rec = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((level.astype(np.int64) << 32 | values, rec))
                after = sizes[rec] - (np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
                keep = (after >= np.ceil(t * sizes[rec] - 1e-9)) & (level[order] > 0)
                at = rec[keep]
                keys = np.concatenate([keys, values[order[keep]].astype(np.int64)])
                size, left, node = (np.concatenate(x) for x in ((size, sizes[at]), (left, after[keep]), (node, nodes[at])))
            columns = (keys, size.astype(np.int32), left.astype(np.int32), node)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "size", "left", "node"])

    return distinct.select("node", "words").mapInArrow(run, "key bigint, size int, left int, node bigint")


def _pairs_of_runs(runs: np.ndarray, size: np.ndarray, left: np.ndarray, node: np.ndarray, p: Params, side: np.ndarray | None = None):
    """Pairs of nodes within runs (numbers, ascending, sizes ascending in each) that may reach the threshold, each once.

    The words left from a pair's first common word on bound what it shares, and the smaller
    set of a pair holds that word so early that few members need be compared with the others.
    """
    t = p.threshold
    key = runs.astype(np.int64) << 32 | size
    one = np.flatnonzero(left >= least_common(t, size, size))
    lo = np.searchsorted(key, key[one], "left")
    hi = np.searchsorted(key, runs[one].astype(np.int64) << 32 | np.floor(size[one] / t + 1e-9).astype(np.int64), "right")
    total = np.cumsum(hi - lo)
    bounds = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, p.hits)), len(one)))
    out = [np.zeros((0, 2), np.int64)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = hi[a:b] - lo[a:b]
        x = np.repeat(one[a:b], n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
        keep = (np.minimum(left[x], left[y]) >= least_common(t, size[x], size[y])) & (node[x] != node[y])
        if side is not None:
            keep &= side[x] != side[y]
        x, y = node[x[keep]], node[y[keep]]
        out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
    found = np.unique(np.concatenate(out), axis=0)
    return found[:, 0], found[:, 1]


def candidate_pairs(keyed: DataFrame, p: Params) -> DataFrame:
    """Distinct pairs (a < b) of nodes that share a key and, by its place in both, may reach the threshold.

    One shuffle by key; sorted runs are paired as they stream by, so that no bucket is
    gathered as a whole. The members of a bucket above p.block go to pairs of blocks, each
    its own group, which spreads a hot bucket evenly and loses no pair.
    """
    most = p.block
    names = ["a", "b", "key", "size", "left"]

    def out(key, size, left, node):
        """Pairs (a, b) of the runs of up to `most` members; the members (a, key, size, left) of longer ones."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(np.append(starts, len(key)))
        runs = np.repeat(np.arange(len(starts)), lengths)
        hot = np.repeat(lengths > most, lengths)
        a, b = _pairs_of_runs(runs[~hot], size[~hot], left[~hot], node[~hot], p)
        n, m = len(a), int(hot.sum())
        pair, member = np.arange(n + m) >= n, np.arange(n + m) < n
        fill = lambda x, k: np.concatenate([np.zeros(n, x.dtype), x[hot]]) if k else np.concatenate([x, np.zeros(m, x.dtype)])
        columns = [pa.array(np.concatenate([a, node[hot]])), pa.array(fill(b, False), mask=pair)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(fill(x, True), mask=member) for x in (key, size, left)], names=names)

    def run(batches):
        hold = [np.zeros(0, np.int64)] + [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.int64)]
        hot = None  # the key of the long run whose members are going out
        for batch in batches:
            hold = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(hold, batch.columns)]
            key = hold[0]
            if not len(key):
                continue
            cut = len(key) - int(np.argmax(np.append((key != key[-1])[::-1], True)))  # where the last run begins
            if hot is not None:
                k = int(np.argmax(np.append(key != hot, True)))
                if k:
                    yield members(*(x[:k] for x in hold))
                hold, cut = [x[k:] for x in hold], max(0, cut - k)
                if not len(hold[0]):
                    continue
                hot = None
            if cut:
                yield out(*(x[:cut] for x in hold))
            hold = [x[cut:] for x in hold]
            if len(hold[0]) > most:
                hot = hold[0][0]
                yield members(*hold)
                hold = [x[:0] for x in hold]
        if len(hold[0]):
            yield out(*hold)

    def members(key, size, left, node):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(key), pa.array(size), pa.array(left)], names=names)

    rows = keyed.repartition("key").sortWithinPartitions("key", "size")
    found = materialize(rows.mapInArrow(run, "a bigint, b bigint, key bigint, size int, left int"), "paired")
    pairs = found.where("b is not null").select("a", "b")
    hot = found.where("b is null").select("key", "size", "left", F.col("a").alias("node"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("k"))
    return pairs.unionByName(_block_pairs(hot.join(blocks, "key"), p)).distinct()


def _block_pairs(members: DataFrame, p: Params) -> DataFrame:
    """The pairs of nodes of one key, from (key, size, left, node, k); each pair of the k blocks is a group."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("size")
        side = None if pdf.i.iloc[0] == pdf.j.iloc[0] else pdf.mine.to_numpy()
        a, b = _pairs_of_runs(np.zeros(len(pdf), np.int64), pdf["size"].to_numpy(), pdf.left.to_numpy(), pdf.node.to_numpy(), p, side)
        return pd.DataFrame({"a": a, "b": b})

    mine = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    spread = spread.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "size", "left", "node")
    return spread.groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


def verified_links(pairs: DataFrame, distinct: DataFrame, p: Params) -> DataFrame:
    """(a, b, similarity) of the candidate pairs whose word sets reach the threshold, computed exactly."""
    pairs = materialize(pairs, "candidates")
    nodes, n = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate_nodes", rows=True)
    own = materialize(distinct.join(F.broadcast(nodes) if n <= p.small else nodes, "node", "left_semi"), "candidate_sets")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(
        own.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b"
    )
    common = F.size(F.array_intersect("wa", "wb"))
    similar = both.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("wa") + F.size("wb") - F.col("common")))
    return similar.where(F.col("similarity") >= p.threshold).select("a", "b", "similarity")


@dataclass
class NearDuplicates:
    sets: DataFrame  #: (row_id, node, words)
    links: DataFrame  #: (a, b, similarity) between different word sets
    params: Params


def near_duplicates(records: DataFrame, params: Params = Params(), id_col: str = "row_id", state_col: str = "state") -> NearDuplicates:
    """Links between the distinct word sets of records: candidates by bands and their completion, checked exactly.

    Equal contents share a node, so copies cost nothing beyond their own row. Null states and
    states without words link nothing; null ids are left out; rows repeated under one id count
    once; extra columns are ignored; empty tables give empty results. Word sets hold 32-bit
    hashes (two words of one pair of records fall together with a chance of about 1e-7).
    """
    sets = materialize(word_sets(records, id_col, state_col), "word_sets")
    distinct = distinct_sets(sets)
    keyed = keyed_sets(distinct, *word_levels(distinct, params), params)
    links = verified_links(candidate_pairs(keyed, params), distinct, params)
    return NearDuplicates(sets, materialize(links, "links"), params)


def record_pairs(found: NearDuplicates) -> DataFrame:
    """(row_id_a, row_id_b): all pairs of records of linked or equal word sets.

    A word set that many records have is split into parts of some `copies` records, and links
    are repeated for each pair of parts, so that no task gets all pairs of a hot set.
    """
    members = materialize(found.sets.where("size(words) > 0").select("node", "row_id").distinct(), "members")
    parts = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = materialize(parts.select("node", "n", F.ceil(F.col("n") / found.params.copies).cast("int").alias("k")), "parts")
    split = members.join(parts.where("k > 1").select("node", "k"), "node", "left")
    split = split.select("node", "row_id", F.pmod(F.xxhash64("row_id"), F.coalesce("k", F.lit(1))).cast("int").alias("part"))
    links = found.links.select("a", "b").unionByName(parts.select(F.col("node").alias("a"), F.col("node").alias("b")))
    for end in "ab":
        many = parts.where("k > 1").select(F.col("node").alias(end), "k")
        links = links.join(many, end, "left").withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
        links = links.join(split.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"), F.col("row_id").alias(f"r{end}")), [end, f"part_{end}"])
    rows = links.where("a <> b or ra < rb")
    return rows.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b")).where("row_id_a <> row_id_b").distinct()


def record_groups(found: NearDuplicates) -> DataFrame:
    """(row_id, group_row_id, n_links): one row per record; the group's name is its smallest row_id.

    n_links counts the other distinct word sets that the record's own set is linked to.
    """
    members = materialize(found.sets.select("node", "row_id", (F.size("words") > 0).alias("some")).distinct(), "members")
    degree = found.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected_components(found.links)
    rows = members.join(roots, "node", "left").join(degree, "node", "left")
    key = F.when(F.col("some"), F.coalesce("root", "node"))
    rows = rows.select("row_id", key.alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = rows.where("root is not null").groupBy("root").agg(F.min("row_id").alias("name"))
    return rows.join(names, "root", "left").select("row_id", F.coalesce("name", "row_id").alias("group_row_id"), "n_links")
