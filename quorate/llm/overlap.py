"""Cross-split overlaps: training records go to the evaluation texts they may match, whose compressed full-text index is searched backwards."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, scratch_path
from .near_duplicates import flat_of, least_common
from .text import WordHash, content_of, mix64, words_of


@dataclass(frozen=True)
class Params:
    """threshold: least Jaccard similarity of the distinct words.

    min_match: words of a maximal match at least to be counted in the report of a pair.
    shard_words: words of evaluation text in one index. hits: places looked at together, a
    bound on memory only.

    The rest sets what the search for candidates costs, and never what is found. posts:
    evaluation texts that a key is expected to be in before it takes in a further word.
    depths: (words of a set at most, words of a key at most), ascending; longer sets have keys
    of one word. block: members of a key that are paired in one task; more are split into pairs
    of blocks. small: as many nodes at most are broadcast to filter the records. width: hashed
    word counters at most.
    """

    threshold: float = 0.6
    min_match: int = 8
    shard_words: int = 3_000_000
    hits: int = 500_000
    posts: float = 50
    depths: tuple[tuple[int, int], ...] = ((400, 3), (2000, 2))
    block: int = 8192
    small: int = 2_000_000
    width: int = 1 << 24


def split_name(split: Column) -> Column:
    """Trimmed, lower-cased; validation and dev are val."""
    s = F.lower(F.trim(split))
    return F.when(s.isin("validation", "dev"), F.lit("val")).otherwise(s)


def node_of(words: np.ndarray) -> int:
    """The name of a sequence of words, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).view(np.int64))


def sequences(rows: DataFrame) -> DataFrame:
    """(row_id, evaluation, node, words) of (row_id, evaluation, state): the hashed words of each content, in order, and their name."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            found = [np.fromiter((hashes[w] for w in words_of(content_of(s))), np.uint32) for s in batch.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.uint32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int32)))
            nodes = pa.array([node_of(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, lists], names=["row_id", "evaluation", "node", "words"])

    return rows.mapInArrow(run, "row_id string, evaluation boolean, node bigint, words array<int>").where("size(words) > 0")


@dataclass(frozen=True)
class Words:
    """levels: how often the words of a hash bucket stand in evaluation texts, in eighths of a doubling from 1 on.

    both: a bit for each of 16 times as many buckets: a record of either side has a word of it.
    texts: the number of evaluation texts.
    """

    levels: np.ndarray
    both: np.ndarray
    texts: int

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level of each word, and whether both sides may have it."""
        at = _places(word, len(self.levels))
        return np.maximum(self.levels[at & len(self.levels) - 1], 1).astype(np.int64), self.both[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _places(values: np.ndarray, width: int) -> np.ndarray:
    return (mix64(values.astype(np.uint64)) & np.uint64(16 * width - 1)).astype(np.int64)


def count_words(words: DataFrame, width: int) -> Words:
    """Counts of hashed words, in some 6 * width bytes a task and 3 * width in the driver, whatever the corpus."""
    parts = min(64, width)

    def run(batches):
        counts, there, texts = np.zeros(width, np.uint32), np.zeros((2, 2 * width), np.uint8), 0
        for batch in batches:
            values, offsets = flat_of(batch.column(1))
            mine = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            own = np.repeat(mine, np.diff(offsets))
            at = _places(values, width)
            np.add.at(counts, at[own] & width - 1, np.uint32(1))
            for side, x in enumerate((at[own], at[~own])):
                np.bitwise_or.at(there[side], x >> 3, np.uint8(1) << (x & 7).astype(np.uint8))
            texts += int(mine.sum())
        columns = [pa.array(np.arange(parts, dtype=np.int32))]
        columns += [pa.array([zlib.compress(x.tobytes(), 1) for x in y.reshape(parts, -1)], pa.binary()) for y in (counts, *there)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(parts, texts))], names=["part", "counts", "tested", "trained", "texts"])

    def add(key, rows):
        n, there = np.zeros(width // parts, np.int64), np.zeros((2, 2 * width // parts), np.uint8)
        for x in rows.select(["counts", "tested", "trained"]).to_batches():
            for c, e, t in zip(*x.columns):
                n += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
                there[0] |= np.frombuffer(zlib.decompress(e.as_py()), np.uint8)
                there[1] |= np.frombuffer(zlib.decompress(t.as_py()), np.uint8)
        level = np.where(n > 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)
        found = [pa.array([x.tobytes()], pa.binary()) for x in (level, there[0] & there[1])]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *found, pa.array([sum(rows.column("texts").to_pylist())])], names=["part", "levels", "both", "texts"])

    sums = words.select("evaluation", "words").mapInArrow(run, "part int, counts binary, tested binary, trained binary, texts bigint")
    levels, both, texts = np.zeros((parts, width // parts), np.uint8), np.zeros((parts, 2 * width // parts), np.uint8), 0
    for r in sums.groupBy("part").applyInArrow(add, "part int, levels binary, both binary, texts bigint").toLocalIterator():
        levels[r.part], both[r.part] = np.frombuffer(r.levels, np.uint8), np.frombuffer(r.both, np.uint8)
        texts = r.texts
    return Words(levels.reshape(-1), both.reshape(-1), texts)


def set_keys(values: np.ndarray, offsets: np.ndarray, words: Words, p: Params):
    """The keys of many sequences of words: (size, known, bits) of each, and batches of (sequence, key, most).

    Words that may be shared are put in one order, rare ones first. Sets x and y of the
    threshold share at least c(x) = threshold * size(x) words, so the first word they share has
    that many known words of x left from it on, the second one word less, and so on; likewise in
    y. A key is the first shared word. Where a word is in too many evaluation texts, the first
    two are, where the two are expected in too many the first three: a decision on words alone,
    so x and y come to it alike, and any pair of the threshold has a key in common. Where x may
    share no more words than a key has before it is extended, that key goes out as an ending.
    Keys of long sets take in fewer words; sets near a limit of p.depths have keys on both
    sides of it. most: words that a pair with this key as its first words shares at most.
    known: the set's words that may be shared; bits: 128 bits of them.
    """
    t, g, n = p.threshold, np.uint64(0x9E3779B97F4A7C15), len(offsets) - 1
    rec = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    distinct = np.unique(rec << 32 | values)
    size = np.bincount(distinct >> 32, minlength=n)
    level, some = words.of(distinct & 0xFFFFFFFF)
    order = np.sort((distinct[some] >> 32) << 40 | level[some] << 32 | distinct[some] & 0xFFFFFFFF)
    rec, word = order >> 40, (order & 0xFFFFFFFF).astype(np.uint64)
    known = np.bincount(rec, minlength=n)
    last = np.cumsum(known)
    left = last[rec] - np.arange(len(rec))
    bit = mix64(word + g)
    bits = np.zeros(2 * n, np.uint64)
    np.bitwise_or.at(bits, 2 * rec + (bit >> np.uint64(6) & np.uint64(1)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    least = np.ceil(t * size - 1e-9).astype(np.int64)
    all_of = int(8 * np.log2(max(1, words.texts)))
    often = np.minimum((order >> 32 & 0xFF) - 1, all_of)
    limit = 8 * np.log2(p.posts)

    def longer(key, by):
        with np.errstate(over="ignore"):
            return mix64(key * g + by + np.uint64(1))

    def run():
        above = 0
        for number, (most_words, depth) in enumerate((*p.depths, (np.iinfo(np.int64).max, 1))):
            mine = (size <= most_words) & (size > t * above - 1e-9)
            above = most_words
            at = np.flatnonzero(mine[rec] & (left >= least[rec]))
            open_ = [(at, longer(np.full(len(at), number, np.uint64), word[at]), often[at], 1)]
            while open_:
                at, key, seen, k = open_.pop()
                hot = (seen > limit) & (k < depth)
                yield rec[at[~hot]], key[~hot], left[at[~hot]] + k - 1
                at, key, seen = at[hot], key[hot], seen[hot]
                end = least[rec[at]] <= k
                yield rec[at[end]], longer(key[end], np.uint64(1 << 40)), np.full(int(end.sum()), k)
                stop = np.maximum(at + 1, last[rec[at]] - np.maximum(least[rec[at]] - k, 1) + 1)
                total = np.cumsum(stop - at - 1)
                cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, p.hits)), len(at)))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    flat, own = _flat_ranges(at[a:b] + 1, stop[a:b])
                    open_.append((flat, longer(key[a:b][own], word[flat]), seen[a:b][own] + often[flat] - all_of, k + 1))

    return (size, known, bits.reshape(n, 2)), run()


KEYED = "key bigint, place bigint, most int, node bigint, b0 bigint, b1 bigint"
NAMES = [x.split(" ")[0] for x in KEYED.split(", ")]


def keyed_texts(words: DataFrame, counted: Words, p: Params) -> DataFrame:
    """A row for each key of each record; place has the side (0 for evaluation, 1 for training), the size and the known words."""
    shared = words.sparkSession.sparkContext.broadcast(counted)  # 3 * width bytes

    def run(batches):
        for part in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            side = 1 - part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            node = part.column(1).to_numpy(zero_copy_only=False)
            (size, known, bits), found = set_keys(*flat_of(part.column(2)), shared.value, p)
            place, bits = side << 62 | size << 31 | known, bits.view(np.int64)
            for rec, key, most in found:
                if len(rec):
                    columns = (key.view(np.int64), place[rec], most.astype(np.int32), node[rec], bits[rec, 0], bits[rec, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=NAMES)

    return words.select("evaluation", "node", "words").mapInArrow(run, KEYED)


def _pairs_of_keys(key, place, most, node, b0, b1, p: Params):
    """(evaluation node, training node) of the pairs within keys (rows by key and place) that may reach the threshold."""
    t = p.threshold
    size, known = place >> 31 & 0x7FFFFFFF, place & 0x7FFFFFFF
    run = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.int64)
    e, x = np.flatnonzero(place >> 62 == 0), np.flatnonzero(place >> 62 == 1)
    at = run[e] << 32 | size[e]
    lo = np.searchsorted(at, run[x] << 32 | np.ceil(t * size[x] - 1e-9).astype(np.int64), "left")
    hi = np.searchsorted(at, run[x] << 32 | np.floor(size[x] / t + 1e-9).astype(np.int64), "right")
    total = np.cumsum(hi - lo)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, p.hits)), len(x)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in zip(cuts[:-1], cuts[1:]):
        flat, own = _flat_ranges(lo[a:b], hi[a:b])
        i, j = e[flat], x[a:b][own]
        need = least_common(t, size[i], size[j])
        fine = np.minimum(most[i], most[j]) >= need
        i, j, need = i[fine], j[fine], need[fine]
        # known words of one that the other can't have, as it lacks their bits
        only_i = np.bitwise_count(b0[i] & ~b0[j]).astype(np.int64) + np.bitwise_count(b1[i] & ~b1[j])
        only_j = np.bitwise_count(b0[j] & ~b0[i]).astype(np.int64) + np.bitwise_count(b1[j] & ~b1[i])
        fine = np.minimum(known[i] - only_i, known[j] - only_j) >= need
        out.append((node[i[fine]], node[j[fine]]))
    return tuple(np.concatenate(y) for y in zip(*out))


def candidate_pairs(keyed: DataFrame, p: Params) -> DataFrame:
    """Distinct (e, t): nodes of evaluation texts and training records that share a key and, by sizes, places and bits, may reach the threshold.

    One shuffle by key; sorted runs are paired as they stream by. The members of a key of more
    than p.block rows go to pairs of blocks, each a key of its own, which loses no pair.
    """
    most = p.block
    schema = "e bigint, t bigint, " + KEYED

    def paired(rows):
        e, t = _pairs_of_keys(*rows[:4], *(x.view(np.uint64) for x in rows[4:]), p)
        return pa.RecordBatch.from_arrays([pa.array(e), pa.array(t), *(pa.nulls(len(e), pa.from_numpy_dtype(x.dtype)) for x in rows)], names=["e", "t", *NAMES])

    def members(rows):
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(rows[0]), pa.int64())] * 2, *(pa.array(x) for x in rows)], names=["e", "t", *NAMES])

    def run_of(split: bool):
        def run(batches):
            hold = None
            hot = None  # the key of the long run whose members are going out
            for batch in batches:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                hold = new if hold is None else [np.concatenate([h, c]) for h, c in zip(hold, new)]
                if hot is not None:
                    k = int(np.argmax(np.append(hold[0] != hot, True)))
                    if k:
                        yield members([x[:k] for x in hold])
                    hold = [x[k:] for x in hold]
                if not len(hold[0]):
                    continue
                hot = None
                key = hold[0]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                lengths = np.diff(np.append(starts, len(key)))
                cut = starts[-1]  # where the last run begins
                long = np.repeat(lengths > most, lengths) if split else np.zeros(len(key), bool)
                if cut and long[:cut].any():
                    yield members([x[:cut][long[:cut]] for x in hold])
                if cut:
                    yield paired([x[:cut][~long[:cut]] for x in hold])
                hold = [x[cut:] for x in hold]
                if split and len(hold[0]) > most:
                    hot = hold[0][0]
                    yield members(hold)
                    hold = [x[:0] for x in hold]
            if hold is not None and len(hold[0]):
                yield paired(hold)

        return run

    def sorted_(rows):
        return rows.select(*NAMES).repartition("key").sortWithinPartitions("key", "place")

    found = materialize(sorted_(keyed).mapInArrow(run_of(True), schema), "paired")
    hot = found.where("e is null").drop("e", "t")
    hot = hot.withColumn("side", F.shiftright("place", 62))
    counts = hot.groupBy("key").agg(*(F.ceil(F.count_if(F.col("side") == k) * 2 / most).cast("int").alias(f"k{k}") for k in (0, 1))).where("k0 > 0 and k1 > 0")
    spread = hot.join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("k0")).otherwise(F.col("k1"))))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("k1")).otherwise(F.col("k0")) - 1)))
    own, other = F.col("mine").cast("int"), F.col("other").cast("int")
    block = F.when(F.col("side") == 0, F.struct(own.alias("i"), other.alias("j"))).otherwise(F.struct(other.alias("i"), own.alias("j")))
    blocks = spread.withColumn("key", F.xxhash64("key", block))
    return found.where("e is not null").select("e", "t").unionByName(sorted_(blocks).mapInArrow(run_of(False), schema).select("e", "t")).distinct()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only groups that are still tied are sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_text = text[sa]
    head = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]) if n else np.zeros(0, bool)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        ends = np.append(head[1:], True)
        slots = np.flatnonzero(~(head & ends))
        if not len(slots):
            return sa.astype(np.uint32)
        own = sa[slots]
        after = own + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[own] << 32) | second
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[slots] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] |= new
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2


def build_index(ids: list[str], docs: list[np.ndarray], p: Params) -> dict[str, np.ndarray]:
    """The arrays of one index; records of equal word sequences share a text and are listed in `owners`.

    Symbols 0..D-1 end the D texts, the others are words in the order of `vocab`. `occ` holds,
    symbol by symbol, the places of each word in the Burrows-Wheeler transform, ascending and
    delta-coded; neither the texts nor their suffixes are kept. `row_doc` is the text of each
    suffix, `node` the name of each text.
    """
    by: dict[bytes, list[int]] = {}
    for k, x in enumerate(docs):
        if len(x):
            by.setdefault(x.tobytes(), []).append(k)
    texts = [docs[v[0]] for v in by.values()]
    d = len(texts)
    vocab, symbols = np.unique(np.concatenate(texts) if d else np.zeros(0, np.uint32), return_inverse=True)
    sizes = np.array([len(x) for x in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    text = np.zeros(start[-1], np.int64)
    ends = start[1:] - 1
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = symbols + d
    text[ends] = np.arange(d)
    sa = suffix_array(text).astype(np.int64)
    bwt = text[sa - 1]
    order = np.argsort(bwt, kind="stable")
    occ = order[bwt[order] >= d]
    row_doc = np.repeat(np.arange(d, dtype=np.int32), sizes + 1)[sa]
    keys = np.unique((np.repeat(np.arange(d), sizes).astype(np.int64) << 32) | symbols)
    return {
        "vocab": vocab, "counts": np.bincount(symbols, minlength=len(vocab)).astype(np.int64), "occ": np.diff(occ, prepend=0).astype(np.int32), "row_doc": row_doc,
        "set_size": np.bincount(keys >> 32, minlength=d).astype(np.int32), "node": np.array([node_of(x) for x in texts], np.int64),
        "owner_doc": np.repeat(np.arange(d, dtype=np.int32), [len(v) for v in by.values()]) if d else np.zeros(0, np.int32),
        "owners": np.array([ids[k] for v in by.values() for k in v], object),
    }


class Index:
    """A loaded index: ranges of suffixes by backward steps, texts by name, and steps back from single suffixes."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.vocab, self.set_size = a["vocab"], a["set_size"]
        self.docs = d = len(self.set_size)
        counts, self.occ = a["counts"], np.cumsum(a["occ"], dtype=np.int64)
        #: The suffixes that begin with word s are first[s] .. first[s + 1].
        self.first = d + np.concatenate([[0], np.cumsum(counts)])
        rows = d + len(self.occ)
        # One step back from a suffix: the word before it, and the suffix that begins with that word.
        self.before = np.full(rows, -1, np.int32)
        self.before[self.occ] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.back = np.zeros(rows, np.int32)
        self.back[self.occ] = np.arange(d, rows, dtype=np.int32)
        # The suffixes of a word in one text: those of the word's range, by text.
        word = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        key = word << 32 | a["row_doc"][d:].astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.in_doc, self.in_doc_row = key[order], (order + d).astype(np.int32)
        self.by_node = np.argsort(a["node"], kind="stable")
        self.nodes = a["node"][self.by_node]
        self.owners, self.owner_at = a["owners"], np.searchsorted(a["owner_doc"], np.arange(d + 1))

    def texts(self, nodes: np.ndarray) -> np.ndarray:
        """The texts of these names, which must be in this index."""
        return self.by_node[np.searchsorted(self.nodes, nodes)]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The word's number in this index, -1 if it is not there."""
        if not len(self.vocab):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffixes that start with symbol followed by those of [lo, hi)."""
        key = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) << 32 | self.occ
        s = symbol.astype(np.int64) << 32
        return self.docs + np.searchsorted(key, s | lo), self.docs + np.searchsorted(key, s | hi)


def _flat_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    n = hi - lo
    own = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), own


class Batch:
    """Records to be searched for: what doesn't depend on an index is computed once."""


    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.offsets, self.sizes, n = offsets, np.diff(offsets), len(offsets) - 1
        self.rec = np.repeat(np.arange(n, dtype=np.int64), self.sizes)
        self.vocab, self.word = np.unique(values, return_inverse=True)
        self.distinct_key = np.unique((self.rec << 32) | self.word)
        self.distinct = np.bincount(self.distinct_key >> 32, minlength=n)


def search(index: Index, batch: Batch, r: np.ndarray, d: np.ndarray, p: Params):
    """Of the pairs of the batch's records r with the index's texts d those that reach the threshold.

    Returns record, text, similarity, and of the pair's maximal matches of min_match words or
    more the number, the words covered after merging, and the longest. From every word that
    record and text share the search goes on backwards to maximal matches; the distinct words
    under the merged matches are what the two have in common.
    """
    if not len(r):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    symbol = index.symbols(batch.vocab)
    words = np.cumsum(batch.sizes[r])
    cuts = np.unique(np.append(np.searchsorted(words, np.arange(0, words[-1], p.hits)), len(r)))
    out = [_matched(index, batch, symbol, r[a:b], d[a:b], p) for a, b in zip(cuts[:-1], cuts[1:])]
    return tuple(np.concatenate(x) for x in zip(*out))


def _matched(index: Index, batch: Batch, symbol: np.ndarray, r: np.ndarray, d: np.ndarray, p: Params):
    """Of candidate pairs those of the threshold, with similarity and maximal matches, by backward search from every shared word."""
    flat, own = _flat_ranges(batch.offsets[r], batch.offsets[r + 1])
    s = symbol[batch.word[flat]]
    key = s.astype(np.int64) << 32 | d[own]
    lo = np.where(s >= 0, np.searchsorted(index.in_doc, key), 0)
    hi = np.where(s >= 0, np.searchsorted(index.in_doc, key, "right"), 0)
    shared = hi > lo
    # What merged matches of any length cover: the record's words that the text has.
    common = np.bincount(np.unique(own[shared] << 32 | batch.word[flat[shared]]) >> 32, minlength=len(r))
    similarity = common / (batch.distinct[r] + index.set_size[d] - common)
    fine = similarity >= p.threshold
    number = np.cumsum(fine) - 1
    use = np.flatnonzero(fine[own] & shared)
    at, of = _flat_ranges(lo[use], hi[use])
    end = use[of]  # the place (in flat) where the match ends
    row, j = index.in_doc_row[at].astype(np.int64), flat[end]
    first = batch.offsets[r[own[end]]]
    length = np.ones(len(end), np.int64)
    live = np.arange(len(end))
    while len(live):  # one word further back, for all that still match
        j[live] -= 1
        inside = j[live] >= first[live]
        live = live[inside]
        live = live[index.before[row[live]] == symbol[batch.word[j[live]]]]
        row[live] = index.back[row[live]]
        length[live] += 1
    # The longest match that ends at each place; it is maximal if none goes on from it by one word.
    longest = np.zeros(len(flat), np.int64)
    np.maximum.at(longest, end, length)
    after = np.where(np.append(own[1:], -1) == own, np.append(longest[1:], 0), 0)
    span = np.flatnonzero((longest >= p.min_match) & (after <= longest) & fine[own])
    n = int(fine.sum())
    seen = np.zeros(len(flat) + 1, np.int64)
    np.add.at(seen, span - longest[span] + 1, 1)
    np.add.at(seen, span + 1, -1)
    under = (np.cumsum(seen[:-1]) > 0) & fine[own]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, number[own[span]], longest[span])
    return r[fine], d[fine], similarity[fine], np.bincount(number[own[span]], minlength=n), np.bincount(number[own[under]], minlength=n), top


FIELDS = "row_id_eval string, t bigint, similarity double, matches int, words_covered int, longest int"


def cross_split_overlaps(
    records: DataFrame, params: Params = Params(), evaluation: tuple[str, ...] = ("val", "test"), training: tuple[str, ...] = ("train",)
) -> DataFrame:
    """(row_id_eval, row_id_train, similarity, matches, words_covered, longest) of every overlapping pair.

    Records (row_id, split, state) of both sides meet in keys of their rare words, by which
    each training record gets to know the evaluation texts that it may match. Only these texts
    are indexed, in shards of bounded size, and a training record goes to the shards of its own
    candidates alone, so that work follows records and candidates and not training records times
    shards; pairs are verified where they are found. Shards are Parquet in the shared folder, so
    any executor can read them again. Null splits, ids and states take part in nothing; a record
    delivered twice counts once; records without words match nothing; copies of a text are
    searched once and all come out; empty tables give an empty result. Words are compared by
    32-bit hashes, texts named by 64-bit ones.
    """
    spark = records.sparkSession
    p = params
    rows = records.select(F.col("row_id").cast("string").alias("row_id"), split_name(F.col("split")).alias("split"), "state")
    rows = rows.where("row_id is not null and state is not null").where(F.col("split").isin(*evaluation, *training))
    words, n = materialize(sequences(rows.select("row_id", F.col("split").isin(*evaluation).alias("evaluation"), "state")), "words", rows=True)
    counted = count_words(words, min(p.width, 1 << max(10, (32 * n).bit_length())))
    pairs, found = materialize(candidate_pairs(keyed_texts(words, counted, p), p), "candidates", rows=True)
    nodes, some = materialize(pairs.select(F.explode(F.array("e", "t")).alias("node")).distinct(), "candidate_nodes", rows=True)
    kept = materialize(words.join(F.broadcast(nodes) if some <= p.small else nodes, "node", "left_semi"), "candidate_words")
    tested = kept.where("evaluation").select("row_id", "node", "words")
    total = tested.agg(F.sum(F.size("words").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // p.shard_words))

    def index(key, table):
        table = table.sort_by([("row_id", "ascending"), ("node", "ascending")]).combine_chunks()
        ids, names = table.column("row_id").to_pylist(), table.column("node").to_pylist()
        unique = [k for k in range(len(ids)) if k == 0 or (ids[k], names[k]) != (ids[k - 1], names[k - 1])]
        column = pa.concat_arrays(table.column("words").chunks)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False).view(np.uint32)
        words = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        made = build_index([ids[k] for k in unique], [words[k] for k in unique], p)
        names = [k for k in made if k != "owners"]
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * len(names), pa.int32()),
                "field": names,
                "kind": [made[k].dtype.str for k in names],
                "data": pa.array([made[k].tobytes() for k in names], pa.binary()),
                "owners": pa.array([made["owners"].tolist() if k == "vocab" else None for k in names], pa.list_(pa.string())),
            }
        )

    def shard_of(node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(shards)).cast("int")

    built = tested.withColumn("shard", shard_of("node")).repartition(shards, "shard")
    built = built.groupBy("shard").applyInArrow(index, "shard int, field string, kind string, data binary, owners array<string>")
    path = scratch_path(spark, "index")
    built.write.option("compression", "zstd").partitionBy("shard").parquet(path)

    def load(shard: int) -> Index | None:
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        files, at = fs.FileSystem.from_uri(f"{path}/shard={shard}") if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), f"{path}/shard={shard}")
        if files.get_file_info(at).type == fs.FileType.NotFound:
            return None
        rows = ds.dataset(at, filesystem=files, format="parquet").to_table().to_pylist()
        made = {r["field"]: np.frombuffer(r["data"], r["kind"]) for r in rows}
        made["owners"] = next(r["owners"] for r in rows if r["owners"] is not None)
        return Index(made)

    def run(batches):
        at, index = None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(shard))):
                if at != shard[a]:
                    at, index = shard[a], None  # the last one goes before the next one comes
                    index = load(at)
                part = batch.slice(a, b - a)
                names = part.column(1).to_numpy()
                flat, offsets = flat_of(part.column(2))
                wanted = part.column(3)
                places = wanted.offsets.to_numpy()
                d = index.texts(wanted.values.to_numpy()[places[0] : places[-1]])
                r, d, similarity, count, covered, longest = search(index, Batch(flat, offsets.astype(np.int64)), np.repeat(np.arange(b - a), np.diff(places)), d, p)
                flat, own = _flat_ranges(index.owner_at[d], index.owner_at[d + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([index.owners[x] for x in flat], pa.string()),
                        pa.array(names[r[own]]),
                        pa.array(similarity[own].astype(float)),
                        *(pa.array(x[own].astype(np.int32)) for x in (count, covered, longest)),
                    ],
                    names=["row_id_eval", "t", "similarity", "matches", "words_covered", "longest"],
                )

    train = kept.where("not evaluation").select(F.col("node").alias("t"), "row_id", "words")
    routed = pairs.withColumn("shard", shard_of("e")).groupBy("shard", "t").agg(F.collect_list("e").alias("e"))
    routed = routed.join(train.groupBy("t").agg(F.any_value("words").alias("words")), "t").select("shard", "t", "words", "e")
    routed = materialize(routed, "routed").repartitionByRange(max(shards, -(-found // 20_000)), "shard", "t").sortWithinPartitions("shard", "t")
    pairs = routed.mapInArrow(run, FIELDS).join(train.select("t", F.col("row_id").alias("row_id_train")), "t").where("row_id_eval <> row_id_train")
    return pairs.groupBy("row_id_eval", "row_id_train").agg(*(F.max(c).alias(c) for c in ("similarity", "matches", "words_covered", "longest")))


def overlap_pairs(records: DataFrame, params: Params = Params()) -> DataFrame:
    """(row_id_a, row_id_b), smaller id first."""
    found = cross_split_overlaps(records, params)
    return found.select(F.least("row_id_eval", "row_id_train").alias("row_id_a"), F.greatest("row_id_eval", "row_id_train").alias("row_id_b")).distinct()


def overlap_report(records: DataFrame, params: Params = Params()) -> DataFrame:
    """Per split and source of the evaluation record: records, those that overlap training, and the pairs."""
    found = cross_split_overlaps(records, params)
    per = found.groupBy("row_id_eval").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("most"))
    rows = records.select("row_id", split_name(F.col("split")).alias("split"), F.lower(F.trim("source")).alias("source"))
    rows = rows.where("split in ('val', 'test') and row_id is not null").dropDuplicates(["row_id"])
    rows = rows.join(per.withColumnRenamed("row_id_eval", "row_id"), "row_id", "left")
    return rows.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.max("most").alias("highest")
    )
