"""Evaluation passages in a corpus: CGK embeddings, bit-sampling LSH and exact edit distances."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD, mix64


@dataclass(frozen=True)
class Params:
    """window: words of a passage. max_edits: word insertions, deletions and replacements
    within a window. samples: places of an embedding in a key; repeats: embeddings with keys
    of their own. A window with no edit is always found, one with an edit with a chance of at
    least 0.95 at these values, which the tests measure on planted windows; a longer passage
    has many windows. An item of fewer words is one window of its own length, with edits from
    least_edited words on. min_share: part of an item that matched windows must cover where
    none is without edits; by default every verified window is reported. item_words: words of
    items that are held in one pass over the corpus; more items take more passes. hits:
    windows compared together, a bound on memory only.
    """

    window: int = 12
    max_edits: int = 1
    samples: int = 8
    repeats: int = 10
    least_edited: int = 8
    min_share: float = 0.0
    item_words: int = 2_000_000
    hits: int = 1_000_000
    seed: int = 41


_FORMAT: dict[str, None] = {}


def without_format(text: str) -> str:
    """The text in NFKC, without invisible format characters (Cf)."""
    if text.isascii():
        return text
    if not _FORMAT:
        _FORMAT.update((chr(c), None) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")
    text = unicodedata.normalize("NFKC", text)
    return text if _FORMAT.keys().isdisjoint(text) else "".join(c for c in text if c not in _FORMAT)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and without format characters (Cf), lower-cased."""
    found = WORD.findall(without_format(text)) if text else None
    return " ".join(found).lower().split(" ") if found else []


def embedding_keys(words: np.ndarray, starts: np.ndarray, p: Params, repeat: int) -> np.ndarray:
    """LSH keys of the windows of words (64-bit hashes) that begin at starts.

    The CGK walk copies a window into 3 x window places: each place takes the word the walk
    stands on, and a random bit of that word and place says whether it moves on; behind the
    last word there is a blank. Edits shift the walk only until it falls in step again, so
    few places differ. A key hashes the words at a random choice of places.
    """
    w, places = p.window, 3 * p.window
    rng = np.random.default_rng((p.seed, repeat))
    sampled = np.sort(rng.choice(places, p.samples, replace=False))
    bits = mix64(words ^ np.uint64(rng.integers(1, 1 << 63)))
    more = mix64(bits + np.uint64(1))
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), np.uint64(repeat + 1))
    last = len(words) - 1
    with np.errstate(over="ignore"):
        for j in range(int(sampled[-1]) + 1):
            inside = at < w
            own = np.minimum(starts + at, last)
            if j in sampled:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[own], np.uint64(0)))
            source = bits if j < 64 else more
            at += inside & ((source[own] >> np.uint64(j % 64)) & np.uint64(1)).astype(bool)
    return key


def edit_distances(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of x (w words) to the first w - most .. w + most words of the row of y (w + most words).

    Exact up to most, and most + 1 beyond it.
    """
    n, w = x.shape
    big = most + 1
    before = np.full((n, 2 * most + 3), big, np.int16)  # column c stands for j = i + c - most - 1
    before[:, most + 1 : 2 * most + 2] = np.arange(most + 1)
    for i in range(1, w + 1):
        now = np.full_like(before, big)
        for c in range(1, 2 * most + 2):
            j = i + c - most - 1
            if j < 0:
                continue
            if j == 0:
                now[:, c] = i
                continue
            now[:, c] = np.minimum(np.minimum(before[:, c] + (x[:, i - 1] != y[:, j - 1]), before[:, c + 1] + 1), now[:, c - 1] + 1)
        before = now
    return np.minimum(before[:, 1 : 2 * most + 2].min(axis=1), big)


def by_window(ids: list[int], texts: list[list[str]], p: Params) -> list[Items]:
    """The items in groups of one window size: all of at least p.window words, and those of each smaller number of words."""
    sizes = sorted({min(len(t), p.window) for t in texts} - {0})
    groups = []
    for w in sizes:
        own = [k for k, t in enumerate(texts) if min(len(t), p.window) == w]
        edits = p.max_edits if w >= p.least_edited else 0
        groups.append(Items([ids[k] for k in own], [texts[k] for k in own], replace(p, window=w, samples=min(p.samples, w), repeats=p.repeats if w == p.window else 3 * p.repeats, max_edits=edits)))
    return groups


class Items:
    """The windows of items and, by repeat, their sorted keys."""

    def __init__(self, ids: list[int], texts: list[list[str]], p: Params):
        self.params = p
        hashed = [np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in t), np.uint64, len(t)) for t in texts]
        keep = [k for k, t in enumerate(hashed) if len(t) >= p.window]
        self.ids = np.array([ids[k] for k in keep], np.int64)
        sizes = np.array([len(hashed[k]) for k in keep], np.int64)
        self.sizes = sizes
        self.words = np.concatenate([hashed[k] for k in keep]) if keep else np.zeros(0, np.uint64)
        self.known = np.unique(self.words)
        first = np.cumsum(sizes) - sizes
        n = sizes - p.window + 1
        self.item = np.repeat(np.arange(len(keep)), n)
        self.place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = first[self.item] + self.place
        self.keys = []
        for r in range(p.repeats if keep else 0):
            key = embedding_keys(self.words, self.start, p, r)
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], order))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def leaks_of(items: Items, words: np.ndarray, sizes: np.ndarray, p: Params):
    """(document, item, least edits, item words covered) for documents given by their words' hashes."""
    w, e = p.window, p.max_edits
    # Behind each document stand e words that no text has, so that a passage with words left out can end it.
    first = np.cumsum(sizes + e) - sizes - e
    padded = np.zeros(len(words) + e * len(sizes), np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    padded[first[doc] + np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = words
    words, sizes = padded, sizes + e
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - first[doc]
    at = np.minimum(np.searchsorted(items.known, words), len(items.known) - 1)
    strange = np.concatenate([[0], np.cumsum(items.known[at] != words)])
    start = np.flatnonzero(place + w <= sizes[doc])
    # Each word that no item has costs at least one edit.
    start = start[strange[start + w] - strange[start] <= e]
    span, ahead = np.arange(w), np.arange(w + e)
    last = len(words) - 1

    def doc_words(starts: np.ndarray) -> np.ndarray:
        """w + e words from each start on; blanks behind the document's end."""
        where = np.minimum(starts[:, None] + ahead, last)
        return np.where(doc[where] == doc[starts][:, None], words[where], np.uint64(0))

    met, kept = [np.zeros(0, np.int64)], []

    def verify(pair: np.ndarray) -> None:
        for k in range(0, len(pair), 200_000):
            part = pair[k : k + 200_000]
            x, y = items.words[items.start[part & 0xFFFFFFFF][:, None] + span], doc_words(part >> 32)
            # A cheap bound first: words of the item that the document doesn't have here cost an edit each.
            near = np.zeros(len(part), np.int64)
            for j in range(w):
                near += (y == x[:, j : j + 1]).any(1)
            part, x, y = (z[near >= w - e] for z in (part, x, y))
            kept.append(part[edit_distances(x, y, e) <= e])

    for r, (keys, order) in enumerate(items.keys):
        key = embedding_keys(words, start, p, r)
        lo = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[lo] == key)
        lo = lo[hit]
        n = np.searchsorted(keys, key[hit], side="right") - lo
        total = np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, p.hits)), len(n)))
        for a, b in zip(cuts[:-1], cuts[1:]):  # as many at once as memory holds; what met before is met once
            m = n[a:b]
            flat = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)
            met = [distinct(np.concatenate([*met, np.repeat(start[hit[a:b]], m) << 32 | order[flat]]))]
            if len(met[0]) > p.hits:
                verify(met[0])
                met = [np.zeros(0, np.int64)]
    verify(met[0])
    seen = distinct(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    if not len(seen):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    window = seen & 0xFFFFFFFF
    edits = edit_distances(items.words[items.start[window][:, None] + span], doc_words(seen >> 32), e).astype(np.int64)
    d, i = doc[seen >> 32], items.item[window]
    order = np.lexsort((items.place[window], i, d))
    d, i, edits, where = d[order], i[order], edits[order], items.place[window][order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])]))
    least = np.minimum.reduceat(edits, first)
    gap = np.minimum(np.append(np.diff(where), w), w)  # words from a window to the next that only it covers
    gap[np.append(first[1:] - 1, len(where) - 1)] = w
    return d[first], i[first], least, np.add.reduceat(gap, first)


FIELDS = "doc_id bigint, item_id bigint, edits int, words_covered int, share double, window int"


def leaked_items(documents: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, item_id, edits, words_covered, share, window): items of which a document holds passages.

    Items (item_id, text) are cut into all their windows, the corpus streams by them once and
    is not shuffled. Every window of a document is embedded and looked up by key, and what
    meets is verified by its exact edit distance. edits is the least of any window (0: the
    window's words stand in the document in a row), share the part of the item's words that
    matched windows cover, window the words of a window (fewer than the parameter for items
    that are shorter).

    Null and empty texts, and items without words, leak nothing; null ids are
    left out; repeated rows give one; copies of an item each come out; other columns are
    ignored; empty tables give an empty result. Words are compared by 64-bit hashes.
    """
    p = params
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = own.agg(F.sum(F.size(F.split("text", r"\s+")).cast("bigint"))).first()[0] or 0
    passes = max(1, -(-total // p.item_words))
    out = None
    for k in range(passes):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        index = by_window([r.item_id for r in rows], [words_of(r.text) for r in rows], p)
        found = _pass(docs, index, p)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("words_covered").alias("words_covered"), F.max("share").alias("share"), F.max("window").alias("window")).where((F.col("edits") == 0) | (F.col("share") >= p.min_share))


def _pass(docs: DataFrame, index: list[Items], p: Params) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # of at most item_words words

    def run(batches):
        groups = shared.value
        hashes: dict[str, int] = {}
        for batch in batches:
            if not groups:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for k in range(0, len(ids), 2000):
                if len(hashes) > 1_000_000:
                    hashes.clear()
                flat, sizes = [], []
                for t in texts[k : k + 2000]:
                    found = words_of(t)
                    sizes.append(len(found))
                    for w in found:
                        h = hashes.get(w)
                        if h is None:
                            hashes[w] = h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                        flat.append(h)
                if not flat:
                    continue
                words, counts = np.array(flat, np.uint64), np.array(sizes, np.int64)
                for items in groups:
                    d, i, edits, covered = leaks_of(items, words, counts, items.params)
                    columns = [ids[k : k + 2000][d], items.ids[i], edits.astype(np.int32), covered.astype(np.int32), covered / items.sizes[i], np.full(len(d), items.params.window, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "item_id", "edits", "words_covered", "share", "window"])

    return docs.mapInArrow(run, FIELDS)
