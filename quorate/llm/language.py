"""Languages of documents and of their segments: unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .leakage import without_format

#: Names and three-letter codes of the languages (fixed values).
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german", "deutsch"), "fr": ("fra", "fre", "french", "français"),
    "es": ("spa", "spanish", "español"), "it": ("ita", "italian", "italiano"), "nl": ("nld", "dut", "dutch", "nederlands"),
    "pt": ("por", "portuguese", "português"), "ru": ("rus", "russian", "русский"),
}
LANGUAGES = tuple(NAMES)
_CODES = {x: k for k, v in NAMES.items() for x in (k, *v)}
#: Headings of rendered records that are no text of the document (fixed values).
HEADINGS = ("State", "Claim", "Evidence", "Verdict")


@dataclass(frozen=True)
class Params:
    """pieces: a public vocabulary of word pieces. sample: labelled documents of each language
    that the model is fitted on, at most; rounds: of relabelling the sample's sentences;
    steps: of expectation-maximisation in a round. prior: weight of the pieces of all
    languages together in each language's. margin: nats by which a sentence's language must
    be ahead to count as a language of the document. words: words of a whole sentence at
    least. temper: power of the likelihood in the confidence, as words of a sentence depend
    on one another.
    """

    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"
    sample: int = 250
    rounds: int = 2
    steps: int = 3
    prior: float = 200.0
    margin: float = 4.0
    words: int = 5
    temper: float = 0.5


def label_code(label: str | None) -> str | None:
    """The two-letter code of a label, whatever its form, case or region; None if it names no language here."""
    if not label:
        return None
    return _CODES.get(re.split(r"[-_\s]", label.strip().lower())[0])


_HEAD = "|".join(HEADINGS)
_BLOCK = re.compile(rf"\n[^\S\n]*\n\s*|\x0c|\n(?=\s*(?:[-*>#|@]|\d{{1,3}}[.)]\s|(?:{_HEAD}):))")
_PREFIX = re.compile(rf"\s*(?:(?:{_HEAD}):\s*|[-*>]+\s+|@\S+:\s*|\d{{1,3}}[.)]\s+(?:[^.!?:\n]{{1,80}}:\s+)?)*")
_SENTENCE = re.compile(r"\S.*?(?:[.!?…]+[\"”»’)\]]*(?=\s|$)|$)", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the sentences of a text; lines of headings and table rows, and user names, are left out.

    Whole ones begin with a capital and end with a mark, and do not go on from a block that
    ended without one, as at a page's end.
    """
    out = []
    at, open_ended = 0, False
    for block in [*_BLOCK.finditer(text), None]:
        end = block.start() if block else len(text)
        part = text[at:end]
        if part.lstrip()[:1] in ("#", "|"):  # only its line is left out, not the text on the next
            line = part.find("\n", len(part) - len(part.lstrip()))
            at, part = (end, "") if line < 0 else (at + line + 1, part[line + 1 :])
        if part.strip():
            skip = _PREFIX.match(part).end()
            for m in _SENTENCE.finditer(part, skip):
                found = m.group()
                first = _LETTERS.search(found)
                ends = found.rstrip("\"”»’)]")[-1:] in tuple(".!?…")
                out.append((at + m.start(), at + m.end(), ends and not open_ended and first is not None and first.group()[0].isupper()))
                open_ended = not ends and first is not None
        at = block.end() if block else end
    return out


def letter_words(text: str) -> list[str]:
    return _LETTERS.findall(without_format(text).lower())


class Pieces:
    """The vocabulary's word pieces, looked up along a word."""

    LONG = 40
    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i).lower()
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and piece not in kept:
                kept[piece] = len(kept)
        self.index = kept
        self.size = len(kept) + 1  # the last row: a character that no piece has
        known = dict.fromkeys((p[:k] for p in kept for k in range(1, len(p))), -1) | kept  # -1: only begins a piece
        text = "".join(known)
        sizes = np.fromiter((len(p) for p in known), np.int64, len(known))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        start, h = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(int(sizes.max())):
                more = sizes > k
                h[more] = h[more] * self.STEP + codes[start[more] + k]
        order = np.argsort(h)
        self.hashes, self.rows = h[order], np.fromiter(known.values(), np.int64, len(known))[order]

    def arcs(self, words: list[str]):
        """(word, from, to, row) of all pieces in the words, and the words' lengths. A word begins with the word mark."""
        cut = ["▁" + word for word in words]
        lengths = np.fromiter((len(t) for t in cut), np.int64, len(cut))
        codes = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        me = np.repeat(np.arange(len(cut)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        room = lengths[me] - place  # characters from here to the end
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        size = 0
        with np.errstate(over="ignore"):
            while len(at):
                h = h * self.STEP + codes[at + size]
                size += 1
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[k] == h
                row = np.where(hit, self.rows[k], -1)
                one = row >= 0
                if size == 1:  # a character without a piece of its own still has an arc
                    row, one = np.where(one, row, self.size - 1), np.ones(len(at), bool)
                found.append(np.stack([me[at[one]], place[at[one]], place[at[one]] + size, row[one]], axis=1))
                go = hit & (room[at] > size)
                at, h = at[go], h[go]
        arcs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        return arcs, lengths


def _forward(arcs: np.ndarray, lengths: np.ndarray, prob: np.ndarray, backward: bool = False) -> np.ndarray:
    """alpha[word, place, language]: the summed probability of all segmentations up to a place (or from it on)."""
    most = int(lengths.max(initial=0))
    table = np.zeros((len(lengths), most + 1, prob.shape[1]))
    if backward:
        table[np.arange(len(lengths)), lengths] = 1.0
    else:
        table[:, 0] = 1.0
    key = arcs[:, 1] if backward else arcs[:, 2]
    order = np.lexsort((arcs[:, 0], key))
    a, key = arcs[order], key[order]
    cuts = np.searchsorted(key, np.arange(most + 2))
    for j in range(most, -1, -1) if backward else range(most + 1):
        part = a[cuts[j] : cuts[j + 1]]
        if not len(part):
            continue
        add = table[part[:, 0], part[:, 2] if backward else part[:, 1]] * prob[part[:, 3]]
        first = np.flatnonzero(np.concatenate([[True], part[1:, 0] != part[:-1, 0]]))
        table[part[first, 0], j] += np.add.reduceat(add, first)
    return table


@dataclass
class Model:
    pieces: Pieces
    prob: np.ndarray  #: probability of each piece in each language

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over the word's segmentations."""
        out = np.zeros((len(words), self.prob.shape[1]))
        long = [k for k, w in enumerate(words) if len(w) > self.pieces.LONG]
        short = sorted((k for k, w in enumerate(words) if len(w) <= self.pieces.LONG), key=lambda k: len(words[k]))  # alike lengths make small tables
        for a in range(0, len(short), 5_000):
            part = short[a : a + 5_000]
            arcs, lengths = self.pieces.arcs([words[k] for k in part])
            alpha = _forward(arcs, lengths, self.prob)
            out[part] = np.log(alpha[np.arange(len(lengths)), lengths] + 1e-300)
        for k in long:
            out[k] = self.long_score(words[k])
        return out

    def long_score(self, word: str) -> np.ndarray:
        """The same for a word of any length: place by place, each language rescaled where its sum gets small."""
        arcs, lengths = self.pieces.arcs([word])
        arcs = arcs[np.argsort(arcs[:, 2], kind="stable")]
        cuts = np.searchsorted(arcs[:, 2], np.arange(int(lengths[0]) + 2))
        reach = int((arcs[:, 2] - arcs[:, 1]).max())
        ring = np.zeros((reach + 1, self.prob.shape[1]))  # the last places
        ring[0], scale = 1.0, np.zeros(self.prob.shape[1])
        for j in range(1, int(lengths[0]) + 1):
            part = arcs[cuts[j] : cuts[j + 1]]
            now = (ring[part[:, 1] % (reach + 1)] * self.prob[part[:, 3]]).sum(0)
            ring[j % (reach + 1)] = now
            small = now < 1e-100
            if small.any():
                by = np.where(small, np.maximum(now, 1e-300), 1.0)
                ring /= by
                scale += np.log(by)
        return np.log(ring[int(lengths[0]) % (reach + 1)] + 1e-300) + scale


def _totals(words: list[list[str]], model: Model, cache: dict[str, int], scores: list[np.ndarray]) -> np.ndarray:
    """Summed word scores of lists of words; words seen before are taken from the cache."""
    new = list(dict.fromkeys(w for ws in words for w in ws if w not in cache))
    if new:
        base = len(cache)
        cache.update((w, base + k) for k, w in enumerate(new))
        scores.append(model.word_scores(new))
    table = np.concatenate(scores) if scores else np.zeros((0, model.prob.shape[1]))
    scores[:] = [table]
    sizes = [len(ws) for ws in words]
    rows = table[np.fromiter((cache[w] for ws in words for w in ws), np.int64, sum(sizes))]
    sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return sums[at[1:]] - sums[at[:-1]]


def fit(documents: DataFrame, params: Params = Params()) -> Model:
    """Piece probabilities of each language, from a bounded sample of labelled documents.

    Of each language up to `sample` documents, the first in order of a hash of their id, come
    to the driver. Expectation-maximisation over all segmentations gives the pieces' expected
    counts; then each sentence gets the language that the model finds, which puts right what
    labels have wrong, and the counts are taken again. Words above 40 characters take no part
    in the fit (they are scored whole all the same). Each language's pieces are drawn
    towards those of all languages, which count alike. A language without a labelled document
    is never found.
    """
    p = params
    codes = documents.sparkSession.createDataFrame(list(_CODES.items()), "name string, code string")
    name = F.split(F.lower(F.trim("lang")), r"[-_\s]")[0]
    rows = documents.where("text is not null and lang is not null").select("doc_id", "text", name.alias("name")).join(F.broadcast(codes), "name")
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "text")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.sample)
    words, labels = [], []
    for r in rows.select("text", "code").collect():
        for start, end, _ in sentences(r.text):
            found = [w for w in letter_words(r.text[start:end]) if len(w) <= Pieces.LONG]
            if len(found) >= p.words:
                words.append(found)
                labels.append(LANGUAGES.index(r.code))
    pieces = Pieces(p.pieces)
    n = len(LANGUAGES)
    model = Model(pieces, np.full((pieces.size, n), 1.0 / pieces.size))
    if not words:
        return model
    distinct = list(dict.fromkeys(w for ws in words for w in ws))
    number = {w: k for k, w in enumerate(distinct)}
    arcs, lengths = pieces.arcs(distinct)
    which = np.array(labels)
    for turn in range(p.rounds + 1):
        if turn:
            which = _totals(words, model, {}, []).argmax(1)
        counts = np.zeros((len(distinct), n))
        for ws, k in zip(words, which):
            for w in ws:
                counts[number[w], k] += 1
        for _ in range(p.steps):
            alpha, beta = _forward(arcs, lengths, model.prob), _forward(arcs, lengths, model.prob, backward=True)
            whole = alpha[np.arange(len(lengths)), lengths]
            share = alpha[arcs[:, 0], arcs[:, 1]] * model.prob[arcs[:, 3]] * beta[arcs[:, 0], arcs[:, 2]] / (whole[arcs[:, 0]] + 1e-300)
            expected = np.zeros_like(model.prob)
            np.add.at(expected, arcs[:, 3], share * counts[arcs[:, 0]])
            expected[-1] = expected.sum(axis=1)[-1] / n  # a character without a piece speaks for no language
            size = expected.sum(0)
            pool = (expected[:, size > 0] / size[size > 0]).mean(1) + 1e-7
            pool /= pool.sum()
            prob = (expected + p.prior * pool[:, None]) / (size + p.prior)
            prob[:, size == 0] = 1e-9
            prob[-1] = prob[-1, size > 0].mean()
            model = Model(pieces, prob)
    return model


FIELDS = "doc_id bigint, segment int, start int, end int, lang string, confidence double, sentences int, whole int, label string, letters boolean"


def segments(documents: DataFrame, model: Model, params: Params = Params()) -> DataFrame:
    """One row for each stretch of sentences of one language; one of segment 0 and no language for texts without letters.

    (doc_id, segment, start, end: characters of the text, lang, confidence, sentences, whole:
    whole sentences whose language is clear, label: the code that documents.lang names,
    letters). A sentence that is too short or unclear goes with the document's main language.
    Null texts count as empty, null ids are left out.
    """
    p = params
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a vocabulary's size, whatever the corpus

    def run(batches):
        model = shared.value
        cache: dict[str, int] = {}
        scores: list[np.ndarray] = []
        for batch in batches:
            ids, texts, labels = (batch.column(k).to_pylist() for k in range(3))
            for a in range(0, len(ids), 1000):
                if len(cache) > 200_000:
                    cache.clear()
                    scores.clear()
                yield _segment_batch(ids[a : a + 1000], texts[a : a + 1000], labels[a : a + 1000], model, cache, scores, p)

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, FIELDS)


def _segment_batch(ids, texts, labels, model: Model, cache, scores, p: Params) -> pa.RecordBatch:
    spans, words, owner = [], [], []
    for k, t in enumerate(texts):
        for s in sentences(t or ""):
            found = letter_words(t[s[0] : s[1]])
            if found:
                spans.append(s)
                words.append(found)
                owner.append(k)
    total = _totals(words, model, cache, scores) if words else np.zeros((0, len(LANGUAGES)))
    of = np.array(owner, np.int64)
    at = np.searchsorted(of, np.arange(len(ids) + 1))
    out = []
    for k, (i, label) in enumerate(zip(ids, labels)):
        code = label_code(label)
        a, b = at[k], at[k + 1]
        if a == b:
            rest = letter_words(re.sub(rf"(?m)^\s*(?:{_HEAD}):", " ", texts[k] or ""))
            if rest:  # letters outside of sentences, as in a heading or a table
                sums = _totals([rest], model, cache, scores)[0] * p.temper
                q = np.exp(sums - sums.max())
                out.append((i, 0, 0, len(texts[k]), LANGUAGES[int(sums.argmax())], float(q.max() / q.sum()), 0, 0, code, True))
            else:
                out.append((i, 0, 0, len(texts[k] or ""), None, None, 0, 0, code, False))
            continue
        sums = total[a:b]
        main = int(sums.sum(0).argmax())
        best = sums.argmax(1)
        ordered = np.sort(sums, axis=1)
        clear = (ordered[:, -1] - ordered[:, -2] >= p.margin) & (np.array([len(w) for w in words[a:b]]) >= p.words)
        best = np.where(clear, best, main)
        starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        for n, (x, y) in enumerate(zip(starts, np.append(starts[1:], b - a))):
            mean = sums[x:y].sum(0) * p.temper
            q = np.exp(mean - mean.max())
            whole = int(sum(1 for m in range(x, y) if clear[m] and spans[a + m][2]))
            out.append((i, n, spans[a + x][0], spans[a + y - 1][1], LANGUAGES[best[x]], float(q[best[x]] / q.sum()), int(y - x), whole, code, True))
    columns = list(zip(*out)) if out else [[]] * 10
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    names = ["doc_id", "segment", "start", "end", "lang", "confidence", "sentences", "whole", "label", "letters"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, languages, label, letters): the main language of each document and all it has whole sentences in.

    The main language is the one with most characters. A document without whole sentences
    has its main language alone; one without letters has none.
    """
    per = found.groupBy("doc_id", "lang").agg(
        F.sum(F.col("end") - F.col("start")).alias("chars"), F.max("confidence").alias("confidence"), F.sum("whole").alias("whole"), F.min("label").alias("label"), F.max("letters").alias("letters")
    )
    rows = per.groupBy("doc_id").agg(
        F.max_by(F.struct("lang", "confidence"), F.struct("chars", "lang")).alias("m"),
        F.array_sort(F.collect_set(F.when(F.col("whole") > 0, F.col("lang")))).alias("l"),
        F.min("label").alias("label"),
        F.max("letters").alias("letters"),
    )
    languages = F.when(F.size("l") > 0, F.col("l")).when(F.col("m.lang").isNotNull(), F.array("m.lang")).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "m.lang", "m.confidence", languages.alias("languages"), "label", "letters")


def wrong_labels(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing, wrong or names one of several."""
    found = document_languages(segments(documents, fit(documents, params), params))
    wrong = F.col("label").isNull() | ~F.array_contains("languages", F.col("label")) | (F.size("languages") > 1)
    return found.where(F.col("letters") & wrong).select("doc_id", F.explode("languages").alias("lang")).distinct()


def languages(documents: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Segments and documents with their languages and confidences; copies and repeated rows each count."""
    found = materialize(segments(documents, fit(documents, params), params), "segments")
    return found, document_languages(found)
