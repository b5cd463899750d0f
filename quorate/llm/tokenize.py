"""Encoding of a whole corpus: every distinct word is encoded once, wherever it occurs."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of a text into words that the rank file's merges go with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Params:
    """ranks: the rank file, a public vocabulary. block_chars: characters of text whose words
    are put together before the shuffle; a longer text is a block of its own. buckets: parts
    of the hash range of words; a task holds the distinct words of one bucket at a time.
    """

    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    block_chars: int = 6_000_000
    buckets: int = 2048


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


#: A block's words of one bucket: the words (with their lengths in bytes), how often each stands in the block, and where (gaps).
WORDS = "block bigint, bucket int, words binary, sizes binary, often binary, places binary, docs binary"
#: The same with ids (and their numbers) in place of words.
CODED = "block bigint, ids binary, sizes binary, often binary, places binary, docs binary"


def varints(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Numbers below 2^35 as bytes of seven bits, the lowest first, in parts that begin at cuts."""
    x = x.astype(np.uint64)
    n = np.ones(len(x), np.int64)
    for k in range(1, 5):
        n += x >= 1 << 7 * k
    end = np.cumsum(n)
    start = end - n
    out = np.zeros(int(end[-1]) if len(x) else 0, np.uint8)
    at = np.arange(len(x))
    for k in range(5):
        if not len(at):
            break
        out[start[at] + k] = ((x[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((n[at] > k + 1).astype(np.uint8) << 7)
        at = at[n[at] > k + 1]
    data = out.tobytes()
    bounds = np.append(np.append(start, len(data))[cuts], len(data)).tolist()
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def unvarint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for k in range(5):
        at = start + k
        ok = at <= end
        out[ok] |= (b[at[ok]] & 127).astype(np.int64) << (7 * k)
    return out


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encode(documents: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens.

    Texts are cut into words in blocks of bounded size; a block sends each of its distinct
    words once, with the places where it stands, so that a word that is everywhere is sent
    once a block. The words meet by hash bucket in a global shuffle, each distinct word is
    encoded once, and its ids go back to the blocks, which put the texts together by place.
    No text is joined or sent itself.

    Null and empty texts give the empty list; rows come out as often as they come in, with
    their id as it is, null too; other columns are ignored; an empty table gives an empty
    result. The strings of special tokens in a text are ordinary text.
    """
    p = params
    kind = documents.schema[id_col].dataType.simpleString()

    def words(batches):
        import regex

        cut = regex.compile(PATTERN).findall
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= p.block_chars):
                    chars += len(texts[end] or "")
                    end += 1
                flat: list[str] = []
                sizes = []
                for t in texts[at:end]:
                    found = cut(t) if t else ()
                    flat.extend(found)
                    sizes.append(len(found))
                docs = pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(sizes, pa.int64())], names=["id", "n"])
                rows = [(block, None, None, None, None, None, _pack(docs))]
                if flat:
                    coded = pa.array(flat, pa.string()).dictionary_encode()
                    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
                    which = coded.indices.to_numpy(zero_copy_only=False)
                    bucket = np.fromiter((xxhash.xxh32_intdigest(w) for w in spelled), np.int64, len(spelled)) % p.buckets
                    by = np.argsort(bucket, kind="stable")  # words by bucket
                    rank = np.empty(len(by), np.int64)
                    rank[by] = np.arange(len(by))
                    which = rank[which]
                    order = np.argsort(which, kind="stable")
                    often = np.bincount(which, minlength=len(by))
                    ends = np.cumsum(often)
                    gaps = np.diff(order, prepend=0)
                    first = (ends - often)
                    gaps[first] = order[first]
                    lengths = np.array([len(w) for w in spelled], np.int64)[by]
                    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
                    text, at_byte = b"".join([spelled[k] for k in by.tolist()]), np.concatenate([[0], np.cumsum(lengths)])
                    edges = at_byte[np.append(cuts, len(by))].tolist()
                    packed = (varints(lengths, cuts), varints(often, cuts), varints(gaps, first[cuts]))
                    rows += [(block, k, text[x:y], *parts, None) for k, x, y, *parts in zip(bucket[by[cuts]].tolist(), edges[:-1], edges[1:], *packed)]
                for k in range(0, len(rows), 512):
                    yield _batch(rows[k : k + 512], WORDS)
                block += 1
                at = end

    def codes(batches):
        encoder, here, known = None, None, {}
        for batch in batches:
            rows, ids, numbers, cut_ids, cut_numbers = [], [], [], [], []
            for block, bucket, spelled, sizes, often, places, docs in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((block, often, places, docs))
                cut_ids.append(len(ids))
                cut_numbers.append(len(numbers))
                if bucket is None:
                    continue
                if bucket != here:
                    here, known = bucket, {}
                encoder = encoder or _encoding(p.ranks)
                a = 0
                for n in sizes if max(sizes) < 128 else unvarint(sizes).tolist():
                    w = spelled[a : a + n]
                    a += n
                    found = known.get(w)
                    if found is None:
                        known[w] = found = encoder.encode_ordinary(w.decode())
                    ids += found
                    numbers.append(len(found))
            coded = zip(varints(np.array(ids, np.int64), np.array(cut_ids, np.int64)), varints(np.array(numbers, np.int64), np.array(cut_numbers, np.int64)))
            out = [(r[0], None, None, None, None, r[3]) if r[3] is not None else (r[0], i, n, r[1], r[2], None) for r, (i, n) in zip(rows, coded)]
            if out:
                yield _batch(out, CODED)

    def texts(batches):
        for table in _runs(batches):
            docs = next(x for x in table.column("docs").to_pylist() if x is not None)
            docs = pa.ipc.open_stream(docs).read_next_batch()
            ids, size, often, gaps = (unvarint(b"".join(x for x in table.column(c).to_pylist() if x is not None)) for c in ("ids", "sizes", "often", "places"))
            start, total = np.cumsum(size) - size, np.cumsum(gaps)
            first = np.cumsum(often) - often
            places = total - np.repeat(total[first] - gaps[first], often)
            row = np.empty(len(places), np.int64)
            row[places] = np.repeat(np.arange(len(size)), often)
            n = size[row]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[row], n)
            by_word = np.concatenate([[0], np.cumsum(n)])
            ends = by_word[np.concatenate([[0], np.cumsum(docs.column(1).to_numpy())])]
            for a in range(0, docs.num_rows, 2000):
                part = ends[a : a + 2001]
                lists = pa.ListArray.from_arrays((part - part[0]).astype(np.int32), pa.array(ids[at[part[0] : part[-1]]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs.column(0).slice(a, 2000), lists], names=[id_col, "ids"])

    cut = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(words, WORDS)
    # Rows without a bucket carry a block's documents; they are spread by block, not met on one key.
    met = cut.repartition(F.coalesce(F.col("bucket").cast("bigint"), -1 - F.col("block"))).sortWithinPartitions("bucket")
    coded = met.mapInArrow(codes, CODED)
    back = coded.repartition("block").sortWithinPartitions("block")
    return back.mapInArrow(texts, f"`{id_col}` {kind}, ids array<int>")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _runs(batches):
    """Tables of the rows of one block each, from batches sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(0)[0] != batch.column(0)[int(a)]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def decode(encoded: DataFrame, params: Params = Params(), id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) of (id_col, ids): ids are joined with the token-byte table where they are.

    The table is a vocabulary, so every worker has it whole and the join is a lookup by id
    over Arrow batches; no token is a row of its own and nothing is shuffled. Empty and null
    lists give the empty text. An id that is not in the table, or bytes that are no UTF-8,
    fail.
    """
    kind = encoded.schema[id_col].dataType.simpleString()
    path = params.ranks

    def run(batches):
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        known = np.zeros(len(table), bool)
        for b, i in ranks.items():
            table[i] = b
            known[i] = True
        length = np.fromiter((len(b) for b in table), np.int64, len(table))
        start, data = np.cumsum(length) - length, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ok = (ids >= 0) & (ids < len(table))
                if not (ok.all() and known[ids].all()):
                    raise ValueError("unknown token id")
                n = length[ids]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ids], n)
                sizes = np.array([x or 0 for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
                raw = data[at].tobytes()
                texts = [raw[x:y].decode("utf-8") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
