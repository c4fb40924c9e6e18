"""Byte-level BPE: overlapping chunks, stitched, encoded; and decoding.

Texts are cut into chunks that overlap. Chunks are cut into pre-tokens in
parallel. Where the pre-token boundaries of two neighbours fall together in
their overlap, the text is cut for good: a match of the pattern depends only on
what follows its start, so after a shared boundary both go on alike. The
pieces between those cuts are encoded, and a document's ids are its pieces'
ids in order. If an overlap has no shared boundary (a pre-token longer than
the overlap), the rest of that document is one piece. A text of a single chunk
is a piece already and isn't moved.

Decoding concatenates the bytes of the ids.

Defined cases: a null text encodes as an empty one, to no ids; ids unknown to
the vocabulary, when decoding, raise an error; repeated rows and null doc_ids
are encoded each; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.memory import released

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: A boundary so near the end of a chunk may still depend on what follows.
MARGIN_CHARS = 16
#: Pre-tokens whose ids a Python worker keeps.
CACHE_SIZE = 300_000
SHORT_BYTES = 48
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank": bytes and their rank (and id)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary's merges, with the ranks of single bytes and pairs at hand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.singles = [ranks.get(bytes((b,)), _NONE) for b in range(256)]
        self.pairs = [[ranks.get(bytes((a, b)), _NONE) for b in range(256)] for a in range(256)]

    def __call__(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the lowest rank merges, leftmost first."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.short(piece) if len(piece) <= SHORT_BYTES else _merge_long(piece, self.ranks)

    def short(self, piece: bytes) -> list[int]:
        """Looks through all pairs for each merge: quickest for few bytes."""
        get, starts = self.ranks.get, list(range(len(piece) + 1))
        ids, pairs = [self.singles[b] for b in piece], [self.pairs[a][b] for a, b in zip(piece, piece[1:])]
        while (least := min(pairs, default=_NONE)) != _NONE:
            i = pairs.index(least)
            ids[i] = least
            del starts[i + 1], pairs[i], ids[i + 1]
            if i < len(pairs):
                pairs[i] = get(piece[starts[i] : starts[i + 2]], _NONE)
            if i:
                pairs[i - 1] = get(piece[starts[i - 1] : starts[i + 1]], _NONE)
        return ids


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Keeps the pairs in a heap and the parts linked, for n log n steps."""
    n = len(piece)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class _Known(dict):
    """Pre-token to its ids' bytes (int32), filled as pre-tokens come up."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.merges = ranks, Merges(ranks)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_SIZE:
            self.clear()
        ids = array("i", self.merges(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


#: One vocabulary's ids, kept from task to task by a worker.
_KEPT: dict[int, _Known] = {}


def _known(vocabulary) -> _Known:
    ranks = vocabulary.value
    kept = _KEPT.get(len(ranks))
    if kept is None or kept.ranks != ranks:
        _KEPT.clear()
        kept = _KEPT[len(ranks)] = _Known(ranks)
    return kept


def boundaries(text: str, start: int, begin: int, end: int, pattern: regex.Pattern) -> list[int]:
    """Pre-token starts of a chunk that lie in [begin, end), as document positions."""
    return [p for m in pattern.finditer(text) if begin <= (p := start + m.start()) < end]


def _id_batches(rows: Iterator[tuple[tuple, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that end in a list of ids, of a bounded number of ids."""
    keys, ids, size = [], [], 0
    for key, found in rows:
        keys.append(key)
        ids.append(found)
        size += len(found)
        if size > 4_000_000:
            yield _id_batch(keys, ids, schema)
            keys, ids, size = [], [], 0
    if keys:
        yield _id_batch(keys, ids, schema)


def _id_batch(keys: list[tuple], ids: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*keys))]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    return pa.RecordBatch.from_arrays([*columns, lists], schema=schema)


def _encoder(vocabulary, pattern: str, keys: pa.Schema):
    """A function of Arrow batches (keys..., text, beyond) that encodes every text.

    The last ``beyond`` characters only tell how the text goes on: they are
    the next piece's, and their pre-tokens are dropped.
    """
    schema = keys.append(pa.field("ids", pa.list_(pa.int32())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = regex.compile(pattern).findall, _known(vocabulary)

        def rows():
            for batch in batches:
                columns = [batch.column(n) for n in keys.names]
                for i, (text, beyond) in enumerate(zip(batch.column("text"), batch.column("beyond").to_pylist())):
                    found = cut(text.as_py())
                    while beyond > 0:
                        beyond -= len(found.pop())
                    yield tuple(c[i].as_py() for c in columns), b"".join(map(known.__getitem__, found))

        yield from _id_batches(rows(), schema)

    return encode


def encoded(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decode: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``; with ``decode`` also the ids' bytes.

    ``path`` is read by the driver; the vocabulary, of bounded size, is broadcast.
    """
    spark = docs.sparkSession
    ranks = read_ranks(path)
    vocabulary = spark.sparkContext.broadcast(ranks)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longest = chunk_chars + overlap_chars
    short = texts.where(F.length("text") <= longest)
    encode, back = _encoder(vocabulary, pattern, pa.schema([("doc_id", pa.int64())])), _decoder(spark, ranks) if decode else None
    # one pass of a Python worker does both
    whole = short.withColumn("beyond", F.lit(0)).mapInArrow(released((lambda batches: back(encode(batches))) if decode else encode), "doc_id long, ids array<int>" + ", bytes binary" * decode)

    long = texts.where(F.length("text") > longest).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = _chunks(long, chunk_chars, overlap_chars)
    pieces = _pieces(chunks, pattern, chunk_chars)
    keys = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64())])
    parts = pieces.mapInArrow(released(_encoder(vocabulary, pattern, keys)), "row long, doc_id long, piece long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    stitched = parts.groupBy("row", "doc_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids")).select("doc_id", "ids")
    return whole.unionByName(stitched.mapInArrow(released(back), "doc_id long, ids array<int>, bytes binary") if decode else stitched)


def _chunks(long: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """row, doc_id, chunk, chunks and text: each chunk goes on into the next by the overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(n) for n in ("row", "doc_id", "text"))):
                body = text.as_py()
                starts = range(0, max(len(body) - overlap_chars, 1), chunk_chars)
                for k in range(0, len(starts), 256):
                    some = starts[k : k + 256]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row.as_py()] * len(some), pa.int64()), "doc_id": pa.array([doc_id.as_py()] * len(some), pa.int64()),
                        "chunk": pa.array(range(k, k + len(some)), pa.int64()), "chunks": pa.array([len(starts)] * len(some), pa.int64()),
                        "text": pa.array([body[s : s + chunk_chars + overlap_chars] for s in some], pa.string()),
                    })

    return long.mapInArrow(released(cut), "row long, doc_id long, chunk long, chunks long, text string").repartition("row", "chunk")


def _pieces(chunks: DataFrame, pattern: str, chunk_chars: int) -> DataFrame:
    """row, doc_id, piece, text and beyond: the chunks, cut where neighbours agree.

    A piece's text goes on past its cut by the margin, as the pattern looks ahead.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, n, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "chunks", "text"))):
                start, end = k * chunk_chars, k * chunk_chars + len(text)
                found = boundaries(text, start, start, end, compiled)
                overlap = len(text) - chunk_chars
                heads.append([p for p in found if p < start + max(overlap, 0)] if k else [])
                tails.append([p for p in found if start + chunk_chars <= p < end - MARGIN_CHARS] if k < n - 1 else [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), batch.column("chunks"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["row", "chunk", "chunks", "heads", "tails"])

    marks = chunks.mapInArrow(mark, "row long, chunk long, chunks long, heads array<long>, tails array<long>")
    by_chunk = W.partitionBy("row").orderBy("chunk")
    met = F.array_min(F.array_intersect("tails", F.lead("heads").over(by_chunk)))
    cuts = marks.select("row", "chunk", "chunks", met.alias("cut"))
    trusted = F.min(F.when(F.col("cut").isNull(), 0).otherwise(1)).over(by_chunk.rowsBetween(W.unboundedPreceding, 0)) == 1
    cuts = cuts.select("row", "chunk", "chunks", F.when(trusted, F.col("cut")).alias("cut"))
    cuts = cuts.select("row", "chunk", F.lag("cut").over(by_chunk).alias("begin"), F.col("cut").alias("end"))
    spans = chunks.join(cuts, ["row", "chunk"])
    start = F.col("chunk") * chunk_chars
    # a chunk without a trusted begin belongs to the piece before it, and adds what lies past the overlap
    begin = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.coalesce(F.col("begin"), start))
    end = F.coalesce(F.col("end"), F.when(F.col("chunk") < F.col("chunks") - 1, start + chunk_chars).otherwise(start + F.length("text")))
    beyond = F.when(F.col("end").isNotNull(), F.lit(MARGIN_CHARS)).otherwise(F.lit(0))
    body = F.substring(F.col("text"), (begin - start + 1).cast("int"), (end - begin + beyond).cast("int"))
    opens = F.when((F.col("chunk") == 0) | F.col("begin").isNotNull(), F.col("chunk"))
    cut = spans.select("row", "doc_id", "chunk", opens.alias("opens"), body.alias("body"), beyond.alias("beyond"))
    piece = F.max("opens").over(by_chunk.rowsBetween(W.unboundedPreceding, 0))
    joined = cut.select("row", "doc_id", "chunk", piece.alias("piece"), "body", "beyond").groupBy("row", "doc_id", "piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "body"))), lambda p: p["body"]), "")
    return joined.agg(text.alias("text"), F.max("beyond").alias("beyond"))


def _decoder(spark: SparkSession, ranks: dict[bytes, int]):
    """A function of Arrow batches (doc_id, ids) that adds the ids' bytes."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    tokens = spark.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.frombuffer(b"".join(tokens.value), np.uint8)
        lengths = np.array([len(t) for t in tokens.value], np.int64)
        begins = np.cumsum(lengths) - lengths
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                lists = some.column("ids")
                flat = lists.flatten().to_numpy()
                sizes = lengths[flat]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                if (sizes == 0).any():
                    raise ValueError("an id is not in the vocabulary")
                data = every[np.arange(ends[-1]) + np.repeat(begins[flat] - ends[:-1], sizes)]
                bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
                whole = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, whole], names=["doc_id", "ids", "bytes"])

    return decode


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``ids`` (doc_id, ids) with the bytes that the ids stand for, in column ``bytes``."""
    return ids.select("doc_id", "ids").mapInArrow(_decoder(ids.sparkSession, read_ranks(path)), "doc_id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    rows = encoded(docs, path, pattern, decode=True)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
