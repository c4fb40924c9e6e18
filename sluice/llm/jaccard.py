"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A text's shingles are its runs of five lower-cased words (a shorter text is one
shingle). MinHash signatures are cut into bands; texts that share a band's hash
are candidates. Bands and rows are chosen for a target recall at the
threshold. Every candidate pair is verified once, on the full shingle sets, in
blocks of bounded size: a bucket of many texts is dealt out as pairs of
blocks, so no task holds a whole bucket and no pair becomes a row. A task
returns one row for each text and block: how many documents it is linked to,
and the least text that the block's links lead to. Those edges connect just the
texts that the links connect.

Exact copies are one text to all of this, counted by their number.

Defined cases: null and empty texts, and texts without words, have no links
and are classes of their own; repeated rows count as copies; null doc_ids take
part, and lose to any other as a class's id; other columns are ignored (or
kept, by :func:`deduplicated`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.memory import released
from sluice.plans.lineage import durable

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Signature rows of a band.
ROWS = 5
#: Texts of a bucket that a task compares with each other or with as many more.
BLOCK = 256
SEED = 20_261
#: Shingle hashes of a group that are put in order at a time, and columns of a product of membership.
CODES_AT_ONCE, WIDTH = 500_000, 4_096
#: Words whose hashes a Python worker keeps.
WORDS_KEPT = 200_000


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows by which a pair at ``threshold`` is found with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """Word to 64-bit hash, filled as words come up."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, hashes: dict[str, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``words`` words."""
    found = text.lower().split()
    codes = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(codes):
        return codes
    span = min(words, len(codes))
    runs = np.zeros(len(codes) - span + 1, np.uint64)
    for k in range(span):
        runs = runs * np.uint64(0x100000001B3) + codes[k : k + len(runs)]
    return np.unique(_mixed(runs + np.uint64(span)))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _sketcher(words: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = _WordHashes(), _permutations(bands * rows)
        odd = np.random.default_rng(SEED + 1).integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            made = []
            for text in batch.column("text"):
                x = _mixed(shingles(text.as_py() or "", hashes, words))
                if not len(x):
                    made.append(None)
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max)
                for k in range(0, len(x), 1024):
                    least = np.minimum(least, (x[k : k + 1024, None] * a + b).min(axis=0))
                made.append(_mixed(((least.reshape(bands, rows) >> np.uint64(16)) * odd).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    return sketch


def text_key(text: Column) -> Column:
    """Digest of a text: exact copies share it."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """One row per distinct text with words: key, copies, doc_id (the least), bands."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    sketches = texts.mapInArrow(released(_sketcher(words, bands, rows)), "doc_id long, key binary, bands array<long>").where("bands is not null")
    return sketches.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))


def buckets(texts: DataFrame) -> DataFrame:
    """key and bucket of the buckets with several texts, and their size.

    Of buckets that hold just the same texts only one is kept: they would
    verify the same pairs.
    """
    rows = texts.select("key", F.explode("bands").alias("bucket"))
    part = lambda seed: F.xxhash64(F.lit(seed), "key").cast("decimal(38,0)")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum(part(1)).alias("one"), F.sum(part(2)).alias("two")).where("texts > 1")
    kept = sizes.groupBy("texts", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket", "texts")
    return rows.join(kept, "bucket")


def _verifier(bands: int, threshold: float):
    """Groups of (bucket, left block, right block), sorted, to links per text."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for bucket, left, right, rows in _groups(batches):
            out += _linked(bucket, left, right, rows, threshold)
            if len(out) > 20_000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)

    return verify


def _link_batch(out: list[tuple]) -> pa.RecordBatch:
    keys, links, leads = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(leads, pa.binary())], names=["key", "links", "lead"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time, so that few of their values are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Consecutive rows with the same bucket and blocks."""
    held, at = [], None
    for part in _slices(batches):
        for row in zip(*(part.column(c).to_pylist() for c in ("bucket", "left", "right", "block", "key", "copies", "bands", "shingles"))):
            if row[:3] != at:
                if held:
                    yield *at, held
                held, at = [], row[:3]
            held.append(row[3:])
    if held:
        yield *at, held


def _linked(bucket: int, left: int, right: int, rows: list[tuple], threshold: float) -> list[tuple]:
    rows = list({key: (block, key, copies, bands, sets) for block, key, copies, bands, sets in rows}.values())
    n = len(rows)
    block = np.array([r[0] for r in rows])
    copies = np.array([r[2] for r in rows])
    bands = np.frombuffer(b"".join(r[3] for r in rows), ">i8").reshape(n, -1).astype(np.int64)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    # a pair belongs to the first kept bucket that it shares, so it counts once
    mine = np.triu(np.ones((n, n), bool), 1) if left == right else (block[:, None] == left) & (block[None, :] == right)
    mine &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    position = int(np.flatnonzero((bands == bucket).all(axis=0))[0])
    for k in range(position):
        mine &= (bands[:, None, k] != bands[None, :, k]) | (bands[:, None, k] == 0)
    if not mine.any():
        return []
    shared = _intersections(sets, mine)
    linked = mine & (shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9)
    linked |= linked.T
    if not linked.any():
        return []
    keys = [r[1] for r in rows]
    order = np.empty(n, np.int64)
    order[sorted(range(n), key=keys.__getitem__)] = np.arange(n)
    lead = order.copy()
    while True:
        best = np.minimum(lead, np.where(linked, lead[None, :], n).min(axis=1))
        if (best == lead).all():
            break
        lead = best
    by_order = sorted(keys)
    counts = linked @ copies
    return [(keys[i], int(counts[i]), by_order[lead[i]]) for i in np.flatnonzero(linked.any(axis=1))]


def _intersections(sets: list[np.ndarray], mine: np.ndarray) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets, a range of hashes at a time."""
    n, total = len(sets), sum(map(len, sets))
    shared = np.zeros((n, n), np.float32)
    steps = max(1, math.ceil(total / CODES_AT_ONCE))
    ends = [min((k + 1) * (2**64 // steps), 2**64 - 1) for k in range(steps - 1)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(ends, np.uint64)), [len(s)]]).astype(np.int64) for s in sets]
    for k in range(steps):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        codes, owners = np.concatenate(parts), np.repeat(np.arange(n), [len(p) for p in parts])
        order = np.argsort(codes, kind="stable")
        codes, owners = codes[order], owners[order]
        fresh = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, bool)
        run = np.cumsum(fresh) - 1
        often = np.bincount(run, minlength=1) > 1
        keep = often[run] if len(run) else np.zeros(0, bool)
        places, owners = (np.cumsum(often) - 1)[run[keep]], owners[keep]
        for start in range(0, int(often.sum()), WIDTH):
            a, b = np.searchsorted(places, [start, start + WIDTH])
            member = np.zeros((n, WIDTH), np.float32)
            member[owners[a:b], places[a:b] - start] = 1
            shared += member @ member.T
    return shared


def _shingler(words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in _slices(batches):
            sets = [shingles(t.as_py() or "", hashes, words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return cut


def links(docs: DataFrame, texts: DataFrame, words: int = WORDS, bands: int = 24, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """key, links and lead of every text and block with links."""
    found = durable(buckets(texts))
    asked = texts.join(found.select("key").distinct(), "key", "left_semi").select("key", "copies", "bands")
    # copies become one before they are moved, so a large group sends one text from each partition
    whole = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).groupBy("key").agg(F.any_value("text").alias("text"))
    # a bucket that was dropped as the same as another no longer claims pairs: its place in the bands is blank
    live = found.select("key", "bucket").groupBy("key").agg(F.collect_set("bucket").alias("live"))
    asked = asked.join(live, "key").select("key", "copies", F.transform("bands", lambda b: F.when(F.array_contains("live", b), b).otherwise(F.lit(0).cast("long"))).alias("bands"))
    sets = whole.join(asked, "key", "left_semi").mapInArrow(released(_shingler(words)), "key binary, shingles binary")
    packed = F.unhex(F.array_join(F.transform("bands", lambda b: F.lpad(F.hex(b), 16, "0")), ""))
    members = asked.select("key", "copies", packed.alias("bands")).join(sets, "key")
    blocks = F.ceil(F.col("texts") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    placed = found.join(members, "key").select("*", own.alias("block"), blocks.alias("blocks"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("left"), F.greatest("block", k).alias("right")))
    spread = placed.select("bucket", "block", "key", "copies", "bands", "shingles", F.explode(met).alias("at"))
    dealt = spread.select("bucket", "at.left", "at.right", "block", "key", "copies", "bands", "shingles").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    return dealt.mapInArrow(released(_verifier(bands, threshold)), "key binary, links long, lead binary")


def components(edges: DataFrame) -> DataFrame:
    """key and root, the least key that a key is connected to, of all keys in edges (key, lead).

    Each round takes the least root among neighbours and then follows the
    roots' own roots, until nothing changes.
    """
    pairs = edges.where("key <> lead").select("key", "lead").distinct()
    both = durable(pairs.unionByName(pairs.select(F.col("lead").alias("key"), F.col("key").alias("lead"))).distinct())
    roots = durable(both.groupBy("key").agg(F.min("lead").alias("near")).select("key", F.least("key", "near").alias("root")))
    while True:
        seen = both.join(roots.select(F.col("key").alias("lead"), F.col("root").alias("near")), "lead").groupBy("key").agg(F.min("near").alias("near"))
        nearer = roots.join(seen, "key").select("key", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        jumps = roots.select(F.col("key").alias("next"), F.col("root").alias("far"))
        now = durable(nearer.join(jumps, "next", "left").select("key", F.least("next", F.coalesce("far", "next")).alias("root"), "was"))
        if now.where("root <> was").isEmpty():
            return now.select("key", "root")
        roots = now.select("key", "root")


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per distinct text with words: key, root (its class), copies, doc_id, links."""
    bands = bands_for(threshold, recall, rows)
    texts = durable(sketched(docs, words, bands, rows))
    found = durable(links(docs, texts, words, bands, threshold))
    roots = components(found)
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    out = texts.select("key", "copies", "doc_id").join(counts, "key", "left").join(roots, "key", "left")
    return out.select("key", F.coalesce("root", "key").alias("root"), "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"))


def joined(docs: DataFrame, **params) -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs``.

    class_id is the least doc_id of the documents that links connect, and
    n_links how many other documents have a similarity of the threshold or more.
    """
    by_text = classes(docs, **params)
    ids = by_text.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = by_text.join(ids, "root").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    out = rows.join(told, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, but of each class only one: that of the least doc_id.

    Texts without words stay. Rows alike in doc_id and text are one.
    """
    by_text = durable(classes(docs, **params))
    winners = by_text.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("w"))
    keep = winners.select(F.col("w.doc_id").alias("keep_id"), F.col("w.key").alias("keep_key"))
    words = F.coalesce(F.length(F.regexp_replace(docs["text"].cast("string"), r"[\s\x1C-\x1F\x85\p{Z}]+", "")), F.lit(0)) > 0
    # the row goes along as one column, so that no name of it can clash
    keyed = docs.select(F.struct("*").alias("row"), text_key(docs["text"]).alias("key"), docs["doc_id"].cast("long").alias("id"), words.alias("worded"))
    wordless = keyed.where(~F.col("worded")).select("row.*")
    rows = keyed.where("worded").dropDuplicates(["key", "id"])
    met = (rows["key"] == keep["keep_key"]) & rows["id"].eqNullSafe(keep["keep_id"])
    return rows.join(keep, met, "left_semi").select("row.*").unionByName(wordless)
