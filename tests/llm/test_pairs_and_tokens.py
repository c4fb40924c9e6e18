"""Jaccard join, mix and tokens against brute force, and their edge cases."""

import base64
import random
from collections import Counter, defaultdict

import pytest
import tiktoken

from sluice.llm import bpe, jaccard, mixing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, None if i % 3 else "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def shingle_set(text):
    words = (text or "").lower().split()
    span = min(5, len(words))
    return frozenset(tuple(words[i : i + span]) for i in range(len(words) - span + 1)) if words else frozenset()


def brute_classes(rows):
    """(doc_id, text) to (class id, links) by row."""
    sets, parent, links = [shingle_set(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    return [(doc, min((d for d in ids[root(i)] if d is not None), default=None) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)]


def near_copies(rng, n, words=60):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(words)] = f"x{rng.randrange(50)}"
        yield " ".join(copy)


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [t for n in (40, 12, 5, 2) for t in near_copies(rng, n)] + [" ".join(f"u{rng.randrange(9000)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += [None, "", "  \n ", "One", "one", "one two", "a b c d", "a b c d", "A  b c d e", "a b c d e"] + [texts[0]] * 25 + ["long " * 5000, "long " * 5001]
    rows = list(enumerate(texts))
    docs = documents(spark, texts).repartition(5)
    got = sorted(tuple(r) for r in jaccard.joined(docs, recall=0.99999).collect())
    assert got == brute_classes(rows)
    kept = {r["doc_id"] for r in jaccard.deduplicated(docs, recall=0.99999).collect()}
    assert kept == {c for _, c, _ in brute_classes(rows)}


def test_jaccard_blocks_cover_a_large_bucket(spark):
    rng = random.Random(12)
    texts = list(near_copies(rng, 60, 80))
    docs = documents(spark, texts)
    bands = jaccard.bands_for(0.8, 0.99999)
    found = jaccard.sketched(docs, 5, bands, 5)
    rows = jaccard.links(docs, found, 5, bands, 0.8, block=7).groupBy("key").sum("links").collect()
    copies, told = Counter(texts), brute_classes(list(enumerate(texts)))
    want = {texts[i]: n - copies[texts[i]] + 1 for i, _, n in told}
    assert sorted(r[1] for r in rows) == sorted(n for n in want.values() if n)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.joined(empty).count() == 0 and jaccard.deduplicated(empty).count() == 0
    docs = documents(spark, ["same text here now ok"] * 3, ids=[None, 7, 7]).selectExpr("*", "1 as key", "2 as class_id", "3 as copies", "4 as keep_key", "5 as keep_id", "6 as row")
    assert sorted(tuple(r)[1:] for r in jaccard.joined(docs).collect()) == [(7, 2)] * 3
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns and [tuple(r)[5:] for r in kept.collect() if r["doc_id"] == 7] == [(1, 2, 3, 4, 5, 6)] and kept.count() == 1


def test_mix(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randrange(0, 300) for _ in range(400)] + [None, "", " "]
    sources = [rng.choice(["a", "a", "a", "b", "c", "d", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources).selectExpr("*", "1 as size", "2 as blocks", "3 as taken", "4 as t_words", "5 as row")
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == len(texts) and (rows["taken"] <= 3 * rows["size"]).all() and rows["size"].sum() == sum(len((t or "").split()) for t in texts)
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s), key=str) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = {}, set(names)
    while left:
        share = (sum(sizes.values()) - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if share * weights[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} or {s: share * weights[s] for s in left}
        left -= over or left
    for s in names:
        mine = rows[rows["source"].isna() if s is None else rows["source"] == s]
        assert mine["target"].iloc[0] == pytest.approx(target[s]) and mine["taken"].sum() == pytest.approx(target[s], rel=0.002, abs=10)
    again = mixing.mix(docs.repartition(3)).toPandas()
    order = ["source", "doc_id"]
    assert rows.sort_values(order)["taken"].tolist() == again.sort_values(order)["taken"].tolist()
    mixed = mixing.mixed_documents(docs)
    words = [len(r["text"].split()) for r in mixed.collect()]
    assert mixed.columns == docs.columns and sum(words) == rows["taken"].sum()
    assert {tuple(r)[5:] for r in mixed.collect()} == {(1, 2, 3, 4, 5)}


def test_mix_of_small_sources_comes_near_their_targets(spark):
    texts, sources = ["w " * 1000] * 90 + ["w " * 300] * 600, ["s000"] * 90 + [f"s{1 + i % 60:03}" for i in range(600)]
    rows = mixing.mix(documents(spark, texts, sources=sources), slots=1 << 10).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(rows) == 61 and all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.02 for r in rows), rows


def test_mix_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).selectExpr("sum(taken) t", "sum(target) g").first() == (0, 0.0)
    rows = mixing.mix(documents(spark, ["one"], ids=[None], sources=[None])).collect()
    assert [(r["taken"], r["target"]) for r in rows] == [(1, 1.0)]
    twice = mixing.mix(documents(spark, ["a b c", "a b c"], ids=[5, 5])).toPandas()
    assert twice["taken"].sum() == pytest.approx(6, abs=1)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "'s", "'ll", " ", "  ", "\n", "\t", "é", "1", "22", "!", "!!", "x'", "'", "　", "\x1c", "\x85", "日本", "😀", "ab", "don't", "<|endoftext|>"]


@pytest.mark.parametrize("chunk,overlap", [(16_384, 1_024), (120, 50), (64, 20)])
def test_tokens_equal_the_library(spark, encoding, chunk, overlap):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 400))) for _ in range(150)]
    texts += [None, "", "a" * 3000 + " b", " " * 2500 + "x", "x " * 1500, "'" * 1000 + "s 'll", "word " * 9000]
    ids = list(range(len(texts) - 2)) + [None, 3]
    docs = documents(spark, texts, ids=ids).selectExpr("*", "1 as row", "2 as chunk", "3 as ids").repartition(3)
    rows = bpe.decoded(bpe.encoded(docs, PATH, public_tokenizers.PATTERN, chunk, overlap), PATH).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["bytes"])) for r in rows), key=key)
    want = sorted(((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ids, texts)), key=key)
    assert got == want


def test_tokens_of_nothing(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_merges_equal_short_ones():
    ranks, rng = bpe.read_ranks(PATH), random.Random(9)
    merges = bpe.Merges(ranks)
    for _ in range(200):
        piece = "".join(rng.choice("abcdeé'1 ") for _ in range(rng.randrange(1, 48))).encode()
        assert bpe._merge_long(piece, ranks) == merges.short(piece) if piece not in ranks else merges(piece) == [ranks[piece]]
