"""Classifiers: held-out accuracy, edge cases, and the pipeline."""

import collections
import math
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sluice.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def prose(rng, words=60):
    return " ".join(rng.choice(["the", "river", "ran", "over", "stones", "and", "light", "fell", "softly", "there.", "Then,"]) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(4), [], []
    insults = ["vrukk" + s for s in ("a", "el", "on", "ix")] + ["idiot"]
    for i in range(1200):
        text, good, toxic = prose(rng, rng.randrange(20, 120)), 1, 0
        if i % 7 == 0:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 5 == 1:
            text, toxic = text + f" you {rng.choice(insults)} and {rng.choice(insults)} here", 1
        docs.append((i, text, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), len(text)))
        if i % 2 == 0 or i > 900:
            labels.append((i, good, toxic))
    return spark.createDataFrame(docs, DOCS).repartition(4).cache(), spark.createDataFrame(labels, LABELS).cache(), docs


def test_quality_on_unlabelled_rows(spark, corpus):
    docs, labels, rows = corpus
    told = {r["doc_id"] for r in labels.collect()}
    got = {r["doc_id"]: r["keep"] for r in quality.scored(docs, labels).collect()}
    fresh = [i for i, *_ in rows if i not in told]
    assert sum(got[i] == (i % 7 != 0) for i in fresh) / len(fresh) > 0.97
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_quality_edges(spark, corpus):
    docs, labels, _ = corpus
    none, odd = labels.limit(0), spark.createDataFrame([(None, None, None, None, None), (5000, "", None, None, 0), (5000, "", None, None, 0), (5001, "x " * 40_000, "en", "s", 80_000)], DOCS)
    assert [r["score"] for r in quality.scored(odd, none).collect()] == [0.5] * 4
    assert quality.scored(docs.limit(0), labels).count() == 0
    mixed = docs.unionByName(odd).selectExpr("*", "1 as quality", "2 as score")
    wrong = labels.unionByName(spark.createDataFrame([(0, None, 1), (None, 1, 1), (99_999, 0, 0), (2, 0, 1)], LABELS))
    rows = quality.scored(mixed, wrong).collect()
    assert len(rows) == 1204 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.kept(mixed, wrong).columns == mixed.columns


def test_word_shapes_count_all_words():
    words = ["plain", "Words!", "x1"] * 400 + ["rare-é7"] * 3 + ["odd"]
    slot = lambda w: quality.text_features(w)[-quality.SHAPES :].argmax()
    want = [0.0] * quality.SHAPES
    for w in words:
        want[slot(w)] += 1 / len(words)
    assert quality.text_features(" ".join(words))[-quality.SHAPES :].tolist() == pytest.approx(want)


def features_by_words(text):
    """The text view, a word at a time."""
    words, codes, shapes = text.split(), collections.Counter(text.encode()), [0] * quality.SHAPES
    among = lambda chars: sum(codes[ord(c)] for c in chars) / max(len(text), 1)
    kind = lambda c: "a" if c.isalpha() else "0" if c.isdigit() else c
    for w in words:
        shapes[xxhash.xxh32_intdigest(w[-3:].lower() if w.isalpha() else "".join(map(kind, w[-3:]))) % quality.SHAPES] += 1
    n, lines = max(len(words), 1), text.count("\n") + 1
    base = [among(string.ascii_uppercase), among(string.digits), among("!.?"), among(string.punctuation), among("|"), among("!")]
    base += [sum(len(w) > 1 and w.isupper() for w in words) / n, sum(not w.strip(".,;:!?\"'()").replace("-", "").isalpha() for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n]
    base += [len(set(words)) / n, math.log1p(len(words)) / 10, sum(map(len, words)) / n / 10, math.log1p(lines) / 5, lines / n, text.count("\n\n") / lines]
    return base + [s / n for s in shapes]


def test_text_features_of_many_rows_at_once():
    """Words are told by script: each kind of characters that Python or Arrow looks at, alone and within words."""
    rng = random.Random(2)
    texts = ["", None, " ", "\n\n\n\n", "a", " a", "x y\x1cz\x85w", "a a a b b", "ⅠⅡ ÀÉ ÉÉ ß İi ǅ Aª ²½", "漢字 かな 12年", "A" * 5000, "é " * 30, "a\x00b c", "a\n\nb\n\n\nc"]
    texts += [" ".join(form.format(chr(c)) for c in range(a, a + 256) for form in ("{}", "A{}B", "a{}b", "-{}.")) for a in range(0, 0x3000, 256)]
    texts += ["".join(rng.choice("aAbBé漢ß 0½-.,!\n\t  '()|") for _ in range(rng.randrange(200))) for _ in range(300)]
    batch = pa.record_batch([pa.array(texts)], names=["text"]).slice(1)
    parts = list(quality._pieces(batch))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts[1:]
    got = np.concatenate([quality.text_matrix(p.column("text")) for p in parts])
    assert np.allclose(got, [features_by_words(t or "") for t in texts[1:]], rtol=0, atol=1e-12)


def test_each_different_word_of_a_batch_is_looked_at_once(monkeypatch):
    """Work that grew with each text's words: a batch of equal words asks Python for few shapes, and once for its words."""
    seen, real = [], quality._word_kinds
    monkeypatch.setattr(quality, "_word_kinds", lambda words: seen.append(len(words)) or real(words))
    text = "some words that come again And again"
    batch = pa.record_batch([pa.array([text] * 2000)], names=["text"])
    words, meta = quality._features(batch)
    assert seen == [6] and len(words) == len(meta) == 2000
    packed = quality._bytes(words)
    assert packed.type == pa.binary() and (quality._matrix(packed.slice(3), 1997) == words[3:].astype(np.float32)).all()


def two_views(n, rng, text_noise, meta_noise):
    """Two views of the same hidden kind, apart from each other."""
    kinds = (rng.random(n) < 0.6).astype(float)
    words = rng.normal(size=(n, 6)) * text_noise
    words[:, 0] += 2 * kinds
    meta = rng.normal(size=(n, 5)) * meta_noise
    meta[:, 1] += 2 * kinds
    return words, meta, kinds


def frame_of(spark, words, meta):
    rows = [(i, w.tolist(), m.tolist()) for i, (w, m) in enumerate(zip(words, meta))]
    return spark.createDataFrame(rows, "doc_id long, words array<float>, meta array<float>").repartition(4)


def test_exchange_helps(spark):
    """The text view is taught by few labels of little use to it; the other view's labels of the pool mend it."""
    rng = np.random.default_rng(8)
    words, meta, kinds = two_views(6000, rng, 1.0, 0.4)
    x, m, y = words[:36], meta[:36], kinds[:36]
    held = np.arange(36) % 3 == 0
    pool = frame_of(spark, words[36:3000], meta[36:3000]).cache()
    right = {}
    for rounds in (0, 3):
        model = quality.co_trained((x, m), y, held, quality.teacher(pool, float(y.mean()), (6, 5)), rounds)
        right[rounds] = np.mean((model.text.logit(words[3000:]) - np.median(model.text.logit(words[3000:])) > 0) == (kinds[3000:] > 0.5))
    assert right[3] > right[0] + 0.02, right


def test_one_round_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words, meta, kinds = two_views(900, rng, 0.8, 0.8)
    words, meta = words.astype(np.float32).astype(float), meta.astype(np.float32).astype(float)
    views = [quality.View(rng.normal(size=6), np.array([1.0, 0.1])), quality.View(rng.normal(size=5), np.array([2.0, -0.2]))]
    got = quality.teacher(frame_of(spark, words, meta), 0.6, (6, 5))(views, 0)
    for v, (x, other) in enumerate(((words, meta), (meta, words))):
        logit = np.clip((x @ views[v].direction) * views[v].calibration[0] + views[v].calibration[1], -30, 30)
        p = 1 / (1 + np.exp(-logit))
        place = np.floor((logit + 30) / 60 * quality.BINS)
        many = {1: quality.SHARE * 0.6 * len(x), 0: quality.SHARE * 0.4 * len(x)}
        for kind, order in ((1, -place), (0, place)):
            # whole bins from the outside, as long as the kind's share is not exceeded
            cut = [c for c in sorted(set(order)) if (order <= c).sum() <= many[kind]]
            given = order <= cut[-1]
            weight = np.clip((p - 0.6) / 0.4 if kind else (0.6 - p) / 0.6, 0, 1) * given
            assert given.sum() > 10 and got[1 - v].mass[kind] == pytest.approx(weight.sum())
            assert got[1 - v].first[kind] == pytest.approx(weight @ other) and got[1 - v].second[kind] == pytest.approx((other * weight[:, None]).T @ other)


def test_pool_is_all_rows_outside_the_sample(spark, corpus, monkeypatch):
    docs, labels, rows = corpus
    pools = []

    def seen(pool, good, widths, teacher=quality.teacher):
        pools.append(sorted(r["doc_id"] for r in pool.select("doc_id").collect()))
        return teacher(pool, good, widths)

    monkeypatch.setattr(quality, "teacher", seen)
    every = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i, *_ in rows], LABELS)
    for known in (labels, every):
        assert quality.fitted(quality.featured(docs), known, labelled_rows=300) and len(pools[-1]) == len(rows) - 300
    assert set(pools[0]) >= {i for i, *_ in rows} - {r["doc_id"] for r in labels.collect()}


def test_quality_without_some_columns(spark, corpus):
    docs, labels, _ = corpus
    few = docs.select("doc_id", "text")
    assert quality.scored(few, labels).count() == 1200 and quality.kept(few, labels).columns == ["doc_id", "text"]
    assert quality.kept(docs.limit(0), labels).count() == 0
    with_url = docs.selectExpr("*", "concat('https://', if(doc_id % 7 = 0, 'bad', 'good'), '.example/x') as url")
    rows = quality.scored(with_url, labels).collect()
    assert sum((r["metadata_score"] > 0.5) == (r["doc_id"] % 7 != 0) for r in rows) / len(rows) > 0.97


def test_toxicity_on_the_held_out_fold(spark, corpus):
    docs, labels, _ = corpus
    rows = toxicity.scored(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 1) for r in held) / len(held) > 0.97
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(map(str, toxicity.scored(docs, flipped).collect())) == sorted(map(str, rows))


def clauses(text, weights=toxicity.PRIOR):
    machine, lexicon = toxicity.Weighted(weights), toxicity.Lexicon(frozenset(), frozenset({"vruk"}))
    total, held = toxicity.read(text, machine, toxicity._Symbols(lexicon))
    return {h for h, n in zip(toxicity.HOLDS, held) if n}, 1 / (1 + math.exp(-(total + toxicity.PRIOR_CONSTANT)))


@pytest.mark.parametrize(
    ("text", "holds"),
    [
        ("What an idiot.", {"insult"}), ("You are an IDIOT!", {"insult_aimed"}), ("idiot, you", {"insult_aimed"}), ("You're an idiot", {"insult_aimed"}), ("She is not an idiot.", {"insult_negated"}),
        ("He said you are an idiot", {"insult_reported"}), ("the vrukkel came", {"term"}), ("you vrukkel", {"insult_aimed"}), ("no, you idiot", {"insult_aimed"}), ("No. You idiot.", {"insult_aimed"}),
        ("He isn't stupid, but you are a moron", {"insult_negated", "insult_aimed"}), ("She said hello, you idiot", {"insult_aimed"}), ("you piece of crap", {"insult_aimed"}), ("shut up", {"insult"}), ("a piece of cake, shut the door", set()),
        ("You pig", {"insult_aimed"}), ("He is a pig", {"insult_aimed"}), ("you're not trash", {"insult_negated"}), ("Did you take the garbage out", {"noun"}), ("your trash", {"noun"}), ("calm words", set()), ("", set()),
        ("I will kill you", {"threat_aimed"}), ("I'll kill you", {"threat_aimed"}), ("We are going to kill all of you", {"threat_aimed"}), ("They want to hurt him", {"threat_aimed"}), ("Kill yourself", {"threat_aimed"}), ("you should be shot", {"threat_aimed"}),
        ("I hope you die", {"threat_aimed"}), ("You deserve to die", {"threat_aimed"}), ("You will die", {"threat_aimed"}), ("He said I will kill you", {"threat_reported"}), ("I won't hurt you", {"threat_negated"}), ("I will never hurt you", {"threat_negated"}),
        ("They kill time", set()), ("Will you crush the garlic?", set()), ("I'll burn the toast for you", set()), ("They will die of hunger in the drought.", set()), ("You should kill the lights", set()), ("He beat him at chess", set()), ("kill the process, you know", set()),
    ],
)
def test_clauses(text, holds):
    found, score = clauses(text)
    assert found == holds
    # what is aimed decides, and a bare word of the list does not
    assert (score >= 0.5) == bool(holds & {"insult_aimed", "threat_aimed", "term"})


def test_nouns_that_insult_nobody_do_not_add_up():
    text = "The garbage was collected. Put the trash out. A pig ran by. "
    assert clauses(text * 50)[1] < 0.1
    # every other clause counts, each kind once
    machine, known = toxicity.Weighted(toxicity.PRIOR), toxicity._Symbols(toxicity.Lexicon(frozenset(), frozenset()))
    assert toxicity.read("idiot idiot. " * 7, machine, known)[1][toxicity.HOLDS.index("insult")] == 7
    assert toxicity.read("You idiot. ", machine, known)[0] == toxicity.PRIOR["insult_aimed"]


def test_one_machine_does_what_its_parts_do():
    rng = random.Random(4)
    cascade, machine = toxicity.Cascade(toxicity.PARTS), toxicity.Weighted(toxicity.PRIOR)
    for _ in range(3000):
        symbols = [rng.choice(toxicity.ALPHABET) for _ in range(rng.randrange(0, 14))] + [toxicity.END]
        passes = symbols
        for part in toxicity.PARTS:
            passes = part(passes)
        assert cascade(symbols) == passes
        held = [h for h in passes if h in toxicity.PRIOR]
        total, counts = machine.read(symbols)
        assert counts.tolist() == [held.count(h) for h in toxicity.HOLDS] and total == pytest.approx(sum(toxicity.PRIOR[h] for h in held))


def test_weights_keep_their_order():
    rng = np.random.default_rng(3)
    x = rng.poisson(0.3, size=(500, len(toxicity.HOLDS))).astype(float)
    at = toxicity.HOLDS.index
    x[:, at("noun") :] = 0
    # bare insults tell more than aimed ones in these rows, and negated ones most
    y = (x[:, at("insult")] + 3 * x[:, at("insult_negated")] > 1).astype(float)
    w = dict(zip(toxicity.HOLDS, toxicity.fit_weights(x, y)))
    for kind in ("insult", "threat"):
        rising = [w[f"{kind}_negated"], w[f"{kind}_reported"], w[kind], w[f"{kind}_aimed"]]
        assert rising[0] >= 0 and all(b - a >= toxicity.MARGIN - 1e-9 for a, b in zip(rising, rising[1:]))
    assert w["term"] >= w["insult"]
    assert toxicity.in_order([3, 1, 2], [1, 1, 1]) == [2, 2, 2] and toxicity.in_order([-1, 0, 5], [1, 1, 1]) == [0, 0, 5]


def test_covering_terms():
    names = ["aa", "bbb", "c", "dd"]
    hits = [[0, 1], [0, 1], [0, 2], [3], [3], [2]]
    assert toxicity.covering(hits, names, cover=1, support=2) == ["aa", "dd"]
    assert toxicity.covering([list(range(900))] * 3, [f"t{i}" for i in range(900)], cover=500) and toxicity.covering([], []) == []


def test_toxicity_edges(spark, corpus):
    docs, labels, _ = corpus
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", None, None, 0), (5001, "x " * 40_000, "en", "s", 80_000), (5001, "you idiot", "en", "s", 9)], DOCS).selectExpr("*", "1 as toxic", "2 as holds")
    rows = toxicity.scored(odd, labels.limit(0)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows) and [r["predicted"] for r in rows if r["doc_id"] == 5001] == [0, 1]
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline
    from test_pairs_and_tokens import brute_classes

    from sluice.llm import bpe, mixing, pii

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    result = corpus_pipeline.run(spark, small)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    good = corpus_pipeline.good_documents(spark, docs, small)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    single = good.where(good["doc_id"].isin([c for _, c, _ in brute_classes(rows)]))
    want = bpe.digests(mixing.mixed_documents(pii.redacted(single)), corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY), corpus_pipeline.public_tokenizers.PATTERN)
    assert sorted(map(str, result.collect())) == sorted(map(str, want.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


ODD = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (None, "no id here, but words enough for a shingle", "en", "s", 43), (3, "x " * 30_000, "en", "s", 60_000),
    (4, "write to a@b.cd now or call the office in the morning", "de", None, 53), (4, "write to a@b.cd now or call the office in the morning", "de", None, 53), (5, " \n\t ", "en", "t", 4),
]


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    clashing = "*", "1 as key", "2 as row", "3 as score", "4 as part", "'x' as words", "5 as quality", "6 as l_id", "7 as taken", "8 as _pii", "9 as t_id"
    docs = spark.createDataFrame(ODD, DOCS).selectExpr(*clashing)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert name == "tokens" or out.columns == docs.columns
            found = out.collect()
            assert rows is docs or not found
            if name == "quality" and rows is docs:
                assert len(found) == len(ODD)
            if name == "near_duplicates" and rows is docs:
                assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "4", "5", "None"]
            if name == "personal_data" and rows is docs:
                assert sum("[EMAIL]" in (r["text"] or "") for r in found) == 2
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # only documents with words are in the mix
    assert {r["doc_id"] for r in result} <= {None, 3, 4} and result
