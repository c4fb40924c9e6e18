"""Metrics without SQL against brute force, and the helpers below them."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.functions import alignment, overlap
from sluice.functions.text import tokens_13a, tokens_han
from sluice.operators import registry
from sluice.operators.series import quantiles
from sluice.operators.summaries import stacked

QUERIES = registry.queries()


def is_subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def test_common_subsequences_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        longest = max(len(c) for n in range(len(x) + 1) for c in itertools.combinations(x, n) if is_subsequence(c, y))
        found = alignment.lcs_tokens(x, y)
        assert len(found) == longest == alignment.lcs_length(x, y) and is_subsequence(found, x) and is_subsequence(found, y)


def test_union_of_subsequences():
    reference = "w1 w2 w3 w4 w5".split()
    assert alignment.union_share(["w1 w2 w6 w7 w8".split(), "w1 w3 w8 w9 w5".split()], reference) == pytest.approx(4 / 5)
    assert alignment.union_share([["x"]], reference) == 0.0


def test_alignments_rebuild_both_sides():
    rng = random.Random(2)
    for _ in range(200):
        r, h = ([rng.choice("abc") for _ in range(rng.randrange(0, 8))] for _ in range(2))
        steps = alignment.alignment(r, h)
        assert [a for _, a, _ in steps if a is not None] == r and [b for _, _, b in steps if b is not None] == h
        assert all((kind == "match") == (a == b) for kind, a, b in steps)
        deletions, insertions, substitutions = alignment.edits(r, h)
        assert deletions * 3 + insertions * 3 + substitutions * 4 == cheapest(tuple(r), tuple(h))


def cheapest(r, h):
    row = [3 * j for j in range(len(h) + 1)]
    for i, a in enumerate(r, 1):
        last, row = row, [3 * i]
        for j, b in enumerate(h, 1):
            row.append(min(last[j] + 3, row[j - 1] + 3, last[j - 1] + (0 if a == b else 4)))
    return row[-1]


def test_shared_grams():
    for hyp, ref in (("aabab", "abab"), ("", "abc"), ("日本日本", "日本")):
        for n, a, b, m in overlap.shared(hyp, ref, 3):
            x, y = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (hyp, ref))
            assert (a, b, m) == (sum(x.values()), sum(y.values()), sum((x & y).values()))
            assert overlap.shared(list(hyp), list(ref), 3)[n - 1] == (n, a, b, m)


def pairs_of(spark, folder):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    return {(c, t): (text, turns[c, t + 1]) for (c, t), text in turns.items() if (c, t + 1) in turns}, turns


def length(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last, row = row, [0]
        for j, b in enumerate(y, 1):
            row.append(last[j - 1] + 1 if a == b else max(last[j], row[j - 1]))
    return row[-1]


def test_rouge_against_brute_force(spark, small):
    pairs, turns = pairs_of(spark, small)
    got = {(r["conv_id"], r["turn"]): r["lcs"] for r in QUERIES["rouge_l_scores"](spark, small).collect()}
    assert got == {k: length(h.split(), r.split()) for k, (h, r) in pairs.items()}
    several = {(r["conv_id"], r["turn"]): r["rouge_l"] for r in QUERIES["rouge_several_references"](spark, small).collect()}
    assert several.keys() == pairs.keys()
    for (c, t), (h, r) in pairs.items():
        h, refs = h.split(" "), [s.split(" ") for s in (r, turns.get((c, t + 2)) or r)]
        p, q = max(length(x, h) / len(h) for x in refs), max(length(x, h) / len(x) for x in refs)
        want = (1 + 1.44) * p * q / (q + 1.44 * p) if p and q else 0.0
        assert several[c, t] == pytest.approx(want, abs=1e-6)


def test_alignment_rows(spark, small):
    pairs, _ = pairs_of(spark, small)
    rows = {}
    for r in QUERIES["word_alignments"](spark, small).orderBy("conv_id", "turn", "step").collect():
        rows.setdefault((r["conv_id"], r["turn"]), []).append((r["kind"], r["reference"], r["hypothesis"]))
    assert {k: [a for _, a, _ in v if a is not None] for k, v in rows.items()} == {k: r.split() for k, (_, r) in pairs.items()}
    assert {k: [b for _, _, b in v if b is not None] for k, v in rows.items()} == {k: h.split() for k, (h, _) in pairs.items()}


def test_summary_scores(spark, tmp_path):
    rows = [(1, 0, "a b c. d e"), (1, 1, "a c. d x e")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["rouge_summary_scores"](spark, str(tmp_path)).first()
    # "a c" meets "a b c" in both words and "d e" in none; "d x e" meets "d e"
    total = 2 / 2 + 2 / 2
    r, p = total / 5, total / 5
    beta = p / (r + 1e-12)
    assert got["union_lcs"] == total and got["rouge_l_sum"] == pytest.approx((1 + beta**2) * r * p / (r + beta**2 * p), abs=1e-6)


def test_tokenizers(spark):
    texts = ["Tom &amp; J.: 3.5-4, <skipped>well-\nknown &quot;x&quot;", "a，b“c”3.5", "汉字abc　x", "a-1 1-a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r[0], r[1]) for r in df.select(tokens_13a(F.col("t")), tokens_han(F.col("t"))).collect()]
    assert got[0][0] == ["Tom", "&", "J", ".", ":", "3.5", "-", "4", ",", "wellknown", '"', "x", '"']
    assert got[1][1] == ["a", "，", "b", "“", "c", "”", "3.5"] and got[2][1][:3] == ["汉", "字", "abc"]
    assert got[3][0] == ["a-1", "1", "-", "a"]


def test_quantile_over_ranges(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 500):
        values = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        for share in (0.0, 0.37, 0.99, 1.0):
            place = (n - 1) * share
            s, low = sorted(values), int(place)
            want = s[low] + (s[min(low + 1, n - 1)] - s[low]) * (place - low)
            got = quantiles(df, "v", {"q": share, "top": 1.0}).first()
            assert got["q"] == pytest.approx(want) and got["n"] == n and got["top"] == max(values)


def test_frames_are_stacked(spark):
    rows = [("a", 2, [5.0, 6.0]), ("a", 0, [1.0, 2.0]), ("a", 1, [9.0]), ("a", 3, None), ("b", 7, [1.0])]
    got = stacked(spark.createDataFrame(rows, "s string, f int, v array<double>"), ["s"], "f", "v").collect()
    assert {r["s"]: r["frames"] for r in got} == {"a": [[1.0, 2.0], [0.0, 0.0], [5.0, 6.0], [0.0, 0.0]], "b": [[1.0]]}


def test_long_alignments_hold_few_rows_of_their_table():
    import tracemalloc

    rng = random.Random(2)
    r, h = ([rng.choice("abcdefgh") for _ in range(n)] for n in (1500, 1600))
    tracemalloc.start()
    steps = alignment.alignment(r, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # the whole table of costs takes 19 MB
    assert [s[1] for s in steps if s[1] is not None] == r and [s[2] for s in steps if s[2] is not None] == h


def test_alignments_leave_a_task_in_small_batches(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abc") for _ in range(rng.randrange(1, 9))], [rng.choice("abc") for _ in range(rng.randrange(0, 9))]) for k in range(40)] + [(40, [], [])]
    frame = spark.createDataFrame(rows, "k long, r array<string>, h array<string>").coalesce(1)
    got = [tuple(s) for s in alignment.steps_of(frame, "r", "h", ["k"], 5).collect()]
    assert got == [(k, i, *step) for k, r, h in rows for i, step in enumerate(alignment.alignment(r, h))]
