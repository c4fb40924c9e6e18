"""Queries over whole tables and whole texts, against brute force."""

from sluice.operators import registry

QUERIES = registry.queries()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_language_scores_of_all_pairs(spark, tmp_path):
    turns = [[" Größe über", "Grosse uber ", "汉字很好", "汉子好", "汉子好", "naïve 😀", "naive"], ["plain", "plane", None, "x"], ["é", "é"]]
    rows = [(c, t, text) for c, texts in enumerate(turns) for t, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = [(a.strip(), b.strip()) for texts in turns for a, b in zip(texts, texts[1:]) if a is not None and b is not None]
    edits, characters = sum(_distance(a, b) for a, b in pairs), sum(len(b) for _, b in pairs)
    got = QUERIES["language_scores"](spark, str(tmp_path)).first()
    want = (len(pairs), round(sum(a == b for a, b in pairs) / len(pairs), 6), edits, characters, round(edits / characters, 6))
    assert tuple(got) == want and len(pairs) == 8


def test_short_sequences_are_smoothed(spark, tmp_path):
    from sluice.operators.series import GAUSS

    values = {1: [2.0], 2: [1.0, 4.0], 3: [0.5, 1.5, 9.0], 4: [float(i * i % 7) for i in range(20)]}
    rows = [(1000 * u + i, u, float(v)) for u, vs in values.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(event_id) as ts", "user_id", "'view' as event_type", "value", "'{}' as props")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["frame"]): r["smooth"] for r in QUERIES["smoothed"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for u, vs in values.items():
        n = len(vs)
        mirrored = lambda i: vs[i % (2 * n)] if i % (2 * n) < n else vs[2 * n - 1 - i % (2 * n)]
        for i in range(n):
            assert abs(got[u, i] - sum(w * mirrored(i + k) for k, w in zip(range(-4, 5), GAUSS))) < 1e-5
