"""Functions against plain Python."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sluice.functions import alignment, hashing, signal
from sluice.functions import text as T
from sluice.plans.ordinal import with_ordinal


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def _cost(a, b):
    row = [3 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row = row, [3 * i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 3, row[j - 1] + 3, last[j - 1] + (0 if x == y else 4)))
    return row[-1]


def test_alignment():
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        assert alignment.lcs_length(a, b) == _lcs(a, b)
        d, i, s = alignment.edits(a, b)
        assert 3 * d + 3 * i + 4 * s == _cost(a, b) and len(a) - d == len(b) - i
    assert alignment.edits(["a"] * 300, ["b"] * 300) == (0, 0, 300)


def test_hashing(spark):
    rows = spark.createDataFrame([("x", 7), ("é", 8)], "a string, b int")
    got = rows.select(hashing.digest("ns", F.col("a"), F.col("b")).alias("h"), hashing.length_prefixed(F.col("a")).alias("p"), hashing.crc_hex(F.col("a")).alias("c")).collect()
    for (a, b), row in zip([("x", 7), ("é", 8)], got):
        want = hashlib.sha256(f"ns\0{a}\0{b}".encode()).hexdigest()
        assert row["h"] == want and bytes(row["p"]) == len(a.encode()).to_bytes(8, "big") + a.encode() and len(row["c"]) == 8
    modulo = rows.select(hashing.digest(F.col("a")).alias("h")).select("h", hashing.hex_modulo(F.col("h"), 1_000_003).alias("m"))
    assert all(int(r["h"], 16) % 1_000_003 == r["m"] for r in modulo.collect())
    assert rows.select(hashing.digest(F.lit(None).cast("string"), F.col("a")).alias("h")).where("h is not null").count() == 0


def test_weighted_buckets_keep_their_shares(spark):
    ids = spark.range(20_000).select(hashing.weighted_bucket(hashing.digest(F.col("id")), {"a": 8, "b": 1, "c": 1}).alias("s"))
    counts = {r["s"]: r["count"] for r in ids.groupBy("s").count().collect()}
    assert abs(counts["a"] / 20_000 - 0.8) < 0.02 and abs(counts["b"] / 20_000 - 0.1) < 0.02


def test_text(spark):
    rows = spark.createDataFrame([("a　 b \n c ", "共同关注。x", "Hi, 3.5 e-mail (yes).")], "s string, h string, t string")
    row = rows.select(T.collapsed(F.col("s")).alias("c"), F.regexp_count("h", F.lit(T.HAN)).alias("han"), T.tokens_13a(F.col("t")).alias("t13"), T.tokens_han(F.col("h")).alias("zh"), T.code_point_label(F.col("h")).alias("u"), T.ngrams(T.tokens_none(F.col("t")), 3).alias("g")).first()
    assert row["c"] == "a b c" and row["han"] == 4 and row["u"] == "U+5171"
    assert row["t13"] == ["Hi", ",", "3.5", "e-mail", "(", "yes", ")", "."] and row["zh"][:4] == list("共同关注")
    assert row["g"] == ["Hi, 3.5 e-mail", "3.5 e-mail (yes)."]
    paths = spark.createDataFrame([("a/b.tar.GZ",), ("../x",), ("/abs",), ("c\\d",)], "p string").select(T.basename(F.col("p")).alias("b"), T.suffix(F.col("p")).alias("s"), T.is_unsafe_path(F.col("p")).alias("u")).collect()
    assert [(r["b"], r["s"], r["u"]) for r in paths] == [("b.tar.GZ", ".gz", False), ("x", "", True), ("abs", "", True), ("d", "", False)]


def test_ordinals_are_dense(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 3).alias("g"))
    got = with_ordinal(rows, ["k"]).collect()
    assert all(r["ordinal"] == r["k"] for r in got)
    grouped = with_ordinal(rows.repartition(7), ["k"], ["g"]).toPandas().sort_values(["g", "k"])
    assert (grouped["ordinal"].to_numpy() == grouped.groupby("g").cumcount().to_numpy()).all()
    assert with_ordinal(rows.limit(0), ["k"]).count() == 0


def test_signal():
    frame = np.exp(2j * np.pi * (0.25 * np.arange(16)[None, :] + 0.25 * np.arange(4)[:, None]))
    power = signal.range_doppler(frame)
    assert np.unravel_index(power.argmax(), power.shape) == (3, 4)
    assert np.allclose(signal.range_doppler(np.ones((4, 16))), 0)
    angles = np.linspace(-1, 1, 41)
    assert abs(angles[signal.beam_power(signal.steering(8, np.array([0.5]))[0], angles).argmax()] - 0.5) < 0.03
