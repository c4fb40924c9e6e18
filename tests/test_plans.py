"""Deliveries, shards, snapshots, variants and payloads, small and by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sluice.plans import delivery, payload, predictions, snapshot, variants
from sluice.plans.lineage import durable
from sluice.sources import manifests


def staged(spark, folder, n=40):
    rows = spark.range(n).selectExpr("lpad(cast(id as string), 4, '0') as sample_id", "if(id % 5 = 0, 'test', 'train') as split", "cast(id as double) as value")
    return rows, delivery.staged(rows, "sample_id", folder, rows_per_part=8, parts_per_chunk=2)


def test_a_delivery_is_looked_up_by_its_index(spark, tmp_path):
    rows, made = staged(spark, f"{tmp_path}/d")
    assert delivery.problems(spark, made, rows, "sample_id").count() == 0
    keys = spark.createDataFrame([("0003",), ("0005",), ("none",)], "sample_id string")
    found = delivery.lookup(spark, made, keys, "sample_id")
    want = {("0003", 3.0, "train"), ("0005", 5.0, "test")}
    assert {(r["sample_id"], r["value"], r["split"]) for r in found.collect()} == want
    # two of the five files are read
    assert sum("/data/" in f for f in found.inputFiles()) == 2 and len(spark.read.parquet(made.data).inputFiles()) == 5
    many = delivery.lookup(spark, made, keys, "sample_id", few=2)
    assert {(r["sample_id"], r["value"], r["split"]) for r in many.collect()} == want and many.columns == found.columns
    assert delivery.lookup(spark, made, keys.where("sample_id = 'none'"), "sample_id").count() == 0


def test_what_breaks_a_delivery_shows(spark, tmp_path):
    rows, made = staged(spark, f"{tmp_path}/d")
    part = spark.read.parquet(made.data).where("split = 'train' and part = 1")
    moved = part.withColumn("row_index", F.col("row_index") + 1).withColumn("sample_id", F.concat(F.lit("!"), "sample_id")).cache()
    moved.count()
    moved.repartition(1).write.mode("append").partitionBy("split", "chunk", "part").parquet(made.data)
    checks = {r["check"] for r in delivery.problems(spark, made, rows, "sample_id").collect()}
    assert {"unexpected", "not in the index", "inventory", "layout", "row order", "key order"} <= checks
    assert {"missing"} == {r["check"] for r in delivery.problems(spark, delivery.staged(rows.where("value <> 7"), "sample_id", f"{tmp_path}/e", rows_per_part=8, parts_per_chunk=2), rows, "sample_id").collect()}
    narrower = rows.withColumn("value", F.col("value").cast("float"))
    assert "schema" in {r["check"] for r in delivery.problems(spark, made, narrower, "sample_id").collect()}


def test_payloads_files_and_moved_rows_show(spark, tmp_path):
    rows, made = staged(spark, f"{tmp_path}/d")
    assert delivery.problems(spark, made, rows, "sample_id", {"negative": F.col("value") < 0}, files=True).count() == 0
    bad = delivery.problems(spark, made, rows, "sample_id", {"high": F.col("value") > 30}).collect()
    assert {(r["check"], r["detail"]) for r in bad} == {("high", "test/0/0"), ("high", "train/1/3")}
    told = spark.read.parquet(made.inventory)
    assert told.where("row_groups = 1 and length(file_sha256) = 64").count() == told.count()
    # the same rows written anew, another value in one of them: only digests of files tell
    part = spark.read.parquet(made.data).where("split = 'train' and part = 1").withColumn("value", F.col("value") + (F.col("row_index") == 3).cast("double")).cache()
    part.count()
    part.repartition(1).sortWithinPartitions("row_index").drop("split", "chunk", "part").write.mode("overwrite").parquet(f"{made.data}/split=train/chunk=0/part=1")
    assert delivery.problems(spark, made, rows, "sample_id").count() == 0
    assert {r["check"] for r in delivery.problems(spark, made, rows, "sample_id", files=True).collect()} == {"file digest"}
    # two rows change places
    swapped = spark.read.parquet(made.data).where("split = 'train' and part = 1").withColumn("row_index", F.when(F.col("row_index") < 2, 1 - F.col("row_index")).otherwise(F.col("row_index"))).cache()
    swapped.count()
    swapped.repartition(1).drop("split", "chunk", "part").write.mode("overwrite").parquet(f"{made.data}/split=train/chunk=0/part=1")
    assert {"not in the index", "only in the index", "inventory"} <= {r["check"] for r in delivery.problems(spark, made, rows, "sample_id").collect()}


def test_trees_of_digests_tell_order_and_bytes(spark):
    from sluice.plans import merkle

    rows = spark.range(50).selectExpr("id as k", "cast(id % 7 as string) as v", "id % 2 as g")
    root = lambda df, **more: [tuple(r) for r in merkle.rooted(df, ["k"], ["k", "v"], fan=4, **more).collect()]
    n, first = root(rows)[0]
    assert n == 50 and root(rows.repartition(7)) == [(n, first)]
    assert root(rows.withColumn("v", F.when(F.col("k") == 31, "x").otherwise(F.col("v")))) != [(n, first)]
    swapped = rows.withColumn("k", F.when(F.col("k") == 3, 4).when(F.col("k") == 4, 3).otherwise(F.col("k")))
    assert root(swapped) != [(n, first)] and root(rows.where("k < 49")) != [(n, first)]
    assert root(rows.withColumn("v", F.lit(None).cast("string"))) != root(rows.withColumn("v", F.lit("")))
    by = {r[0]: r[1:] for r in root(rows, within=["g"])}
    assert by[0] == root(rows.where("g = 0"))[0] and by[1][0] == 25
    assert root(rows.limit(0))[0][0] == 0 and root(rows.limit(1))[0][0] == 1


def test_checksum_lists_cover_all_files(spark, tmp_path):
    _, made = staged(spark, f"{tmp_path}/d")
    listed = f"{tmp_path}/sums"
    delivery.checksums_written(spark, f"{tmp_path}/d", listed)
    assert delivery.checksum_problems(spark, f"{tmp_path}/d", listed).count() == 0
    spark.range(3).write.mode("append").parquet(made.index)
    assert {r["problem"] for r in delivery.checksum_problems(spark, f"{tmp_path}/d", listed).collect()} == {"not listed"}
    with pytest.raises(Exception, match="already exists"):
        delivery.checksums_written(spark, f"{tmp_path}/d", listed)


def test_shards_are_merged_or_refused(spark, tmp_path):
    shards = spark.createDataFrame([(0, "c", 1), (0, "a", 2), (1, "b", 3)], "rank int, sample_id string, value int")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    predictions.written(shards, f"{tmp_path}/p")
    # a rank without rows still needs its receipt
    with pytest.raises(ValueError, match="missing rank: 2"):
        predictions.merged(spark, f"{tmp_path}/p", expected, 3)
    merged = predictions.merged(spark, f"{tmp_path}/p", expected, 2).orderBy("place").collect()
    assert [(r["sample_id"], r["value"], r["place"]) for r in merged] == [("a", 2, 0), ("b", 3, 1), ("c", 1, 2)]
    told = predictions.receipts(shards)
    wrong = lambda rows, want=expected: {(r["problem"], r["detail"]) for r in predictions.problems(rows, told, want, 2).collect()}
    assert wrong(shards) == set()
    assert wrong(shards.withColumn("value", F.col("value") + F.col("rank"))) == {("tampered", "1")}
    assert wrong(shards.unionByName(shards.where("rank = 1").withColumn("rank", F.lit(0)))) == {("tampered", "0"), ("repeated", "b")}
    assert wrong(shards, expected.where("sample_id <> 'c'")) == {("unexpected", "c")}


def test_changed_sources_are_variants(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "x", 5), ("b", "y", 4), ("c", "z", 1)]
    found = variants.resolved(spark.createDataFrame(rows, "id string, sha string, at int"), "id", "sha", "at")
    got = {(r["id"], r["sha"]): (r["artifact"], r["state"], r["arrivals"]) for r in found.collect()}
    assert got == {("a", "x"): ("a", "current", 2), ("a", "y"): ("a--source_y", "quarantined", 1), ("b", "y"): ("b", "quarantined", 1), ("b", "x"): ("b--source_x", "current", 1), ("c", "z"): ("c", "current", 1)}


def test_snapshots_keep_a_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", []), ("b", ["version"]), ("c", []), ("c", []), (None, [])], "id string, problems array<string>")
    snapshot.written(rows, "id", f"{tmp_path}/s", "f" * 64)
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/s/accepted").collect()} == {"a", None}
    assert {(r["reason"], r["n"]) for r in snapshot.reasons(spark, f"{tmp_path}/s").collect()} == {("version", 1), ("repeated", 2)}
    assert tuple(spark.read.parquet(f"{tmp_path}/s/summary").first()) == ("f" * 64, 2, 3)
    with pytest.raises(Exception, match="already exists"):
        snapshot.written(rows, "id", f"{tmp_path}/s", "f" * 64)


def test_receipts_and_captured_inputs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one")
    (source / "b.txt").write_text("two")
    name = snapshot.receipt(spark, str(source), "src", f"{tmp_path}/receipts")
    assert len(name) == 64 and spark.read.parquet(f"{tmp_path}/receipts/{name}").count() == 2
    with pytest.raises(Exception, match="already exists"):
        snapshot.receipt(spark, str(source), "src", f"{tmp_path}/receipts")
    assert snapshot.receipt(spark, str(source), "other", f"{tmp_path}/receipts") != name
    digest = "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"
    got = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in snapshot.captured(spark, str(source), digest).collect()}
    assert got == {"a.txt": None, "b.txt": "digest"}
    from sluice.sources.files import inventory

    before = durable(inventory(spark, str(source), digest=False))
    (source / "b.txt").write_text("three")
    assert not snapshot.same_inventory(before, inventory(spark, str(source), digest=False)) and snapshot.same_inventory(before, before)


def test_pose_payloads(spark):
    nest = lambda v, *n: [nest(v, *n[1:]) for _ in range(n[0])] if n else v
    good = (1, 2, nest(0.5, 2, 2, 3, 2, 2), [True, False], nest(0.1, 2, 24, 3), nest(True, 2, 24))
    put = lambda i, at, v: (i, *[v if k == at else x for k, x in enumerate(good[1:])])
    rows = [good, put(2, 1, nest(0.5, 2, 2, 3, 2, 1)), put(3, 1, nest(-0.5, 2, 2, 3, 2, 2)), put(4, 2, [False, False]), put(5, 3, nest(math.nan, 2, 24, 3)), put(6, 4, nest(False, 2, 24)), put(7, 3, None), put(8, 0, 3)]
    schema = "i int, frame_count int, radar_cube array<array<array<array<array<double>>>>>, frame_mask array<boolean>, pose_gt array<array<array<double>>>, pose_valid array<array<boolean>>"
    found = spark.createDataFrame(rows, schema).select("i", payload.pose_problems((2, 3, 2, 2)).alias("p"))
    got = {r["i"]: r["p"] for r in found.collect()}
    assert got == {1: [], 2: ["cube shape"], 3: ["cube values"], 4: ["frame mask"], 5: ["pose values"], 6: ["pose mask"], 7: ["pose shape", "pose values"], 8: ["cube shape", "frame mask"]}


def test_body_clouds_and_packed_points(spark):
    joints = [[float(i), i * 0.5, 10.0 + i] for i in range(60)]
    df = spark.createDataFrame([(joints,)], "j array<array<double>>")
    got = df.select(payload.body_cloud(F.col("j")).alias("c")).first()["c"]
    body = joints[5:11]
    want = [*body]
    for a, b in ((0, 2), (2, 4), (1, 3), (3, 5), (0, 1)):
        want += [[p + (q - p) * k / 4 for p, q in zip(body[a], body[b])] for k in (1, 2, 3)]
    want = [[x, y, z * 0.6] for x, y, z in [*want, *joints[-42:]]]
    assert len(got) == 63 and all(g == pytest.approx(w) for g, w in zip(got, want))
    points = spark.createDataFrame([([[1.0, 2.0, 3.0], [math.nan, 0.0, 0.0], [4.0, 5.0, 6.0]], 4)], "p array<array<double>>, w int")
    assert points.select(payload.packed(F.col("p"), F.col("w")).alias("p")).first()["p"] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [0.0] * 3, [0.0] * 3]


def test_split_lines_and_prediction_folders(spark, tmp_path):
    ok = '{"schema_version": "split.v1", "sample_id": "%s", "group_id": "' + "a" * 64 + '", "split": "%s"}'
    lines = [ok % ("x", "train"), ok % ("y", "test"), "[1]", "{", '{"extra": 1}', (ok % ("z", "Train"))]
    found = manifests.with_leaks(manifests.split_records(spark.createDataFrame([(s,) for s in lines], "line string"))).collect()
    got = {r["line"]: r["problems"] for r in found}
    assert got[lines[0]] == got[lines[1]] == ["leaks"] and got[lines[5]] == ["split"]
    assert "not an object" in got["[1]"] and "not an object" in got["{"] and "unknown key" in got['{"extra": 1}']
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"s1": {"prediction": "a b\\nc", "reference": "a bc"}, "s2": {"prediction": "x", "reference": " "}}')
    (tmp_path / "r" / "a.txt").write_text("no")
    rows = manifests.predictions_folder(spark, f"{tmp_path}/r").collect()
    assert {(r["file"], r["sample_id"], r["prediction"], r["reference"]) for r in rows} == {("a.json", "s1", "abc", "abc"), ("a.json", "s2", "x", "")}


def test_archives_are_audited(spark):
    from sluice.plans import artifacts

    members = [("a", "v/1.mp4", None), ("a", "2.mp4", None), ("b", "1.mp4", "checksum"), ("b", "x/1.mp4", None), ("c", None, "not an archive"), ("d", "3.mp4", None), ("d", "../4.mp4", "unsafe")]
    labels = [("1.mp4", "x"), ("p/2.mp4", "y"), ("3.mp4", " "), ("4.mp4", "z"), ("4.mp4", "z")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = artifacts.archive_failures(
        frame([(a,) for a in "abcde"], "archive string"), frame(members, "archive string, member string, problem string"), frame(labels, "video string, text string"), frame([("a", "2.mp4", True), ("d", "3.mp4", False)], "archive string, member string, ok boolean")
    ).collect()
    got = {r["archive"]: r["failures"] for r in found}
    assert got == {"a": [], "b": ["duplicate names", "integrity"], "c": ["unreadable archive"], "d": ["duplicate labels", "empty labels", "failed probes", "unsafe members"], "e": ["no videos"]}


def test_completion_asks_for_the_source(spark):
    from sluice.plans import artifacts

    record = '{"schema_version": "annotation.v1", "status": "%s", "config_fingerprint": "f", "sample_id": "s", "source": {"archive": "a", "member_crc32": 5}, "artifact": {"path": "p", "size_bytes": 3, "sha256": "' + "a" * 64 + '"}, "qc": {"reasons": [%s]}}'
    sidecars = [("s", record % ("completed", ""), "a", "1", "1"), ("t", record % ("skipped", '"dark"'), "a", "1", "1"), ("u", record % ("skipped", ""), "a", "1", "1")]
    files = [(k, "p", 3, 3, "a" * 64, "1", "1", True) for k in "stu"]
    both = artifacts.paired(spark.createDataFrame(sidecars, "stem string, json string, archive string, before string, after string"), spark.createDataFrame(files, "stem string, path string, size long, read long, sha256 string, before string, after string, regular boolean"))
    source = lambda crc: F.struct(F.lit(None).cast("long").alias("archive_size_bytes"), F.lit(None).cast("long").alias("member_size_bytes"), F.lit(crc).alias("member_crc32"), F.lit(None).cast("string").alias("archive_sha256"))
    rows = {r["stem"]: r for r in both.select("stem", artifacts.is_complete("f").alias("a"), artifacts.is_complete("f", source(5)).alias("b"), artifacts.is_complete("f", source(6)).alias("c"), artifacts.terminal_state("f").alias("state"), artifacts.pair_failures("f").alias("codes")).collect()}
    assert tuple(rows["s"])[1:5] == (True, True, False, "completed") and rows["s"]["codes"] == []
    assert rows["t"]["state"] == "skipped" and rows["u"]["state"] is None and "sample_id_path_mismatch" in rows["t"]["codes"]


def test_audit_artifacts_and_special_files(spark):
    from sluice.plans import artifacts

    record = '{"schema_version": "annotation.v1", "status": "completed", "config_fingerprint": "f", "sample_id": "%s", "source": {"archive": "a"}, "artifact": {"path": "p", "size_bytes": 3, "sha256": "' + "a" * 64 + '"}, "audit_artifact": {"size_bytes": 7, "sha256": "' + "b" * 64 + '"}}'
    sidecars = [(k, record % k, "a", "1", "1", k != "w") for k in "stuw"]
    files = [(k, "p", 3, 3, "a" * 64, "1", "1", True) for k in "stuw"]
    audits = [("s", 7, "b" * 64), ("t", 8, "b" * 64), ("w", 7, "b" * 64)]
    both = artifacts.paired(spark.createDataFrame(sidecars, "stem string, json string, archive string, before string, after string, regular boolean"), spark.createDataFrame(files, "stem string, path string, size long, read long, sha256 string, before string, after string, regular boolean"), spark.createDataFrame(audits, "stem string, size long, sha256 string"))
    rows = {r["stem"]: (r["state"], r["plain"], r["codes"]) for r in both.select("stem", artifacts.terminal_state("f", audited=True).alias("state"), artifacts.terminal_state("f").alias("plain"), artifacts.pair_failures("f").alias("codes")).collect()}
    assert rows == {"s": ("completed", "completed", []), "t": (None, "completed", []), "u": (None, "completed", []), "w": ("completed", "completed", ["sidecar_not_regular_file"])}


def test_similarities_by_blocks(spark):
    import numpy as np

    from sluice.plans import blocks

    x = np.random.default_rng(1).normal(size=(70, 6))
    x[40:45] = 2 * x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, [0.0] * 6), (201, None), (202, [float("nan")] * 6), (203, [])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for size in (1, 16, 1024):
        got = {r["k"]: r for r in blocks.similarities(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", scale=20.0, block=size).collect()}
        assert got.keys() == set(range(70))
        for k, r in got.items():
            others = np.delete(s[k], k)
            assert r["nearest"] == pytest.approx(others.max()) and r["same_as"] == (others >= 0.999).sum() and r["positive"] == pytest.approx(1)
            assert r["log_sum_exp"] == pytest.approx(np.log(np.exp(20 * s[k]).sum())) and s[k][r["nearest_key"]] == pytest.approx(others.max())
    alone = blocks.similarities(spark.createDataFrame([(5, [1.0, 2.0])], "k long, v array<double>"), "k", "v").first()
    assert alone["nearest"] is None and alone["nearest_key"] is None and alone["log_sum_exp"] == pytest.approx(1.0)


@pytest.mark.parametrize(("strips", "longest"), [(3, 1 << 17), (3, 8)])
def test_similarities_move_blocks_a_bounded_number_of_times(spark, strips, longest):
    import numpy as np

    from sluice.plans import blocks

    x = np.random.default_rng(3).normal(size=(90, 5))
    x[50] = x[7]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    found = blocks.similarities(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>"), "k", "v", scale=5.0, block=4, strips=strips, longest=longest)
    for r in found.collect():
        others = np.where(np.arange(90) == r["k"], -np.inf, s[r["k"]])
        assert r["nearest"] == pytest.approx(others.max()) and r["same_as"] == (others >= 0.999).sum() and r["log_sum_exp"] == pytest.approx(np.log(np.exp(5 * s[r["k"]]).sum()))
    # 23 blocks in strips of at most 8 (or 2): each goes to as many tasks as there are strips, and one more
    plan = found._jdf.queryExecution().executedPlan().toString()
    many = 3 if longest > 8 else 12
    assert "hashpartitioning(_tile" in plan and f", {many * (many + 1) // 2})" in plan


def test_ten_thousand_globs(spark):
    import fnmatch
    import random

    from sluice.plans import rules

    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts = ["/".join(rng.choice(words) + rng.choice(["", ".x", "-y"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)] + ["", "*", "a+b(c)", "W1/w1", None]
    globs = {rng.choice(["*", "", "?"]) + "/".join(rng.choice(words) + rng.choice(["", "*", "?x", ".x", "-y"]) for _ in range(rng.randrange(1, 3))) + rng.choice(["*", "", "/*"]) for _ in range(12_000)} | {"*", "a+b(c)", "?", "", "w1*", "*w1"}
    globs = sorted(globs)[:10_000] + ["*", "a+b(c)"]
    frame = spark.createDataFrame([(k, g) for k, g in enumerate(globs)], "rule_id long, glob string")
    got = {(r["t"], r["glob"]) for r in rules.fitting(spark.createDataFrame([(t,) for t in texts], "t string"), "t", frame).collect()}
    assert got == {(t, g) for g in globs for t in texts if t is not None and fnmatch.fnmatchcase(t, g)}
    last = rules.decided(spark.createDataFrame([(1, "a/w1"), (2, "none")], "k long, t string"), "k", "t", spark.createDataFrame([(1, "a/*", "in"), (2, "*/w1", "out"), (3, "b/*", "in")], "rule_id long, glob string, verdict string"), "verdict", "open")
    assert {(r["k"], r["verdict"]) for r in last.collect()} == {(1, "out"), (2, "open")}
