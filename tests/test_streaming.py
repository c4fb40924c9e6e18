"""Streams: resume, dead letters, leases."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluice.streaming import incremental


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(10).selectExpr("id", "cast(id as double) as value")
    rows.write.parquet(source)
    stream = lambda: incremental.new_files(spark, source, "id long, value double")
    incremental.drained(stream(), sink, state)
    incremental.drained(stream(), sink, state)
    assert spark.read.parquet(sink).count() == 10
    spark.range(10, 15).selectExpr("id", "cast(id as double) as value").write.mode("append").parquet(source)
    incremental.drained(stream(), sink, state)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(15))


def test_upserts_go_on_where_they_stopped(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    schema = "id long, version long, value string"
    run = lambda: sorted(tuple(r) for r in incremental.upserted(spark, incremental.new_files(spark, source, schema, 1), "id", "version", table, state, compact_every=2).collect())
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add([])
    assert run() == []
    add([(1, 1, "a"), (2, 1, "b")])
    assert run() == [(1, 1, "a"), (2, 1, "b")]
    add([(3, 1, "c"), (1, 2, "a2")])
    assert run() == [(1, 2, "a2"), (2, 1, "b"), (3, 1, "c")]
    # nothing new: the table stays
    assert run() == [(1, 2, "a2"), (2, 1, "b"), (3, 1, "c")]
    add([(1, 0, "old")])
    add([(4, 1, "d")])
    assert run() == [(1, 2, "a2"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d")]


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "id long, value double")
    good, bad = incremental.routed(rows, "value > 0")
    assert [r["id"] for r in good.collect()] == [1] and sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=10 * k), "a", 1.0) for k in range(12)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = incremental.new_files(spark, str(tmp_path / "e"), "ts timestamp, event_type string, value double")
    found = incremental.numbered(incremental.windowed(stream, "1 hour", "1 hour"), "complete", str(tmp_path / "o"), str(tmp_path / "s"))
    assert [r["n"] for r in found.orderBy("start").collect()] == [6, 6]


def test_leases_expire(spark, tmp_path):
    rows = [(1, "a", "claim", 0.0), (1, "b", "claim", 100.0), (1, "a", "beat", 800.0), (1, "b", "claim", 1600.0), (1, "b", "claim", 1800.0), (2, "c", "claim", 0.0), (2, "c", "release", 5.0)]
    spark.createDataFrame(rows, "item long, worker string, kind string, at double").write.parquet(str(tmp_path / "r"))
    stream = incremental.new_files(spark, str(tmp_path / "r"), "item long, worker string, kind string, at double")
    found = incremental.numbered(incremental.leased(stream), "update", str(tmp_path / "o"), str(tmp_path / "s"))
    got = {r["item"]: (r["holder"], r["grants"], r["denials"]) for r in found.select("item", F.col("holder"), "grants", "denials").collect()}
    assert got == {1: ("b", 2, 2), 2: ("", 1, 0)}


def test_changed_files_come_again(spark, tmp_path):
    from sluice.streaming import changes

    (tmp_path / "in").mkdir()
    write = lambda name, text: (tmp_path / "in" / name).write_text(text)
    look = lambda: sorted((r["version"], r["path"], r["change"], r["problem"]) for r in changes.arrivals(spark, str(tmp_path / "in"), str(tmp_path / "state")).collect())
    assert look() == []
    write("a", "one")
    write("b", "one")
    first = [(1, "a", "new", None), (1, "b", "new", None)]
    assert look() == first
    assert look() == first  # nothing differs, nothing comes
    write("a", "second")
    (tmp_path / "in" / "b").unlink()
    write("c", "one")
    os.symlink(tmp_path / "in" / "c", tmp_path / "in" / "link")
    second = [(2, "a", "changed", None), (2, "b", "gone", None), (2, "c", "new", None)]
    assert look() == first + second
    write("a", "one")
    found = changes.arrivals(spark, str(tmp_path / "in"), str(tmp_path / "state"))
    told = {(r["path"], r["variant"].split("_")[0], r["state"], r["arrivals"]) for r in changes.variants(found).collect()}
    # the first content came back: it is the same variant, and current again
    assert told == {("a", "canonical", "current", 2), ("a", "source", "quarantined", 1), ("b", "canonical", "current", 1), ("c", "canonical", "current", 1)}


def test_a_batch_that_is_run_again_reads_the_same_changes(tmp_path):
    from sluice.streaming import changes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one")
    options = {"path": str(tmp_path / "in"), "statedir": str(tmp_path / "seen"), "taskbytes": "4"}
    reader = changes.ChangesReader(options)
    assert reader.latestOffset() == {"version": 1} == reader.latestOffset()
    (tmp_path / "in" / "b").write_text("four")
    (tmp_path / "in" / "a").write_text("three")
    # a new reader, as after a restart, finds what was seen
    again = changes.ChangesReader(options)
    assert again.latestOffset() == {"version": 2}
    rows = lambda a, b: [r[:2] + r[5:] for p in again.partitions({"version": a}, {"version": b}) for r in again.read(p)]
    again.commit({"version": 2})
    assert rows(0, 1) == [("a", "new", "changed", 1)]  # its content of then is gone
    assert rows(1, 2) == [("a", "changed", None, 2), ("b", "new", None, 2)] == rows(1, 2) and len(again.partitions({"version": 1}, {"version": 2})) == 2
    assert sorted(p.name for p in (tmp_path / "seen").iterdir()) == ["changes-1", "changes-2", "seen-2"]


def test_metric_states_merge_over_batches_restarts_and_shards(spark, tmp_path):
    from sluice.operators.scores import bleu, language_totals
    from sluice.streaming import metrics

    words = "the cat sat on a mat today and then it slept".split()
    rows = [(" ".join(words[k % 7 :]) if k % 11 else None, " ".join(words[k % 5 :]) + "é" * (k % 3)) for k in range(90)]
    frame = spark.createDataFrame(rows, "hyp string, ref string")
    parts = frame.randomSplit([0.3, 0.3, 0.4], seed=1)
    source, state, at = (str(tmp_path / n) for n in ("in", "state", "at"))
    for part in parts[:2]:  # a run for each, so the second one resumes
        part.coalesce(1).write.mode("append").parquet(source)
        metrics.accumulated(incremental.new_files(spark, source, "hyp string, ref string", 1), metrics.text_state, state, at)
    metrics.accumulated(incremental.new_files(spark, source, "hyp string, ref string", 1), metrics.text_state, state, at)
    parts[2].repartition(2).write.parquet(str(tmp_path / "other"))
    metrics.accumulated(incremental.new_files(spark, str(tmp_path / "other"), "hyp string, ref string", 1), metrics.text_state, f"{state}-other", f"{at}-other")
    merged = metrics.merged(spark, state, f"{state}-other")
    whole = spark.read.parquet(source).unionByName(parts[2])
    assert tuple(metrics.text_scores(merged).first()) == tuple(language_totals(whole.where("hyp is not null")).first())
    key = lambda df: sorted(tuple(r) for r in df.select("n", "hyp_grams", "matched", "bleu").collect())
    want = metrics.ngrams(metrics.text_state(whole).groupBy("metric", "n").agg(*[F.sum(c).alias(c) for c in "xyz"]))
    assert key(bleu(metrics.ngrams(merged))) == key(bleu(want)) and len(os.listdir(state)) >= 2
