"""Steps whose work must grow no faster than the tables."""

from pyspark.sql import functions as F

from sluice.operators import files, streams
from sluice.plans import rules
from sluice.sources import manifests, storage


def test_globs_are_filed_under_beginnings_and_ends_of_words(spark):
    globs = {"*/en/123?*": "<123", "*/en/45": "=45", "*/en/45/*": "=45", "*x12/en*": ">x12", "*#*": "", "*.net/*": "=net", "*abc*": "", "?abc": ">abc"}
    frame = spark.createDataFrame([(k, g) for k, g in enumerate(globs)], "rule_id long, glob string")
    assert {r["glob"]: r["a"] for r in frame.select("glob", rules.anchor(F.col("glob")).alias("a")).collect()} == globs
    texts = spark.createDataFrame([("a/en/1234",), ("a/en/123",), ("b/en/45/c",), ("yx12/enough",)], "t string")
    assert {(r["t"], r["glob"]) for r in rules.fitting(texts, "t", frame).collect()} == {("a/en/1234", "*/en/123?*"), ("b/en/45/c", "*/en/45/*"), ("yx12/enough", "*x12/en*")}


def test_batches_of_a_stream_take_files_for_all_tasks(spark, small, monkeypatch):
    taken, real = [], streams.incremental.new_files
    monkeypatch.setattr(streams.incremental, "new_files", lambda s, path, schema, at_most: taken.append((len(storage.listed(path, "*.parquet")), at_most)) or real(s, path, schema, at_most))
    assert streams.stream_metrics(spark, small).count() == 1
    wide = spark.sparkContext.defaultParallelism
    assert wide > 1 and [at_most for _, at_most in taken] == [wide, wide] and all(n > wide for n, _ in taken)


def test_annotations_are_moved_before_their_texts_are_taken_apart(spark, small, monkeypatch):
    plans, real = [], manifests.annotations_written
    monkeypatch.setattr(manifests, "annotations_written", lambda rows, *more, **named: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows, *more, **named))
    assert files.annotation_lines(spark, small).count() > 0
    above, below = plans[0].split("RepartitionByExpression")
    assert "label_char" in above and "label_char" not in below


def test_small_files_are_dealt_out_to_several_tasks():
    small = [storage.Listed(f"file:///{k}", str(k), 10, 0) for k in range(9000)]
    tasks = storage.dealt(small, storage.TASK_BYTES, split=False)
    assert [f for t in tasks for f in t.files] == small and 8 <= len(tasks) <= 100
