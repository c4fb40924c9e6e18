"""Sources and deliveries, over files made here."""

import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.plans import delivery
from sluice.sources import files, manifests


def _record(**changes):
    return {"schema_version": "sample.v1", "sample_id": "a", "dataset": "d", "modalities": {"pose": {"uri": "x.npy", "shape": [2, 3], "sha256": "0" * 64}}} | changes


def test_manifest(spark, tmp_path):
    good, ref = _record(), _record()["modalities"]["pose"]
    lines = [
        (good, []), (_record(sample_id=" "), ["blank id"]), (_record(extra=1), ["unknown key"]), (_record(schema_version="sample.v9"), ["version"]),
        (_record(modalities={}), ["no modality"]), (_record(modalities={"p": ref | {"text": "t"}}), ["location and text"]), (_record(modalities={"p": ref | {"uri": "../x"}}), ["unsafe location"]),
        (_record(modalities={"p": ref | {"shape": [-1]}}), ["negative shape"]), (_record(modalities={"p": ref | {"sha256": "ff"}}), ["digest"]),
    ]
    path = tmp_path / "m.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r, _ in lines) + "\nnot json\n")
    got = {r["line"]: r["problems"] for r in manifests.sample_records(manifests.json_lines(spark, str(path))).collect()}
    assert len(got) == len(lines) + 1
    for record, problems in lines:
        assert got[json.dumps(record)] == problems
    assert "not an object" in got["not json"]


def test_tables(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"video": "a\\b.mp4", "pose": "p", "text": "共同关注。"}]))
    assert manifests.labels_array(spark, str(tmp_path / "l.json")).first()["key"] == "b.mp4"
    (tmp_path / "c.csv").write_text('id,note\n1,"two\nlines ""q"""\n')
    assert manifests.csv_manifest(spark, str(tmp_path / "c.csv"), "id int, note string").first()["note"] == 'two\nlines "q"'
    (tmp_path / "bad.csv").write_text("id,note\nx,y\n")
    with pytest.raises(Exception):
        manifests.csv_manifest(spark, str(tmp_path / "bad.csv"), "id int, note string").collect()
    (tmp_path / "SUMS").write_text("a" * 64 + "  x/y.bin\n" + "b" * 64 + " *z\n")
    assert {r["path"] for r in manifests.checksum_list(spark, str(tmp_path / "SUMS")).collect()} == {"x/y.bin", "z"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/", "")
        z.writestr("v/one.MP4", b"x" * 10)
        z.writestr("../up.mp4", b"y")
        z.writestr("note.txt", b"n")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = {r["member"]: r for r in files.zip_members(spark, str(tmp_path / "*.zip")).collect()}
    assert set(rows) == {"v/one.MP4", "../up.mp4", None} and rows["v/one.MP4"]["problem"] is None and rows["v/one.MP4"]["size"] == 10
    assert rows["../up.mp4"]["problem"] == "unsafe" and rows[None]["problem"] == "not an archive"


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1.0, np.nan]]))
    np.savez(tmp_path / "b.npz", x=np.arange(3), y=np.ones((2, 2)))
    np.save(tmp_path / "c.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    rows = {(r["path"].rsplit("/", 1)[1], r["name"]): r for r in files.arrays(spark, str(tmp_path / "*.np*")).collect()}
    assert rows["a.npy", ""]["finite"] is False and rows["b.npz", "y"]["shape"] == [2, 2] and rows["c.npy", None]["problem"] == "ValueError"
    buffer = io.BytesIO()
    np.save(buffer, np.zeros(1))
    assert files.inventory(spark, str(tmp_path), "*.npz").first()["size"] == (tmp_path / "b.npz").stat().st_size


def test_members_to_extract(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.mp4", b"x" * 10)
        z.writestr("two.mp4", b"y")
    members = files.zip_members(spark, str(tmp_path / "a.zip"))
    rows = {r["member"]: r for r in members.collect()}
    assert rows["two.mp4"]["sha256"] == hashlib.sha256(b"y").hexdigest()
    done = members.where("member = 'one.mp4'").select("archive", "member", "size", "crc32")
    assert [r["member"] for r in files.to_extract(members, done).collect()] == ["two.mp4"]
    assert files.to_extract(members, done.withColumn("crc32", F.col("crc32") + 1)).count() == 2


def test_array_contracts(spark, tmp_path):
    contract = {"pose": ("float32", (None, 2, 3)), "frames": ("int64", (None,))}
    good = {"pose": np.ones((4, 2, 3), np.float32), "frames": np.arange(4)}
    cases = {
        "good": good, "gaps": good | {"frames": np.array([0, 1, 3, 4])}, "type": good | {"pose": np.ones((4, 2, 3))}, "shape": good | {"pose": np.ones((5, 2, 3), np.float32)},
        "nan": good | {"pose": np.full((4, 2, 3), np.nan, np.float32)}, "more": good | {"x": np.ones(1)}, "less": {"frames": np.arange(4)},
    }
    for name, arrays in cases.items():
        np.savez(tmp_path / f"{name}.npz", **arrays)
    (tmp_path / "bad.npz").write_bytes(b"PK no")
    got = {}
    for r in files.container_problems(files.arrays(spark, f"{tmp_path}/*.npz"), contract, "frames").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1][:-4], []).append(r["problem"])
    bad = got.pop("bad")
    assert {"pose: missing", "frames: missing"} < set(bad)
    assert got == {"gaps": ["frames: gaps"], "type": ["pose: type"], "shape": ["pose: shape"], "nan": ["pose: not finite"], "more": ["x: unknown"], "less": ["pose: missing"]}


def test_labels(spark):
    rows = [("a", "x"), ("a", "y"), ("", "z"), ("b", " "), (None, "w"), ("c", "v")]
    got = {(r["key"], r["problem"]) for r in manifests.label_problems(spark.createDataFrame(rows, "key string, text string")).collect()}
    assert got == {("a", "repeated"), ("", "blank key"), (None, "blank key"), ("b", "blank text")}


def test_delivery(spark, tmp_path):
    rows = spark.range(2600).selectExpr("lpad(id, 6, '0') as sample", "if(id % 10 = 0, 'test', 'train') as split", "id * 2 as value")
    made = delivery.staged(rows, "sample", str(tmp_path / "s"), rows_per_part=100, parts_per_chunk=5)
    assert delivery.problems(spark, made, rows, "sample").count() == 0
    told = spark.read.parquet(made.inventory)
    assert told.count() == 3 + 24 and told.selectExpr("max(rows) m", "max(files) f", "max(chunk) c").first() == (100, 1, 4)
    assert {r["check"] for r in delivery.problems(spark, made, rows.where("value <> 0"), "sample").collect()} == {"unexpected"}
    delivery.published(spark, str(tmp_path / "s"), str(tmp_path / "t" / "final"))
    with pytest.raises(Exception):
        delivery.published(spark, str(tmp_path / "t" / "final"), str(tmp_path / "t" / "final"))
    sums = delivery.checksums(spark, str(tmp_path / "t" / "final")).toPandas()
    assert sums["path"].str.match("^(data|index|inventory)/").all() and (sums["sha256"].str.len() == 64).all()
