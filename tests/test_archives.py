"""Archives, array files and inventories through the data sources: ranges, refusals, aborts."""

import hashlib
import io
import os
import threading
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.sources import archives, arrays, storage


def members(spark, path, **more):
    return sorted(tuple(r) for r in archives.members(spark, str(path), **more).select("member", "size", "crc32", "problem", "sha256").collect())


def test_members_and_what_is_wrong_with_them(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b/x.MP4", b"one" * 9)
        z.writestr("y.mp4", b"two")
        z.writestr("y.mp4", b"three")
        z.writestr("../out.mp4", b"four")
        z.writestr("notes.txt", b"five")
        z.mkdir("folder.mp4")
    data = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("whole.mp4", b"whole")
        z.writestr("torn.mp4", b"t" * 100)
    data = bytearray((tmp_path / "b.zip").read_bytes())
    data[data.index(b"t" * 100) + 50] = 0
    (tmp_path / "b.zip").write_bytes(data)
    (tmp_path / "c.zip").write_bytes(b"nothing of the kind")
    os.symlink(tmp_path / "a.zip", tmp_path / "d.zip")
    (tmp_path / "_hidden.zip").write_bytes(b"")
    found = archives.members(spark, str(tmp_path)).collect()
    told = {(os.path.basename(r["archive"]), r["member"], r["problem"], r["sha256"]) for r in found}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert told == {
        ("a.zip", "b/x.MP4", None, digest(b"one" * 9)), ("a.zip", "y.mp4", None, digest(b"two")), ("a.zip", "y.mp4", "repeated", None), ("a.zip", "../out.mp4", "unsafe", None),
        ("b.zip", "whole.mp4", None, digest(b"whole")), ("b.zip", "torn.mp4", "checksum", None), ("c.zip", None, "not an archive", None), ("d.zip", None, "link", None),
    }
    with pytest.raises(Exception, match="FileNotFoundError"):
        archives.members(spark, str(tmp_path / "none")).collect()


def test_ranges_share_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(40):
            z.writestr(f"{k}.mp4", os.urandom(5000))
    reader = archives.ZipReader({"path": str(tmp_path), "taskBytes": "20000"})
    parts = reader.partitions()
    assert len(parts) == 11
    each = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(each) == 40 and max(each) <= 5
    assert members(spark, tmp_path, task_bytes=20_000) == members(spark, tmp_path)


class Sparse(io.FileIO):
    """A file whose zeros take no room."""

    def write(self, data):
        if len(data) >= 1 << 20 and not any(memoryview(data)[:64]) and memoryview(data) == self.zeros[: len(data)]:
            self.seek(len(data), 1)
            return len(data)
        return super().write(data)


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    Sparse.zeros = bytes(16 << 20)
    size = 3 << 30
    with Sparse(tmp_path / "long.zip", "w") as raw, zipfile.ZipFile(raw, "w") as z:
        z.writestr("first.mp4", b"first")
        with z.open(zipfile.ZipInfo("long.mp4"), "w", force_zip64=True) as member:
            for _ in range(size // len(Sparse.zeros)):
                member.write(Sparse.zeros)
        z.writestr("last.mp4", b"last")
    assert os.stat(tmp_path / "long.zip").st_blocks * 512 < 1 << 24
    want = hashlib.sha256()
    for _ in range(size // len(Sparse.zeros)):
        want.update(Sparse.zeros)
    found = {m: (s, p, d) for m, s, _, p, d in members(spark, tmp_path)}
    assert found["long.mp4"] == (size, None, want.hexdigest())
    assert found["last.mp4"][2] == hashlib.sha256(b"last").hexdigest() and len(found) == 3


def test_extraction_skips_what_is_done_and_never_replaces(spark, tmp_path):
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("v/1.mp4", name.encode() * 70)
            z.writestr("2.mp4", b"same")
            z.writestr("/3.mp4", b"unsafe")
    found = archives.members(spark, str(tmp_path), digest=False)
    target = tmp_path / "out"
    archives.extracted(found, str(target), done=found.where("member = '2.mp4' and archive like '%b.zip'"))
    files = archives.inventory(spark, str(target)).collect()
    assert [r["path"] for r in files] == ["a/2.mp4", "a/v/1.mp4", "b/v/1.mp4"]
    assert files[1]["sha256"] == hashlib.sha256(b"a" * 70).hexdigest()
    with pytest.raises(Exception, match="not overwritten"):
        archives.extracted(found, str(target))
    assert sorted(os.listdir(target)) == ["a", "b"]


def test_inventory_refuses_links_and_changes(spark, tmp_path, monkeypatch):
    for name in ("b", "a\u00e9", "a", "sub/z", "aZ"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    os.symlink(tmp_path / "b", tmp_path / "link")
    os.symlink(tmp_path / "sub", tmp_path / "linked")
    found = archives.inventory(spark, str(tmp_path)).collect()
    assert [r["path"] for r in found] == sorted(["a", "aZ", "a\u00e9", "b", "link", "linked", "sub/z"], key=str.encode)
    assert {r["path"]: r["problem"] for r in found if r["problem"]} == {"link": "link", "linked": "link"}
    assert found[0]["sha256"] == hashlib.sha256(b"a").hexdigest()
    reader = archives.InventoryReader({"path": str(tmp_path)})
    part = reader.partitions()[0]
    (tmp_path / "b").write_bytes(b"longer than before")
    (tmp_path / "a").unlink()
    told = {p: w for b in reader.read(part) for p, w in zip(b.column("path").to_pylist(), b.column("problem").to_pylist())}
    assert told["b"] == "changed" and told["a"] == "gone" and told["aZ"] is None


def test_arrays_round_trip_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(f"p/{k}.npz", [[float(k), 1.0]] * k, list(range(k))) for k in range(5)], "path string, pose array<array<double>>, frames array<long>")
    arrays.written(rows, str(tmp_path / "out"), {"pose": "<f4"})
    for k in range(5):
        with np.load(tmp_path / f"out/p/{k}.npz", allow_pickle=False) as z:
            assert z["pose"].dtype == np.float32 and z["pose"].shape == ((k, 2) if k else (0, 0)) and z["frames"].tolist() == list(range(k))
    arrays.written(rows.select(F.regexp_replace("path", "npz", "npy").alias("path"), "pose"), str(tmp_path / "out"))
    assert np.load(tmp_path / "out/p/3.npy").tolist() == [[3.0, 1.0]] * 3
    ragged = spark.createDataFrame([("r.npy", [[1.0], [1.0, 2.0]])], "path string, pose array<array<double>>")
    with pytest.raises(Exception, match="different lengths"):
        arrays.written(ragged, str(tmp_path / "ragged"))
    with pytest.raises(Exception, match="not a path below"):
        arrays.written(rows.select(F.lit("../x.npy").alias("path"), "frames"), str(tmp_path / "ragged"))
    assert os.listdir(tmp_path / "ragged") == []


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    @F.udf("array<double>")
    def slow(k):
        if k == 7:
            time.sleep(1.5)
            raise ValueError("killed")
        return [float(k)]

    rows = spark.range(8, numPartitions=4).select(F.concat("id", F.lit(".npy")).alias("path"), slow("id").alias("v"))
    seen, target, ended = set(), tmp_path / "out", threading.Event()

    def watch():
        while not ended.is_set():
            seen.update(os.listdir(target) if target.exists() else ())
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        with pytest.raises(Exception, match="killed"):
            arrays.written(rows, str(target))
    finally:
        ended.set()
        watcher.join()
    # staged files were there, but never at their places
    assert seen and all(name.startswith("_staging-") for name in seen) and os.listdir(target) == []


def test_two_tasks_may_not_write_one_file(spark, tmp_path):
    rows = spark.range(2, numPartitions=2).select(F.lit("same.npy").alias("path"), F.array(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="written twice"):
        arrays.written(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []


def test_paths_and_schemes():
    for uri in ("/a/b", "file:/a/b", "file:///a/b"):
        store, path = storage.opened(uri)
        assert path == "/a/b" and store.type_name == "local"
    assert arrays.shaped(pa.scalar([[[1, 2]], [[3, 4]]])).shape == (2, 1, 2)


def test_arrays_are_looked_at_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "PIECE", 64)
    np.save(tmp_path / "a.npy", np.arange(100))
    np.save(tmp_path / "b.npy", np.r_[np.arange(99), 7])
    np.savez_compressed(tmp_path / "c.npz", x=np.ones((40, 3), np.float32), y=np.full((9,), np.nan), z=np.array("text"), e=np.zeros((0, 4)))
    np.save(tmp_path / "d.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    (tmp_path / "e.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-8])
    (tmp_path / "f.npz").write_bytes(b"none")
    reader = arrays.ArrayReader({"path": str(tmp_path)})
    found = {(r[0].rsplit("/", 1)[1], r[1]): r[2:] for p in reader.partitions() for r in reader.read(p)}
    assert found["a.npy", ""] == ("int64", [100], True, True, None) and found["b.npy", ""] == ("int64", [100], True, False, None)
    assert found["c.npz", "x"] == ("float32", [40, 3], True, None, None) and found["c.npz", "y"][2] is False and found["c.npz", "z"][1:4] == ([], None, None) and found["c.npz", "e"] == ("float64", [0, 4], True, None, None)
    assert found["d.npy", None][-1] == "ValueError" and found["e.npy", None][-1] == "EOFError" and found["f.npz", None][-1] == "BadZipFile"
    assert arrays.scanned(spark, str(tmp_path)).count() == len(found)


def test_annotations_and_their_faults(spark, tmp_path):
    from sluice.sources import manifests

    lines = {
        '{"name":"a","label_char":["x","\u00e9"],"label_gloss":[{"gloss":"g"},"h"],"more":1}': ("x\u00e9", ["g", "h"], []), '{"name":"b","label_char":["x"],"label_gloss":null}': ("x", [], []), '{"name":"c","label_char":["x"]}': ("x", [], []),
        '{"name":5,"label_char":"xy","label_gloss":"g"}': (None, None, ["name", "label_char", "label_gloss"]), '{"name":" ","label_char":[],"label_gloss":[" "]}': ("", [" "], ["name", "label_char", "label_gloss"]),
        '{"name":"d","label_char":["x",1],"label_gloss":[{"other":"g"}]}': ("x", [None], ["label_char", "label_gloss"]), "[1]": (None, [], ["not an object", "name", "label_char"]), "no json": (None, [], ["not an object", "name", "label_char"]),
    }
    for line, want in lines.items():
        got = manifests.annotation_records(spark.createDataFrame([(line,)], "line string")).first()
        assert (got["caption"], got["label_gloss"], got["problems"]) == want, line


def test_frames_of_sequences_and_back(spark):
    from sluice.operators.summaries import stacked, unstacked

    rows = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [])], "id string, frames array<array<double>>")
    apart = unstacked(rows, ["id"], "frames")
    assert sorted(tuple(r) for r in apart.collect()) == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])]
    assert [tuple(r) for r in stacked(apart, ["id"], "frame", "values").collect()] == [("a", [[1.0, 2.0], [3.0, 4.0]])]


def to_driver(spark):
    """By stage, the most bytes of results that a task sent to the driver."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
    stages = [stages.apply(k) for k in range(stages.size())]
    return {(s.stageId(), s.attemptId()): s.resultSize() / max(s.numTasks(), 1) for s in stages}


def test_the_driver_is_told_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"in/{name}.zip", "w") as z:
            for k in range(3000):
                z.writestr(f"{k}.txt", f"{name}{k}")
    before = to_driver(spark)
    target = str(tmp_path / "out")
    archives.extracted(archives.members(spark, str(tmp_path / "in"), ".txt", digest=False), target)
    arrays.written(spark.range(2000, numPartitions=1).select(F.concat(F.lit("v/"), "id", F.lit(".npy")).alias("path"), F.array("id").alias("v")), target)
    found = archives.inventory(spark, target)
    told = {k: v for k, v in to_driver(spark).items() if k not in before}
    # range bounds take samples of some hundred rows a task; names and digests of 2,000 files take 400 kB
    assert told and max(told.values()) < 200_000
    assert "BatchScan" not in found._jdf.queryExecution().toString()
    rows = {r["path"]: r["sha256"] for r in found.collect()}
    assert len(rows) == 8000 and all(rows[f"{n}/{k}.txt"] == hashlib.sha256(f"{n}{k}".encode()).hexdigest() for n in "ab" for k in range(3000))


def test_tasks_list_what_the_reader_lists(spark, tmp_path):
    for name in ("b", "a/a/a", "a/b", "_hidden/c", "a/.d", "a/_e/f", "a/a/\u00e9 x", "g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    os.symlink(tmp_path / "a", tmp_path / "a/around")
    os.mkfifo(tmp_path / "a/pipe")
    archives.register(spark)
    for root, glob in ((tmp_path, "*"), (f"file://{tmp_path}/", "a*"), (tmp_path / "b", "*")):
        want = spark.read.format("sluice_inventory").option("glob", glob).load(str(root)).collect()
        assert archives.inventory(spark, str(root), glob).collect() == sorted(want, key=lambda r: r["path"].encode())
    assert {r["path"] for r in archives.inventory(spark, str(tmp_path), digest=False).collect()} == {"b", "a/a/a", "a/b", "a/a/\u00e9 x", "g.txt", "a/around", "a/pipe"}
    (tmp_path / "empty").mkdir()
    assert archives.inventory(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        archives.inventory(spark, str(tmp_path / "none"))


def test_a_task_that_moves_files_may_come_again(tmp_path):
    writer = arrays.ArrayWriter(str(tmp_path), {})
    staged = list(writer.staged(iter([pa.record_batch([pa.array(["x/1.npy", "2.npy"]), pa.array([[1.0], [2.0]])], names=["path", "v"])])))
    for _ in range(2):
        assert [b.column(0).to_pylist() for b in writer.places(iter(staged))] == [[2]]
    assert np.load(tmp_path / "x/1.npy").tolist() == [1.0] and np.load(tmp_path / "2.npy").tolist() == [2.0]
    (tmp_path / "2.npy").unlink()
    with pytest.raises(OSError, match="not as long"):
        list(writer.places(iter(staged)))
