"""Binary files: inventories, ZIP members and NumPy arrays."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, glob: str = "*", digest: bool = True) -> DataFrame:
    """path, size, mtime and, if asked for, sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    columns = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return files.select(*columns, *([F.sha2("content", 256).alias("sha256")] if digest else []))


def zip_members(spark: SparkSession, path: str, suffix: str = ".mp4") -> DataFrame:
    """One row for each member of ZIP archives: archive, member, sizes, crc32, problem, sha256.

    Folders are left out and so are members of another suffix. The whole member
    is read, so a wrong checksum shows; unsafe and repeated names are problems.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows, seen = [], set()
                try:
                    opened = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(archive, None, None, None, None, "not an archive", None)], columns=names)
                    continue
                for info in sorted(opened.infolist(), key=lambda i: i.filename):
                    if info.is_dir() or not info.filename.lower().endswith(suffix):
                        continue
                    flat = info.filename.replace("\\", "/")
                    problem = "unsafe" if flat.startswith("/") or ".." in flat.split("/") else "repeated" if flat in seen else "encrypted" if info.flag_bits & 1 else None
                    seen.add(flat)
                    digest = hashlib.sha256()
                    if problem is None:
                        try:
                            with opened.open(info) as f:
                                while part := f.read(1 << 20):
                                    digest.update(part)
                        except zipfile.BadZipFile:
                            problem = "checksum"
                    rows.append((archive, info.filename, info.file_size, info.compress_size, info.CRC, problem, None if problem else digest.hexdigest()))
                yield pd.DataFrame(rows, columns=names)

    names = ["archive", "member", "size", "compressed", "crc32", "problem", "sha256"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(members, "archive string, member string, size long, compressed long, crc32 long, problem string, sha256 string")


def to_extract(members: DataFrame, done: DataFrame) -> DataFrame:
    """Sound members that were not extracted before under the same name, size and CRC."""
    return members.where("problem is null").join(done, ["archive", "member", "size", "crc32"], "left_anti")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """One row for each array of .npy and .npz files: path, name, dtype, shape, finite, counts, problem.

    ``counts`` says of a row of whole numbers whether it is 0, 1, 2 and so on.
    Files that hold Python objects are refused.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    loaded = np.load(io.BytesIO(content), allow_pickle=False)
                    found = dict(loaded.items()) if hasattr(loaded, "items") else {"": loaded}
                    rows += [(file, n, str(a.dtype), list(a.shape), bool(np.isfinite(a).all()) if a.dtype.kind in "fciub" else None, bool((a == np.arange(len(a))).all()) if a.ndim == 1 and a.dtype.kind in "iu" else None, None) for n, a in sorted(found.items())]
                except (ValueError, OSError, zipfile.BadZipFile) as error:
                    rows.append((file, None, None, None, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "finite", "counts", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, name string, dtype string, shape array<long>, finite boolean, counts boolean, problem string")


def container_problems(found: DataFrame, contract: dict[str, tuple[str, tuple[int | None, ...]]], counted: str | None = None) -> DataFrame:
    """path and problem of containers that differ from a contract of names, types and shapes.

    ``None`` stands for the number of frames, the same in all of a container's
    arrays; ``counted`` names an array that must number them from 0 without gaps.
    """
    rows = [(name, dtype, [-1 if n is None else n for n in shape]) for name, (dtype, shape) in contract.items()]
    told = found.sparkSession.createDataFrame(rows, "name string, want string, sizes array<long>")
    every = found.select("path").distinct().crossJoin(F.broadcast(told))  # a contract names a few arrays
    frames = found.where(F.col("name") == (counted or next(n for n, (_, s) in contract.items() if None in s))).select("path", F.get("shape", F.lit(0)).alias("frames"))
    joined = every.join(found, ["path", "name"], "left").join(frames, "path", "left")
    wanted = F.transform("sizes", lambda n: F.when(n == -1, F.col("frames")).otherwise(n))
    wrong = F.when(F.col("shape").isNull(), "missing").when(F.col("dtype") != F.col("want"), "type").when(~F.coalesce(F.col("shape") == wanted, F.lit(False)), "shape").when(~F.col("finite"), "not finite")
    if counted:
        wrong = wrong.when((F.col("name") == counted) & ~F.coalesce("counts", F.lit(False)), "gaps")
    listed = joined.select("path", F.concat_ws(": ", "name", wrong).alias("problem"), wrong.alias("_w")).where("_w is not null").drop("_w")
    other = found.where("problem is null").join(F.broadcast(told), "name", "left_anti").select("path", F.concat_ws(": ", "name", F.lit("unknown")).alias("problem"))
    broken = found.where("problem is not null").select("path", "problem")
    return listed.unionByName(other).unionByName(broken)
