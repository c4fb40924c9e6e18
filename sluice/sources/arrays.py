"""NumPy files as tables: .npy with one array, .npz with one for each column.

    rows.write.format("sluice_arrays").mode("append").option("dtypes", "pose=<f4").save("/data/poses")
    spark.read.format("sluice_arrays").load("/data/poses")

Writing, ``path`` names each row's file below the folder and its ending the
kind; all other columns are arrays, nested as deep as they have axes. Files are
never replaced; they appear together when the job commits. Reading, a row tells
of one array; its numbers are looked at a piece at a time, so files and arrays
may be longer than memory.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from sluice.sources import storage
from sluice.sources.storage import PIECE, TASK_BYTES, Files, Output, StagedWriter, dealt, listed, stream

SCANNED = "path string, name string, dtype string, shape array<bigint>, finite boolean, counts boolean, problem string"


class ArrayFiles(DataSource):
    """Options: ``dtypes``, as ``name=dtype`` joined by commas (columns not named keep their own type); ``taskBytes``, reading."""

    @classmethod
    def name(cls) -> str:
        return "sluice_arrays"

    def schema(self) -> str:
        return SCANNED

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        if overwrite:
            raise ValueError("array files are never replaced: use mode append")
        _checked(schema.names)
        return ArrayWriter(self.options["path"], dict(p.split("=") for p in self.options.get("dtypes", "").split(",") if p))


def _checked(names: list[str]) -> None:
    if "path" not in names or len(names) < 2:
        raise ValueError("rows need path and at least one array")


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, "*.np[yz]"), self.task_bytes, split=False)

    def read(self, partition: Files) -> Iterator[tuple]:
        for file in partition.files:
            if file.problem:
                yield file.uri, *(None,) * 5, file.problem
                continue
            with stream(file.uri) as raw:
                try:
                    if file.uri.endswith(".npy"):
                        yield file.uri, "", *_looked_at(raw), None
                        continue
                    with zipfile.ZipFile(raw) as held:
                        for name in sorted(held.namelist()):
                            with held.open(name) as member:
                                yield file.uri, name.removesuffix(".npy"), *_looked_at(member), None
                except (ValueError, EOFError, zipfile.BadZipFile) as error:
                    yield file.uri, *(None,) * 5, "BadZipFile" if isinstance(error, pa.ArrowInvalid) else type(error).__name__


def _looked_at(file: BinaryIO) -> tuple[str, list[int], bool | None, bool | None]:
    """dtype, shape, whether all numbers are finite and whether a row of whole ones counts 0, 1, 2 and so on."""
    version = npy.read_magic(file)
    shape, _, dtype = npy.read_array_header_1_0(file) if version == (1, 0) else npy.read_array_header_2_0(file)
    if dtype.hasobject:
        raise ValueError("an array of objects")
    left, at, finite, counts = math.prod(shape), 0, True, len(shape) == 1 and dtype.kind in "iu"
    while left:
        n = min(left, max(1, PIECE // dtype.itemsize))
        data = b""
        while len(data) < n * dtype.itemsize:
            if not (piece := file.read(n * dtype.itemsize - len(data))):
                raise EOFError("an array breaks off")
            data += piece
        part = np.frombuffer(data, dtype)
        finite = finite and (dtype.kind not in "fc" or bool(np.isfinite(part).all()))
        counts = counts and bool((part == np.arange(at, at + n)).all())
        left, at = left - n, at + n
    return str(dtype), list(shape), finite if dtype.kind in "fciub" else None, counts if len(shape) == 1 and dtype.kind in "iu" else None


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """path, name, dtype, shape, finite, counts and problem of each array of the files below a folder; Python objects are refused."""
    from sluice.sources.archives import register

    register(spark)
    return spark.read.format("sluice_arrays").load(path)


class ArrayWriter(StagedWriter):
    def __init__(self, target: str, dtypes: dict[str, str]):
        super().__init__(target)
        self.dtypes = dtypes

    def put(self, batches: Iterator[pa.RecordBatch], out: Output) -> None:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "path"]
            for k, path in enumerate(batch.column("path").to_pylist()):
                found = {n: shaped(batch.column(n)[k], self.dtypes.get(n)) for n in names}
                out.begin(path).write(_bytes(path, found))


def _bytes(path: str, found: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    if path.endswith(".npz"):
        np.savez_compressed(held, **found)
    elif path.endswith(".npy") and len(found) == 1:
        np.save(held, *found.values(), allow_pickle=False)
    else:
        raise ValueError(f"{path}: .npz, or .npy for a single array")
    return held.getvalue()


def shaped(value: pa.Scalar, dtype: str | None = None) -> np.ndarray:
    """An array as deep as its lists are nested; lists of one axis must agree in length, and nulls are refused."""
    sizes, values = [], pa.array([value.as_py()], value.type)
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        lengths = set(values.value_lengths().to_pylist())
        if len(lengths) > 1 or None in lengths:
            raise ValueError(f"lists of different lengths on axis {len(sizes) - 1}" if None not in lengths else "a list is null")
        sizes.append(lengths.pop() if lengths else 0)
        values = values.flatten()
    if values.null_count:
        raise ValueError("an array holds nulls")
    return values.to_numpy(zero_copy_only=False).reshape(sizes).astype(dtype or values.type.to_pandas_dtype())


def written(rows: DataFrame, target: str, dtypes: dict[str, str] | None = None) -> None:
    """Writes a file for each row of path and arrays, none of which may exist."""
    _checked(rows.columns)
    storage.written(rows, ArrayWriter(target, dtypes or {}))
