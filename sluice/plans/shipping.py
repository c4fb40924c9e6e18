"""Gives Python workers this package where they would not find it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless workers can import it anyway."""
    app = spark.sparkContext.applicationId
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or any(Path(p).resolve() == ROOT for p in paths):
        return
    folder = tempfile.mkdtemp(prefix="sluice-")  # executors fetch from it as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "sluice.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((ROOT / "sluice").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    # the driver's own workers, which plan streams of data sources, look here and not among the session's files
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), str(ROOT))))
    _SHIPPED.add(app)
