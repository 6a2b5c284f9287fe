"""What driver and executors share: tables in the cluster's folder, and this package's code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, as in tests, a temporary one, which
    only a local master can share with its tasks; it goes with the process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not getattr(sc, "_starlode_shared", None):
        folder = tempfile.mkdtemp(prefix="starlode-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc._starlode_shared = f"file://{folder}"
    return sc._starlode_shared


def clean_up(spark: SparkSession) -> int:
    """Removes the tables that this session wrote to the shared folder, when their results are no longer read; how many."""
    paths, jvm = spark.__dict__.pop("_starlode_written", []), spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/starlode-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.__dict__.setdefault("_starlode_written", []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors, unless PYTHONPATH does; once per context."""
    root = str(Path(__file__).resolve().parents[1])
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_starlode_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "starlode.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(Path(root, "starlode").rglob("*.py")):
            z.write(path, path.relative_to(root))
    sc.addPyFile(str(target))
    sc._starlode_shipped = True
