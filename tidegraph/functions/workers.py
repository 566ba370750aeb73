"""Python workers get this package with the session, wherever they run; tables that several parts of a plan need are written once."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ready(spark: SparkSession) -> None:
    """Sends the package's files to the executors, once for each context."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        top, at = Path(__file__).resolve().parents[1], os.path.realpath(tempfile.mkdtemp(prefix="package-"))
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        with zipfile.ZipFile(f"{at}/{top.name}.zip", "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(f"{at}/{top.name}.zip")
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which the driver and all executors see.

    Where that is unset, a session in one process (master local, as in tests) gets a temporary folder, which goes at
    exit; on a cluster a machine's own folder would lose rows, so that it is refused.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            at = tempfile.mkdtemp(prefix="shared-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
            _own[context.applicationId] = "file://" + at
        top = _own[context.applicationId]
    return f"{top.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
