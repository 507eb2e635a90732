"""Shared pieces: the cluster's shared folder, cut lineage, shipping this package to the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks.
BLANKS = "\\x20\\x09-\\x0D"

#: Rows of text sent to a Python worker at once; more would hold much memory outside the heap.
BATCH_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="stemma-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends there, and
    a lost executor costs no recomputation of what came before. What nobody releases goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._stemma_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing will read it again."""
    path = getattr(df, "_stemma_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on workers that do not have the repository on their path, and keeps Arrow
    batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in known or getattr(spark.sparkContext, "_stemma_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="stemma-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "stemma_llm_workers.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in (root / "stemma").rglob("*.py"):
            z.write(p, p.relative_to(root))
    before = list(sys.path)
    spark.sparkContext.addPyFile(archive)
    sys.path[:] = before
    spark.sparkContext._stemma_shipped = True


_tables: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Names what an operator's module keeps in a worker process from one task to the next."""
    _tables[owner] = clear


def enter(owner: str) -> None:
    """Called where an operator begins in a worker: what the others keep goes, so a process that serves several
    stages holds the tables of one."""
    for other, clear in _tables.items():
        if other != owner:
            clear()


def plain_text(column: str):
    """The text column, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
