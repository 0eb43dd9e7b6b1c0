"""Session helpers shared by every operator: worker imports, scratch tables, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

WRITTEN: dict[str, list[str]] = {}  # scratch tables by application
ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_worker_imports(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; where all runs on one machine, a temporary one.

    On a cluster each executor would write to a disk of its own, and later reads would miss those files: that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not one_machine(master):
            raise RuntimeError(f"master {master}: name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="foliate-scratch-")
        atexit.register(shutil.rmtree, folder, True)
        named = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` once as Parquet in the shared folder and reads it back.

    Unlike ``checkpoint()``, it does not run the plan twice, and any executor can read the result after
    the one that wrote it is lost.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/foliate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._foliate_path = path
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return back


def materialise_parts(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame | None:
    """``materialise`` of the union of frames that are made, and written, one after the other (None without any)."""
    path, schema = f"{scratch_dir(spark)}/foliate-{uuid.uuid4().hex}", None
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    for part in parts:
        schema = part.schema
        part.write.mode("append").parquet(path)
    if schema is None:
        return None
    back = spark.read.schema(schema).parquet(path)
    back._foliate_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` returned and nothing reads any more."""
    path = getattr(df, "_foliate_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Call it when results that were built on them are written."""
    for path in WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables last as long as this block: write results inside it."""
    try:
        yield
    finally:
        clear_scratch(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast of a materialised table only after counting that it has at most ``rows`` rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
