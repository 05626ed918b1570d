"""Session settings the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="texteval-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a folder of its own beside the checkpoints and read it from there.

    Later jobs read files, so a lost executor costs a read and not the lineage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/texteval-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def delete_stored(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_texteval_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="texteval-package-")) / root.name
    context.addPyFile(shutil.make_archive(str(archive), "zip", root.parent, root.name))
    context._texteval_shipped = True


def local_session(cores: str = "*", app: str = "texteval") -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
