"""Session, shared-folder and code-shipping helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch for a Python worker, in place of Spark's default; the executor and the worker each hold a batch a task.
_BATCH_BYTES, _BATCH_DEFAULT = "4m", "67108864b"


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("policyloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, once per context, so that UDFs import it on any executor.

    Arrow batches are bounded by bytes, as rows may be long; a size that the session names itself stays.
    """
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, _BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_policyloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="policyloom-")
    archive = os.path.join(folder, "policyloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, f"policyloom/{path.relative_to(_PACKAGE)}")
    context.addPyFile(archive)
    context._policyloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master where that is unset (tests) a temporary one."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="policyloom-shared-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: cuts lineage, survives lost executors, prunes columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._policyloom_path = path
    return made


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored() frames that nothing will read any more: neither they nor what is derived from them and not yet written."""
    for frame in frames:
        delete_path(frame.sparkSession, frame._policyloom_path)


def parallelism(spark: SparkSession) -> int:
    """The session's shuffle partition count, read when the plan is built."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
