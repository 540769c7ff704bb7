"""Session factory and the few session-dependent helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    # Checkpoints whose data no plan refers to any more are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "opsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; settings of a running session stay as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session is local (tests, the
    bench) a folder of this machine is taken; on a cluster an unset folder is an error, as executors share no disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(os.environ.get("TMPDIR", "/tmp"), "opsloom-scratch")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, partitions and order, read back from reliable checkpoint files.

    Executors that are lost later cost no recomputation of what came before, and the partitions stay the same in every
    pass over them. One job writes them; nothing is computed twice.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)


#: Sessions and folders of what was staged, deleted when the driver ends.
_staged: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the driver ends or by ``clean``."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(clean)
    _staged.append((spark, path))
    return path


def clean() -> None:
    """Deletes all staged folders of this driver. Frames that read them can't be used any more."""
    while _staged:
        spark, path = _staged.pop()
        try:
            file = spark._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
        except (Py4JError, OSError, AttributeError, TypeError):  # the session has ended already
            continue


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet into the shared folder and read back.

    For results that several later branches read: columns can be pruned and filters pushed down, unlike a checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def still_staged(df: DataFrame) -> bool:
    """Whether the files of a staged table are still there, as the shared folder may have been cleared."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        file = spark._jvm.org.apache.hadoop.fs.Path(name)
        return bool(file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file))
    return False
