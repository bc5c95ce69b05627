"""Session defaults and the shared-storage helpers every iterative operator uses."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def local_session(name: str = "vellum", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a machine-local path
    would be lost with its machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vellum-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, makes a non-deterministic step (such as numbering) happen once, and survives
    the loss of an executor because nothing of it lives on one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(path: str) -> None:
    """Remember a table of the shared folder for :func:`cleanup`."""
    _WRITTEN.append(path)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables of the shared folder that were remembered; frames that read them end with this."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
