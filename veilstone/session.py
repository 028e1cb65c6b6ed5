"""Session and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "veilstone", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode.

    Outside local mode a missing setting is an error, as a machine-local folder
    would lose data with its machine.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = "file://" + os.path.join(tempfile.gettempdir(), f"veilstone-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders that `written` has filled and `forget_stages` has not removed.
_STAGES: list[str] = []


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: later uses neither
    recompute it nor depend on any executor staying alive. The folder stays until
    forget_stages, as results that read it are evaluated later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_stages(spark: SparkSession) -> int:
    """Remove the intermediate results this process has written; gives their number. Call it
    when the results that were made from them are stored."""
    hadoop = spark._jsc.hadoopConfiguration()
    removed = 0
    while _STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        removed += bool(path.getFileSystem(hadoop).delete(path, True))
    return removed
