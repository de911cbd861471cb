"""Tables that a job writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the one named in ``spark.checkpoint.dir``; only in local mode
    a temporary one stands in for that."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = "file://" + _LOCAL.setdefault(app, _LOCAL.get(app) or tempfile.mkdtemp(prefix="quarryline-"))
    return f"{base.rstrip('/')}/quarryline/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and read from Parquet from now on: a plan that goes on
    from here doesn't grow with what came before, and a lost executor costs only its tasks."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing lazy reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
