"""Cutting lineage through the folder that driver and executors share.

Intermediate tables that several later jobs read are written as Parquet in the
folder named by ``spark.checkpoint.dir``: a lost executor then costs only the
tasks it ran.  Nothing is kept in executor-local storage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: bytes of texts that reach a Python worker at once, unless the session says otherwise
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)
_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only in local mode."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="quarryline-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return "file://" + _FALLBACK[app]


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand long texts would be one otherwise."""
    set_by_user = spark.sparkContext.getConf().contains(BATCH[0])
    if not set_by_user:
        spark.conf.set(BATCH[0], str(BATCH[1]))


def unused(columns: list[str]) -> str:
    """A prefix that none of the column names begins with, for names of our own beside them."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "x" + prefix
    return prefix


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


class Stored:
    """A table written to the shared folder, to be read again any number of times."""

    def __init__(self, df: DataFrame, by: str | None = None):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = f"{shared_folder(self.spark)}/quarryline/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def discard(self) -> None:
        """Remove the files; only when nothing lazy still reads them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
