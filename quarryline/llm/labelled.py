"""Labelled rows that classifiers learn from, and whole numbers of bounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: labelled documents that a classifier is fitted on, at most
TRAIN_ROWS = 20_000
#: labels of crc32(doc_id) mod 4 = 2 are held out
PARTS, HELD_OUT = 4, 2


def held_out(parts: int = PARTS, part: int = HELD_OUT):
    """Whether the row's labels (or text) may not be learned from."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, name: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, fold): at most ``rows`` labelled documents that aren't held out,
    those whose doc_id has the smallest hash.  Their ids are few enough by that bound to
    be sent to the readers of the texts, which aren't shuffled."""
    known = labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(rows).withColumn("fold", F.pmod(order, F.lit(5)).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "fold")
