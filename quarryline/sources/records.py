"""Readers and writers: nested records, tables, registries, audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..operators.graph import apply_upsert

CORRUPT = "_corrupt_record"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; times without a zone are read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def read_records(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad): JSON records; what can't be read is a row of the second table."""
    whole = StructType([*schema.fields]).add(CORRUPT, StringType())
    lines = spark.read.option("wholetext", multi_line).text(path).where("trim(value) != ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.select(F.from_json("value", whole, options).alias("r"), F.col("_metadata.file_path").alias("file")).select("r.*", "file")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select("file", CORRUPT)


def read_files(spark: SparkSession, folder: str, head: int = 8192) -> DataFrame:
    """(path, size, head): all files below a folder (an address with its scheme), with their
    places in it and their first bytes.  Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.substring_index("path", folder.rstrip("/").rpartition("://")[2] + "/", -1)
    return files.select(inside.alias("path"), F.col("length").alias("size"), F.substring("content", 1, head).alias("head"))


def read_inventories(spark: SparkSession, path: str, item: StructType) -> tuple[DataFrame, DataFrame]:
    """(items, failed): one document for each repo, its items exploded."""
    schema = StructType().add("repo", "string").add("sid", "string").add("items", ArrayType(item))
    good, bad = read_records(spark, path, schema, multi_line=True)
    shaped = F.col("repo").isNotNull() & F.col("items").isNotNull()
    items = good.where(shaped).select("repo", "sid", F.explode("items").alias("item")).select("repo", "sid", "item.*")
    return items, bad.unionByName(good.where(~shaped).select("file", F.lit("no repo or items").alias(CORRUPT)))


def read_tracker(spark: SparkSession, path: str, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): a CSV table with columns cast; rows without id or with a value that
    can't be cast are skipped."""
    raw = spark.read.option("header", True).csv(path)
    bad = F.col("id").isNull()
    for c, t in kinds.items():
        bad = bad | (F.col(c).isNotNull() & (F.col(c) != "") & F.col(c).try_cast(t).isNull())
    return raw.where(~bad).select(*[F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in raw.columns]), raw.where(bad)


def write_registry(tables: dict[str, tuple[DataFrame, list[str]]], folder: str) -> None:
    """One folder for each output, sorted by its keys, so equal inputs give equal files."""
    for name, (df, keys) in tables.items():
        df.orderBy(*keys).write.mode("overwrite").json(f"{folder}/{name}")


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows appended to their months."""
    rows.withColumn("month", F.date_format("timestamp", "yyyy-MM")).write.partitionBy("month").mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str, as_of: str, months_back: int, project: str | None = None) -> DataFrame:
    """Rows of the current and so many earlier months, by time; other months aren't read."""
    first = spark.sql("SELECT date_format(add_months(to_date(:d), :n), 'yyyy-MM')", args={"d": as_of, "n": -months_back}).first()[0]
    # the month's name sorts like the month; kept as text, not as a number
    rows = spark.read.option("inferSchema", False).parquet(path).where(F.col("month").cast("string") >= first)
    if project:
        rows = rows.where(F.col("project") == project)
    return rows.orderBy("timestamp")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.partitionBy("doc_type").mode("append").parquet(path)


def export_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def flatten_dealers(dealers: DataFrame, states: DataFrame) -> DataFrame:
    """(dealer, branch, state, region): nested branches as rows; a dealer without any
    keeps one row."""
    rows = dealers.select("dealer", F.explode_outer("branches").alias("b")).select("dealer", F.col("b.code").alias("branch"), F.col("b.state").alias("state"))
    return rows.join(states, "state", "left").select("dealer", "branch", "state", "region")


def load_bulk(rows: DataFrame, parents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to load, errors): rows (row, code, name, parent_code) whose code isn't there yet;
    errors say missing name or unknown parent."""
    new = rows.join(existing.select("code").distinct(), "code", "left_anti")
    met = new.join(parents.select(F.col("code").alias("parent_code"), F.lit(1).alias("_p")).distinct(), "parent_code", "left")
    reason = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing name").when(F.col("_p").isNull(), "unknown parent")
    told = met.withColumn("reason", reason).drop("_p")
    return told.where("reason is null").drop("reason"), told.where("reason is not null").select("row", "code", "reason")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a versioned table, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(folder)] if files.exists(folder) else []
    done = [x for x in found if x.getName().startswith("version=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().partition("=")[2]) for x in done)


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The last finished version of a table that ``upsert_entities`` writes; None before the first."""
    have = versions(spark, path)
    return spark.read.parquet(f"{path}/version={have[-1]}") if have else None


def upsert_entities(batch: DataFrame, path: str, version: int) -> None:
    """Merge a batch into a table by ``apply_upsert`` and write it as a version of its own, so
    that readers see a whole one.  A version that is there already isn't written again: a
    batch that is tried twice counts once.  Fit for ``foreachBatch`` with its batch id."""
    spark = batch.sparkSession
    have = versions(spark, path)
    if version in have:
        return
    old = spark.read.parquet(f"{path}/version={have[-1]}") if have else batch.where("false")
    apply_upsert(old, batch).write.mode("overwrite").parquet(f"{path}/version={version}")
