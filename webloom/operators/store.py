"""Token stores: every document's ids in hash order, an index of key, offset and length, read by place or by budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import budget
from webloom.operators.relational import unique_or_error


def build_store(df: DataFrame, folder: str, tokens: Callable[[Column], Column], key: str = "h", id_col: str = "id", text_col: str = "text", share: float = 1.0, rows_per_file: int = 100_000) -> DataFrame:
    """Write id, key (hex), tokens (array of ids), length and offset in key order, with an index of files beside it, and read the table again.

    Of the keys those below ``share`` of their range are kept. A key that is there twice is an error.
    """
    if not 0 < share <= 1:
        raise ValueError("share has to be above 0 and at most 1")
    kept = df if share == 1 else df.where(F.col(key) < f"{min(int(share * 2**64), 2**64 - 1):016x}")
    rows = kept.select(F.col(id_col).alias("id"), F.col(key).alias("key"), tokens(F.col(text_col)).alias("tokens"))
    rows = unique_or_error(rows, ["key"], "keys").withColumn("length", F.size("tokens").cast("long"))
    placed = budget.running_total(rows, "key", F.col("length"), ties=(), name="offset")
    placed.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    store = df.sparkSession.read.parquet(folder)
    # A row a file: reads its offsets alone.
    index = store.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("documents"))
    index.coalesce(1).sortWithinPartitions("first").write.parquet(index_folder(folder))
    return store


def index_folder(folder: str) -> str:
    return f"{folder.rstrip('/')}-index"


def read_tokens(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``read_range`` of the store in ``folder``: its index names the files that hold the range, and only these are opened."""
    index = spark.read.parquet(index_folder(folder))
    files = index.where((F.col("first") < stop) & (F.col("end") > start)).orderBy("first").collect()  # those of the range
    store = spark.read.schema(spark.read.parquet(folder).schema).parquet(*[r["file"] for r in files]) if files and start < stop else spark.read.parquet(folder).where("false")
    return read_range(store, start, stop)


def read_range(store: DataFrame, start: int, stop: int) -> DataFrame:
    """key, tokens: the parts of documents that hold the store's tokens ``start`` to ``stop``; an empty range gives no rows."""
    first = F.greatest(F.lit(start) - F.col("offset"), F.lit(0)).cast("int")
    last = F.least(F.lit(stop) - F.col("offset"), F.col("length")).cast("int")
    inside = store.where(F.lit(start < stop) & (F.col("offset") < stop) & (F.col("offset") + F.col("length") > start))
    return inside.select("key", F.slice("tokens", first + 1, last - first).alias("tokens"))
