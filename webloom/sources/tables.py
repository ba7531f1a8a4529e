"""Reading and writing tables: ordered shards, JSON lines, typed CSV, web pages, and what stands in for caches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.session import shared_root, ship
from webloom.sources.pages import main_text, page_text  # noqa: F401


def scan(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def shard_names(spark: SparkSession, folder: str) -> list[str]:
    """The folder's Parquet files in order of name; none are an error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = sorted(n for f in found if (n := f.getPath().getName()).endswith(".parquet"))
    if not names:
        raise FileNotFoundError(f"no Parquet files in {folder}")
    return names


def dump_path(root: str, revision: str, dump: str) -> str:
    """Where a dump of a pinned revision of a published dataset lies below ``root``, in whatever store that is."""
    if not revision:
        raise ValueError("a revision has to be named, so that two reads see the same files")
    return f"{root.rstrip('/')}@{revision}/data/{dump}"


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """path, place: the lines of a text file, gzip or not, that aren't blank, in their order."""
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    return whole.select(F.posexplode("lines").alias("place", "path"))


def set_sources(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str = "text string, subdomain string, source string, subset string") -> DataFrame:
    """set, domain, text of several JSON-lines sources, rows without text left out; the domain is the first of subdomain, source and subset that isn't empty."""
    out = None
    for name, path in paths.items():
        rows = spark.read.schema(schema).json(path)
        filled = [F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string") for c in ("subdomain", "source", "subset")]
        part = rows.where("text is not null and text <> ''").select(F.lit(name).alias("set"), F.coalesce(*filled).alias("domain"), "text")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def audit_stages(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, number, stage, kept of a filter audit's JSON file: an object of pipelines, each with a list of stages."""
    schema = "map<string,struct<stages:array<struct<stage:string,kept:bigint>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("pipeline", "found"))
    return whole.select("pipeline", F.posexplode("found.stages").alias("number", "s")).select("pipeline", "number", "s.stage", "s.kept")


def records(spark: SparkSession, path: str, schema: T.StructType | str, **equal) -> DataFrame:
    """The records of a CSV or JSON-lines file with the given values."""
    rows = json_lines(spark, path, schema) if path.endswith((".json", ".jsonl", ".jsonl.gz")) else typed_csv(spark, path, schema)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def study_tables(spark: SparkSession, models: str, losses: str, model_schema: str, loss_schema: str = "name string, target string, loss double") -> tuple[DataFrame, DataFrame]:
    """The runs of a study and their losses by (name, target), from two CSV files."""
    return typed_csv(spark, models, model_schema), typed_csv(spark, losses, loss_schema)


def ordered_scan(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of all shards with their order: file name, then row."""
    df = spark.read.parquet(folder)
    place = [F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("_metadata.row_index").alias("row_index")]
    return df.select(*(columns or df.columns), *place)


def recursive_scan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(folder).withColumn("file_path", F.col("_metadata.file_path"))


def blocks(ordered: DataFrame, rows_per_block: int) -> DataFrame:
    """The blocks of rows of each file and their sizes."""
    return ordered.select("file_name", F.floor(F.col("row_index") / rows_per_block).cast("long").alias("block")).groupBy("file_name", "block").agg(F.count("*").alias("rows"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with header whose empty fields are null; a row that doesn't fit the schema is an error."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", mode="FAILFAST")


def verified_bytes(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The lines of a file whose digest must be ``sha256``."""
    whole = spark.read.format("binaryFile").load(path)
    checked = F.when(F.sha2("content", 256) == sha256, F.col("content").cast("string")).otherwise(F.raise_error(F.lit("the file's digest differs")).cast("string"))
    return whole.select(F.explode(F.filter(F.split(checked, "\n"), lambda x: F.trim(x) != "")).alias("line"))


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, by: str, order: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder in buckets of ``by``, sorted inside by ``by`` and ``order``, and read again.

    Tables laid out alike are joined and grouped by ``by``, alone or with more columns, where they lie: nothing is
    shuffled, and writing shuffles nothing either. For keys of bounded size, such as a file's rows: a key is one
    bucket's. ``buckets`` is Spark's number of shuffle partitions if it isn't given.
    """
    spark = df.sparkSession
    # Else Spark wants tables cut by every column of a join, and shuffles them to have it.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"laid_out_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, by).sortBy(by, *order).option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def write_table(df: DataFrame, path: str, *, order: list[str] | None = None, rows_per_file: int = 100_000, replace: bool = False) -> None:
    """Parquet with zstd, at most ``rows_per_file`` rows a file, in ``order`` across and within files. Without ``replace`` an existing table is an error."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite" if replace else "errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_shards(numbered: DataFrame, path: str, number: str, *, rows_per_shard: int = 100_000, last: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Shards of exactly ``rows_per_shard`` rows, the last one of what is left, in the order of ``number``, the rows' numbers from 0 without gaps, which isn't written. Part files are named in their order. An existing table is an error.

    ``last`` is applied to the rows as they are written, behind the shuffle, whose sample reads what is before it twice.
    """
    shard = F.floor(F.col(number) / rows_per_shard)
    # A task holds whole shards, so a file of so many rows ends where a shard does.
    dealt = numbered.withColumn("__shard", shard).repartitionByRange("__shard").sortWithinPartitions("__shard", number)
    last(dealt.drop("__shard", number)).write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "gzip").json(path)


def csv_cells(df: DataFrame) -> DataFrame:
    """Columns as CSV cells: arrays joined by ``;``."""
    return df.select(*[F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with header; without rows there is none, and an older one goes."""
    if df.isEmpty():
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return
    csv_cells(df).write.mode("overwrite").csv(path, header=True, nullValue="")


def finite(column: Column) -> Column:
    """The number, or null if it isn't finite."""
    c = column.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, non-finite numbers as null."""
    cells = [finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def choose_files(paths: list[str], n: int | None, key: str) -> list[str]:
    """n of the paths, those of smallest keyed hash, in their order; all for None."""
    if n is None:
        return list(paths)
    if not 0 < n <= len(paths):
        raise ValueError(f"{n} of {len(paths)} files")
    rank = {p: hashlib.sha256(f"{key}:{p}".encode()).hexdigest() for p in paths}
    chosen = set(sorted(paths, key=rank.__getitem__)[:n])
    return [p for p in paths if p in chosen]


def drawn_frame(paths: list[str], n: int | None, key: str) -> list[tuple[str, float]]:
    """The chosen files with the probability that each had to be chosen."""
    chosen = choose_files(paths, n, key)
    return [(p, len(chosen) / len(paths)) for p in chosen]


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` and the ``text`` of their main content, found by density."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.withColumn("text", extracted(F.col(html_col)))


def blocked_hosts(df: DataFrame, blocklist: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` without the rows whose host is on the list (column host)."""
    return df.withColumn("__host", F.lower(F.parse_url(F.col(url_col), F.lit("HOST")))).join(blocklist.select(F.lower("host").alias("__host")), "__host", "left_anti").drop("__host")
