"""Labels beside documents: sidecar tables made shard by shard, resumed where they stopped, and joined by place with a check of the ids.

A sidecar row carries the shard (file name) and row number of its document, so it can be written in any order by any
number of tasks and still joins by position.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.tables import exists, laid_out, ordered_scan

PLACE = ["file_name", "row_index"]


def mirror_path(path: str, root: str, other: str) -> str:
    """Where a path under ``root`` lies under ``other``."""
    return str(PurePosixPath(other) / PurePosixPath(path).relative_to(root))


def shards_to_do(documents: DataFrame, done: DataFrame | None) -> DataFrame:
    """The rows of ``documents`` (with PLACE) whose shard has no sidecar yet."""
    return documents if done is None else documents.join(done.select("file_name").distinct(), "file_name", "left_anti")


def label_missing(spark: SparkSession, folder: str, sidecar_folder: str, columns: list[str], label: Callable[[DataFrame], DataFrame], id_col: str = "id") -> int:
    """Label the shards of ``folder`` that lack a sidecar, and append theirs; gives the number of shards labelled.

    ``label`` gets id, ``columns`` and PLACE and returns them with columns of its own. Every row has to come back
    once with its id, else nothing is written. A shard counts as done once its rows are committed, so a run that died
    is resumed by running it again.
    """
    documents = ordered_scan(spark, folder, [id_col, *[c for c in columns if c != id_col]])
    todo = shards_to_do(documents, spark.read.parquet(sidecar_folder) if exists(spark, sidecar_folder) else None)
    wanted = todo.groupBy("file_name").agg(F.count("*").alias("n"), _digest(id_col).alias("ids"))
    made = label(todo)
    kept = made.select(*PLACE, id_col, *[c for c in made.columns if c not in (*PLACE, id_col, *columns)])
    new = f"{sidecar_folder.rstrip('/')}/_new"
    kept.write.mode("overwrite").partitionBy("file_name").parquet(new)
    fresh = spark.read.schema(kept.schema).parquet(new)
    got = fresh.groupBy("file_name").agg(F.count("*").alias("m"), _digest(id_col).alias("other"))
    wrong = wanted.join(got, "file_name", "full").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("ids").eqNullSafe(F.col("other")))).limit(1).collect()
    if wrong:
        raise ValueError(f"the sidecar of {wrong[0]['file_name']} does not have its documents' ids in their places")
    n = wanted.count()
    if n:
        fresh.write.mode("append").partitionBy("file_name").parquet(sidecar_folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _digest(id_col: str) -> Column:
    """Of the ids and their places, whatever the order of rows."""
    return F.bit_xor(F.xxhash64("row_index", F.col(id_col).cast("string")))


def laid_out_by_file(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Documents or a sidecar (with PLACE) laid out by file name, so that ``joined`` shuffles neither."""
    return laid_out(df, PLACE[0], PLACE[1:], buckets)


def joined(documents: DataFrame, sidecars: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """``documents`` (with PLACE) and the columns of each sidecar, prefixed by its name, joined by place.

    A sidecar row whose id is another than the document's is an error, and so are a document without one and a place
    there twice. The check is a filter, so it holds whatever columns are read afterwards. Tables of
    ``laid_out_by_file`` are joined without a shuffle.
    """
    out = documents
    for name, side in sidecars.items():
        columns = [c for c in side.columns if c not in (*PLACE, id_col)]
        row = F.struct(F.col(id_col).alias("__id"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        other = side.groupBy(*PLACE).agg(F.count("*").alias("__rows"), F.first(row).alias("__side"))
        before = out.columns
        out = out.join(other, PLACE, "left")
        where = F.concat(F.lit(f"{name}: "), F.col("file_name"), F.lit(" row "), F.col("row_index").cast("string"))
        wrong = F.when(F.col("__rows") > 1, F.lit(" is there more than once")).otherwise(F.lit(" has another id"))
        fits = (F.col("__rows") == 1) & (F.col(id_col) == F.col("__side.__id"))
        out = out.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(where, wrong)).cast("boolean")))
        out = out.select(*before, *[F.col(f"__side.{name}_{c}").alias(f"{name}_{c}") for c in columns])
    return out


def label_row(outcome: Column, version: Column, expected_version: str, label: Column, allowed: tuple[str, ...], error: Column) -> Column:
    """struct<label, error> of a labelling service's answer: the label of a success, the error of anything else. A success of another version, or with a label that isn't allowed, is an error of the job."""
    good = F.coalesce(outcome == "success", F.lit(False))
    checked = F.when(~F.coalesce(version == expected_version, F.lit(False)), F.raise_error(F.concat(F.lit("labelled by version "), F.coalesce(version, F.lit("none")))).cast("string")).when(label.isin(*allowed), label).otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce(label, F.lit("null")))).cast("string"))
    return F.struct(F.when(good, checked).alias("label"), F.when(~good, F.coalesce(error, outcome, F.lit("no answer"))).alias("error"))
