"""Evaluation sets: the first characters of a stream of texts, written once with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.text import white_words
from webloom.operators.budget import running_total_in_order
from webloom.operators.crawls import enough_groups
from webloom.sources.row_groups import read_groups, row_groups
from webloom.sources.tables import exists, write_shards

MANIFEST = "manifest"


def stream_head(spark: SparkSession, folder: str, columns: str, target_chars: int, min_chars: int, text_col: str = "text", blocks_read=None) -> DataFrame:
    """The first documents of a folder's stream (its files by name, their rows in order) of ``min_chars`` characters or more, until they have ``target_chars``; the one that reaches it is whole.

    ``columns`` (DDL) has ``text_col``. Only as many row groups as that takes are read. ``place`` and ``row_index`` are
    the order of the stream.
    """
    length = F.char_length(text_col)
    long = F.when(length >= min_chars, length)
    groups = row_groups(spark, {"stream": folder})
    ordered, n, before = enough_groups(groups, ["file_path", "block"], long, f"{text_col} string", target_chars, blocks_read=blocks_read)
    read = lambda part: read_groups(ordered.where(part), columns, ("place",), blocks_read).where(length >= min_chars)
    # Only the last row group has to be cut.
    so_far = F.sum(length).over(Window.partitionBy("place").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tail = read(F.col("place") == n - 1).withColumn("__before", so_far - length + before)
    return read(F.col("place") < n - 1).unionByName(tail.where(F.col("__before") < target_chars).drop("__before"))


def write_set(df: DataFrame, folder: str, name: str, *, source: str, selection: str, revision: str | None = None, order: list[str], text_col: str = "text", domain_col: str | None = None, tokens: Column | None = None, rows_per_shard: int = 100_000) -> DataFrame:
    """Write text (and domain) in ``order`` to ``folder``/``name`` and its manifest beside it; gives the manifest, one row.

    A set that is there already, whole or begun, is an error. The manifest has name, source, revision, selection,
    documents, characters, tokens (``tokens``, or words between white space) and, with domains, the documents of each. It
    is counted while the set is written and comes last, so a set without one was not finished.
    """
    spark, place = df.sparkSession, f"{folder.rstrip('/')}/{name}"
    if exists(spark, place):
        raise FileExistsError(f"{place} already holds an evaluation set")
    text = F.col(text_col)
    rows = df.select(text.alias("text"), *([F.col(domain_col).alias("domain")] if domain_col else []), *[F.col(c).alias(f"__{c}") for c in order], (white_words(text) if tokens is None else tokens).alias("__tokens"))
    numbered = running_total_in_order(rows, [f"__{c}" for c in order], F.lit(1), name="__number")
    counted = Observation(name)
    sums = [F.count("*").alias("documents"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("characters"), F.coalesce(F.sum("__tokens"), F.lit(0)).alias("tokens")]
    write_shards(numbered.drop(*[f"__{c}" for c in order]), f"{place}/documents", "__number", rows_per_shard=rows_per_shard, last=lambda d: d.observe(counted, *sums).drop("__tokens"))
    found = counted.get
    fields = [F.lit(name).alias("name"), F.lit(source).alias("source"), F.lit(revision).cast("string").alias("revision"), F.lit(selection).alias("selection"), *[F.lit(int(found[c])).cast("long").alias(c) for c in ("documents", "characters", "tokens")]]
    if domain_col:
        written = spark.read.parquet(f"{place}/documents").groupBy("domain").agg(F.count("*").alias("n"))
        domains = written.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "n")))).alias("domains"))  # a row a domain
        manifest = domains.select(*fields, "domains")
    else:
        manifest = spark.range(1).select(*fields, F.lit(None).cast("map<string,bigint>").alias("domains"))
    manifest.coalesce(1).write.json(f"{place}/{MANIFEST}", ignoreNullFields=False)
    return read_manifest(spark, folder, name)


def read_manifest(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = "name string, source string, revision string, selection string, documents bigint, characters bigint, tokens bigint, domains map<string,bigint>"
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/{name}/{MANIFEST}")


def read_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The documents of a finished set."""
    place = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, f"{place}/{MANIFEST}/_SUCCESS"):
        raise FileNotFoundError(f"{place} holds no finished evaluation set")
    return spark.read.parquet(f"{place}/documents")
