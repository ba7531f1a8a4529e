"""How the driver's tables stand in for the corpus tables: a document's source is its crawl, its characters its tokens, and its label is made of the quality and toxicity columns (a synthetic stand-in without meaning)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.hashing import rank_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Seeds the rankings of the queries.
KEY = "webloom-v1"


def query(sql: str | None = None):
    """Register a query, with its twin in SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As ``read``, with ``__file`` and ``__row``: where a row stands. By these rows are told apart that an ORDER BY of the SQL leaves open, and sums of doubles are formed in the order of the table."""
    return read(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def label_column(toxic: str = "toxic", quality: str = "quality"):
    return F.when(F.col(toxic) == 1, "AI").when(F.col(quality) == 0, "Mixed").when(F.col(quality).isNotNull(), "Human")


def base(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """id, dump, lang, tokens, label, h (and text)."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("dump"), "lang", F.col("n_chars").cast("long").alias("tokens"), *(["text"] if text else []))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return docs.join(labels, "id", "left").withColumn("label", label_column()).drop("quality", "toxic").withColumn("h", rank_hash(KEY, "id"))


BASE = f"""WITH base AS (
  SELECT d.doc_id AS id, d.source AS dump, d.lang, CAST(d.n_chars AS BIGINT) AS tokens, d.text,
         CASE WHEN l.toxic = 1 THEN 'AI' WHEN l.quality = 0 THEN 'Mixed' WHEN l.quality IS NOT NULL THEN 'Human' END AS label,
         sha256('{KEY}:' || CAST(d.doc_id AS VARCHAR)) AS h
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
