"""Release tables: pools, monthly sample and audit with their labels, personal data replaced where it never was, with or without text and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import pii, text
from webloom.operators.relational import conform
from webloom.operators.sidecars import joined
from webloom.sources.tables import write_table

# The label of every document of a pool.
POOL_LABELS = {"ai": "AI", "human": "Human", "mixed": "Mixed"}
WINDOWS = "windows array<struct<start_index:bigint,end_index:bigint,label:string,score:double,confidence:string>>"


def release_schema(columns: str, *, with_text: bool = True, with_windows: bool = False) -> str:
    """The columns (DDL) of a released table: without its text if asked, and with label windows only if asked."""
    kept = [c for c in columns.split(", ") if with_text or c.split(" ")[0] != "text"]
    return ", ".join([*kept, *([WINDOWS] if with_windows else [])])


def with_counts(df: DataFrame, text_col: str = "text", count_col: str = "token_count") -> DataFrame:
    """``count_col`` put in, or counted again."""
    return df.withColumn(count_col, text.white_words(F.col(text_col)))


def anonymised(df: DataFrame, done: Column) -> DataFrame:
    """Personal data replaced in the rows where it was not ``done`` yet, their tokens counted again where the text changed."""
    return pii.anonymise_rows(df, ~F.coalesce(done, F.lit(False)))


def released_pool(pool: DataFrame, name: str, topics: DataFrame, columns: str, id_col: str = "id") -> DataFrame:
    """A pool (with the places of its rows) and its topics, its label, and no personal data."""
    rows = anonymised(joined(pool, {"topics": topics}, id_col), F.col("pii_anonymized"))
    return conform(rows.withColumn("label", F.lit(POOL_LABELS[name])), columns)


def write_pools(pools: dict[str, DataFrame], folder: str, rows_per_file: int = 100_000, order: list[str] | None = None) -> None:
    """Each pool to a table of its name, and all of them without text to ``labels``."""
    every = None
    for name, rows in pools.items():
        write_table(rows, f"{folder}/{name}", order=order, rows_per_file=rows_per_file)
        # What was written is read again, so nothing is computed twice.
        bare = rows.sparkSession.read.parquet(f"{folder}/{name}").drop("text")
        every = bare if every is None else every.unionByName(bare)
    if every is not None:
        write_table(every, f"{folder}/labels", order=order, rows_per_file=rows_per_file)


def released_months(sample: DataFrame, labels: DataFrame, topics: DataFrame, columns: str, id_col: str = "id") -> DataFrame:
    """The monthly sample with labels and topics by place; rows keep the order of their files (file_name, row_index)."""
    rows = anonymised(joined(sample, {"label": labels, "topics": topics}, id_col), F.col("pii_anonymized"))
    return conform(rows, columns)


def released_audit(sample: DataFrame, stages: DataFrame, columns: str, id_col: str = "id") -> DataFrame:
    """The audited sample and its stages by place: extracted text, so counted here and never cleaned of personal data before."""
    rows = joined(sample, {"stage": stages}, id_col).withColumns({"source": F.lit("common_crawl"), "truncated": F.lit(False)})
    return conform(anonymised(with_counts(rows), F.lit(False)), columns)
