"""Documents of a corpus from what extraction leaves behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import white_words
from webloom.operators.relational import conform, full_path
from webloom.session import ship


def documents_of(extracted: DataFrame, paths: DataFrame, schema: str, *, min_chars: int, text_col: str = "text", file_col: str = "file_name", path_col: str = "warc_path", count_col: str = "token_count", tokens: Callable[[Column], Column] = white_words) -> DataFrame:
    """Rows of ``extracted`` (such as JSON lines) as documents of ``schema``: texts of fewer than ``min_chars`` characters go, the file each came from gets the path listed for its name, tokens are counted anew.

    A null text goes; a file without a listed path goes with its rows; ``tokens`` counts the tokens of a text.
    """
    ship(extracted.sparkSession)
    long = extracted.where(F.char_length(text_col) >= min_chars)
    placed = full_path(long, paths, file_col, path_col)
    return conform(placed.withColumn(count_col, tokens(F.col(text_col))), schema)
