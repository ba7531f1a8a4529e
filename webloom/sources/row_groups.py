"""Row groups of Parquet files as blocks: listed from the files' footers, and read one by one.

A footer says where each row group lies and how many rows it has, so blocks are listed without reading a row, ordered
by a seed, and only those that are asked for are read, with the columns that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from webloom.session import ship


def _opened(path: str):
    """An open Parquet file, in any store that Arrow knows by its address."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(system.open_input_file(place))


def parquet_files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files below a folder, in order of path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    out = []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().endswith(".parquet") and not any(part.startswith(("_", ".")) for part in path.toString()[len(folder) :].split("/")):
            out.append(path.toString())
    return sorted(out)


def row_groups(spark: SparkSession, dumps: dict[str, str]) -> DataFrame:
    """dump, file_path, file_name, block, first_row, rows, bytes (as stored) of every row group in the folders of several dumps; footers are read by tasks."""
    ship(spark)
    files = [(dump, path) for dump, folder in dumps.items() for path in parquet_files(spark, folder)]
    if not files:
        raise FileNotFoundError(f"no Parquet files in {', '.join(dumps.values())}")
    listed = spark.createDataFrame(files, "dump string, file_path string").repartition(min(len(files), 10_000))

    def footers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for dump, path in zip(part["dump"], part["file_path"], strict=True):
                with _opened(path) as file:
                    at = 0
                    for i in range(file.metadata.num_row_groups):
                        group = file.metadata.row_group(i)
                        size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
                        rows.append((dump, path, path.rsplit("/", 1)[-1], i, at, group.num_rows, size))
                        at += group.num_rows
            yield pd.DataFrame(rows, columns=["dump", "file_path", "file_name", "block", "first_row", "rows", "bytes"])

    return listed.mapInPandas(footers, "dump string, file_path string, file_name string, block long, first_row long, rows long, bytes long")


def read_groups(groups: DataFrame, columns: str, keep: tuple[str, ...] = ("dump", "file_name", "block"), blocks_read=None) -> DataFrame:
    """The rows of the row groups ``groups`` (of ``row_groups``): ``columns`` (DDL), row_index, and the columns of ``groups`` named in ``keep``.

    Of a row group only those columns are read. ``blocks_read``, an accumulator, counts the row groups read.
    """
    ship(groups.sparkSession)
    wanted = T.StructType.fromDDL(columns)
    kept = [groups.schema[c] for c in keep]
    schema = T.StructType([*wanted.fields, T.StructField("row_index", T.LongType()), *kept])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for part in parts:
            for row in part.to_pylist():
                if blocks_read is not None:
                    blocks_read.add(1)
                with _opened(row["file_path"]) as file:
                    at = row["first_row"]
                    for batch in file.iter_batches(2_000, row_groups=[row["block"]], columns=wanted.names):
                        n = batch.num_rows
                        values = [batch.column(c) for c in wanted.names] + [pa.array(range(at, at + n), pa.int64())] + [pa.array([row[c]] * n) for c in keep]
                        at += n
                        yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, target, strict=True)], schema=target)

    return groups.mapInArrow(read, schema)
