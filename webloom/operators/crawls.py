"""Reading crawls block by block: a seeded order of blocks over several dumps, reading until enough is found, monthly samples, and stages that resume."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.hashing import rank_hash, seeded_key
from webloom.operators import budget
from webloom.sources.row_groups import read_groups
from webloom.sources.tables import exists, materialised


def block_hash(seed: int, dump: str = "dump", file: str = "file_name", block: str = "block") -> Column:
    """The place of a block in the seeded order: a hash of dump, file name and number, so folders and machines don't matter."""
    return rank_hash(seeded_key("row-blocks", seed), F.concat(F.col(dump), F.lit("/"), F.col(file), F.lit("#"), F.col(block).cast("string")))


def in_block_order(rows: DataFrame, seed: int, rows_per_block: int, dump: str = "dump", file: str = "file_name", row: str = "row_index") -> DataFrame:
    """``rows`` with block and block_hash; sorted by (block_hash, row) they are the blocks of all dumps in seeded order."""
    return rows.withColumn("block", F.floor(F.col(row) / rows_per_block).cast("long")).withColumn("block_hash", block_hash(seed, dump, file))


def until_enough(rows: DataFrame, wanted: Column, needed: int) -> DataFrame:
    """The blocks (block_hash) in order until ``needed`` rows are ``wanted``; the block that reaches it is whole.

    Only one sum per block takes part in the running total.
    """
    blocks = rows.groupBy("block_hash").agg(F.sum(F.coalesce(wanted, F.lit(False)).cast("long")).alias("__found"))
    read = budget.running_total(blocks, "block_hash", F.col("__found"), ties=()).where(F.col("before") < needed).select("block_hash")
    return rows.join(read, "block_hash", "left_semi")


def enough_groups(groups: DataFrame, order: list[str], measure: Column, measured_columns: str, needed: int, *, first: int = 1, blocks_read=None) -> tuple[DataFrame, int, int]:
    """``groups`` (of ``sources.row_groups``) with ``place``, their number in ``order``; how many of them it takes for the sum of ``measure`` over their rows to be ``needed``; and that sum before the last of these.

    Groups are measured in waves, each as large as what was found so far asks for, four times the one before at most,
    and ``measured_columns`` are all that is read of them. Groups behind the last wave are never opened.
    """
    ordered = materialised(budget.running_total_in_order(groups, [*order, "file_path", "block"], F.lit(1), name="place"))
    last, at, found, before, size = ordered.count(), 0, 0, 0, first
    while at < last and found < needed:
        wave = ordered.where((F.col("place") >= at) & (F.col("place") < at + size))
        measured = read_groups(wave.repartition(min(size, 10_000)), measured_columns, ("place",), blocks_read).groupBy("place").agg(F.sum(F.coalesce(measure, F.lit(0))).cast("long").alias("n"))
        by_place = {r["place"]: r["n"] for r in measured.collect()}  # a row for each group of the wave
        for place in range(at, min(at + size, last)):
            before, found = found, found + by_place.get(place, 0)
            if found >= needed:
                last = place + 1
                break
        at += size
        missing = math.ceil((needed - found) * at / found) if found else 4 * size
        size = max(1, min(missing, 4 * size))
    return ordered, last if needed > 0 else 0, before


def row_groups_until_enough(groups: DataFrame, seed: int, columns: str, wanted: Column, wanted_columns: str, needed: int, *, first: int = 1, blocks_read=None) -> DataFrame:
    """The rows of row groups (of ``sources.row_groups``) in seeded order until ``needed`` are ``wanted``; the group that reaches it is whole (see ``enough_groups``)."""
    hashed = groups.withColumn("block_hash", block_hash(seed))
    ordered, n, _ = enough_groups(hashed, ["block_hash"], F.coalesce(wanted, F.lit(False)).cast("long"), wanted_columns, needed, first=first, blocks_read=blocks_read)
    return read_groups(ordered.where(F.col("place") < n), columns, ("dump", "file_name", "block", "block_hash"), blocks_read)


def month_sample(candidates: DataFrame, month: str, n: int, key: str, date: str = "date", id_col: str = "id") -> DataFrame:
    """The n documents of the month with the smallest month-keyed hash; fewer are an error."""
    inside = candidates.where(F.substring(date, 1, 7) == month).withColumn("h", rank_hash(f"{key}/{month}", id_col)).withColumn("month", F.lit(month))
    return budget.bottom_k_by(inside, ["month"], "h", n, ties=(id_col,), strict=True)


def month_samples(candidates: DataFrame, n: int, key: str, month: str = "month", id_col: str = "id") -> DataFrame:
    """All months at once: the n documents of smallest month-keyed hash of each."""
    hashed = candidates.withColumn("h", F.sha2(F.concat(F.lit(f"{key}/"), F.col(month), F.lit(":"), F.col(id_col).cast("string")), 256))
    return budget.bottom_k_by(hashed, [month], "h", n, ties=(id_col,))


def collected(rows: DataFrame, seed: int, rows_per_block: int, target: int, tokens: str = "tokens") -> DataFrame:
    """Per dump the documents in block order until ``target`` tokens are read; the one that reaches it is in."""
    placed = in_block_order(rows, seed, rows_per_block).withColumn("__order", F.concat("block_hash", F.lpad(F.col("row_index").cast("string"), 12, "0")))
    return budget.fill_budget(placed, "__order", tokens, target, by=["dump"], ties=()).drop("__order")


def resumed(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a finished stage, or of ``build`` run now; a stage that died left no marker and is built again."""
    if not exists(spark, f"{folder.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def in_batches(spark: SparkSession, files: Iterable[str], size: int, folder: str, build: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The tables of consecutive batches of files, each resumed on its own, as one."""
    files, out = list(files), None
    for number, at in enumerate(range(0, len(files), size)):
        batch = resumed(spark, f"{folder.rstrip('/')}/batch-{number:05d}", lambda at=at: build(files[at : at + size]))
        out = batch if out is None else out.unionByName(batch)
    if out is None:
        raise ValueError("no files")
    return out
