"""Prefixes of an order that fill a budget of tokens or characters.

All keep the rows whose sum of weights before them is below the target, so the row that crosses it is kept; the
flags trim that row to hit the target exactly, or add rows that tie with the last. A running total over a whole table
would be one task's work. ``running_total`` therefore sums by ranges of the order first (leading digits of a hash,
or cuts on a number and its ties), turns those few sums into offsets, and runs the totals within each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators.ranges import RANGE, in_ranges

#: Leading hex digits that cut a global order into ranges: 16^3 of them.
DIGITS = 3


def running_total(df: DataFrame, hash_col: str, weight: Column, *, by: list[str] | None = None, ties: tuple[str, ...] = ("id",), descending: bool = False, name: str = "before", digits: int = DIGITS) -> DataFrame:
    """``df`` and the sum of ``weight`` (null: 0) over the rows before each in order of ``hash_col``, then ``ties``; per group of ``by`` if given.

    ``hash_col`` is hex text of fixed length, spread evenly; its first ``digits`` cut the order into ranges, 16 times
    as many for each more. Of a number's values one may hold most rows: then ranges are cut on all of group, number and ties.
    """
    groups = list(by or [])
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if isinstance(df.schema[hash_col].dataType, T.NumericType):
        return running_total_in_order(df, [direction(c) for c in (hash_col, *ties)], weight, by=groups, name=name)
    ranged = df.withColumn(RANGE, F.substring(hash_col, 1, digits))
    return _total_by_range(ranged, groups, direction(RANGE), [direction(c) for c in (hash_col, *ties)], weight, name)


def running_total_in_order(df: DataFrame, order: list[Column | str], weight: Column, *, by: list[str] | None = None, name: str = "before") -> DataFrame:
    """As ``running_total``, in any order of several columns: ranges are cut on all of them, so no value is one task's."""
    groups = list(by or [])
    return _total_by_range(in_ranges(df, *groups, *order), groups, F.col(RANGE).asc(), order, weight, name)


def _total_by_range(ranged: DataFrame, groups: list[str], along: Column, order: list[Column | str], weight: Column, name: str) -> DataFrame:
    """Sums inside each range, and those of the ranges before it."""
    cell = ranged.withColumn("__weight", F.coalesce(weight, F.lit(0)).cast("long"))
    sums = cell.groupBy(*groups, RANGE).agg(F.sum("__weight").alias("__sum"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = sums.select(*groups, RANGE, (F.sum("__sum").over(over.orderBy(along).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__offset"))
    inside = Window.partitionBy(*groups, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cell.withColumn("__inside", F.sum("__weight").over(inside) - F.col("__weight"))
    # Null is a group like others.
    names = {g: f"__of_{g}" for g in groups} | {RANGE: "__of_range"}
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    return summed.join(offsets.withColumnsRenamed(names), same).drop(*names.values()).withColumn(name, F.col("__inside") + F.col("__offset")).drop(RANGE, "__weight", "__inside", "__offset")


def fill_budget(df: DataFrame, hash_col: str, weight_col: str, target: Column | int, *, by: list[str] | None = None, ties: tuple[str, ...] = ("id",), descending: bool = False, trim: bool = False, with_ties: bool = False) -> DataFrame:
    """The rows that fill ``target``. ``trim``: the last is cut so that the sum is the target. ``with_ties``: rows of the last one's hash come too. A target of 0 or less keeps nothing."""
    target = F.lit(target) if isinstance(target, int) else target
    summed = running_total(df, hash_col, F.col(weight_col), by=by, ties=ties, descending=descending).withColumn("__target", target)
    chosen = F.col("before") < F.col("__target")
    if with_ties:
        last = summed.where(chosen).groupBy(*(by or [])).agg(F.max(hash_col).alias("__last"))
        joined = summed.join(last, by) if by else summed.crossJoin(last)  # one row for each group, or one in all
        return joined.where(F.col(hash_col) <= F.col("__last")).drop("before", "__target", "__last")
    out = summed.where(chosen)
    if trim:
        out = out.withColumn(weight_col, F.least(F.col(weight_col).cast("long"), F.col("__target") - F.col("before")))
    return out.drop("before", "__target")


def require_budget(df: DataFrame, weight_col: str, target: int) -> DataFrame:
    """``df``, or an error if its weights don't reach ``target``."""
    total = df.agg(F.coalesce(F.sum(weight_col), F.lit(0)).alias("total")).first()["total"]
    if total < target:
        raise ValueError(f"not enough data: {total:,} available, {target:,} needed")
    return df


def hash_threshold(df: DataFrame, hash_col: str, weight_col: str, quota: Column | int, by: list[str]) -> DataFrame:
    """Per group the largest hash that a quota takes in; groups with a quota of 0 or less are absent."""
    return fill_budget(df, hash_col, weight_col, quota, by=by).groupBy(*by).agg(F.max(hash_col).alias("threshold"))


def equal_budgets(names: DataFrame, total: int, name_col: str = "name") -> DataFrame:
    """name, budget: the total dealt evenly over sorted names, the first ones taking the remainder."""
    n = names.select(name_col).distinct()
    counted = n.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name_col)))
    return counted.select(name_col, (F.floor(F.lit(total) / F.col("__n")) + (F.col("__rank") <= F.lit(total) % F.col("__n")).cast("long")).cast("long").alias("budget"))


def quotas(totals: DataFrame, budget: int, *, by: list[str], ai_col: str = "ai_tokens", available_col: str = "available") -> DataFrame:
    """Per group min(available, round-half-even(budget * share of all ai tokens)); no ai tokens at all is an error."""
    all_ = totals.agg(F.coalesce(F.sum(ai_col), F.lit(0)).alias("n")).first()["n"]
    if not all_:
        raise ValueError("no labelled tokens to take quotas from")
    return totals.select(*by, F.least(F.col(available_col).cast("long"), F.bround(F.lit(budget) * F.col(ai_col) / F.lit(all_)).cast("long")).alias("quota"))


def bottom_k(df: DataFrame, hash_col: str, k: int, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k rows of smallest hash."""
    return df.orderBy(hash_col, *ties).limit(max(0, k))


def bottom_k_by(df: DataFrame, by: list[str], hash_col: str, k: int, ties: tuple[str, ...] = ("id",), strict: bool = False) -> DataFrame:
    """The k rows of smallest hash of each group. ``strict``: a group of fewer is an error."""
    if strict:
        short = df.groupBy(*by).count().where(F.col("count") < k).limit(1).collect()
        if short:
            raise ValueError(f"{short[0]} has fewer than {k} rows")
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(hash_col, *ties))).where(F.col("__rank") <= k).drop("__rank")
