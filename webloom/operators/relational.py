"""Joins, sets and schema checks with the conditions that make them safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators.ranges import RANGE, in_ranges


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The columns of ``schema``, cast, in its order; extra ones are dropped, a missing one is an error."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def one_of(column: Column, allowed: tuple[str, ...]) -> Column:
    """The column, or an error for a value that isn't allowed; null passes."""
    return F.when(column.isNull() | column.isin(*allowed), column).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), column)).cast("string"))


def unique_or_error(df: DataFrame, key: list[str], what: str) -> DataFrame:
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: {twice[0]} is there more than once")
    return df


def full_path(df: DataFrame, paths: DataFrame, name_col: str, path_col: str) -> DataFrame:
    """``df`` and the listed path that ends in its file name, the least of several; rows without one go."""
    named = paths.groupBy(F.element_at(F.split(path_col, "/"), -1).alias(name_col)).agg(F.min(path_col).alias(path_col))
    return df.join(named, name_col)


def keyed_sidecar(docs: DataFrame, side: DataFrame, id_col: str = "id") -> DataFrame:
    """A sidecar joined by id, after a check that its ids are unique; documents without a label stay."""
    return docs.join(unique_or_error(side, [id_col], "sidecar"), id_col, "left")


#: A key with more than this part of all rows is joined by broadcast: there are fewer such keys than one in this part.
HOT = 1_000


def join_by_size(rows: DataFrame, small: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``small``, one row for each ``key``, whose column ``size`` tells how many of the ``rows`` have it; they are ``total`` in all.

    The keys of more than a thousandth of all rows, fewer than a thousand, are broadcast, so none of them meets in one task.
    """
    hot = F.col(size) * HOT > total
    rest = rows.join(F.broadcast(small.where(hot).select(key)), key, "left_anti").join(small.where(~hot), key)
    return rows.join(F.broadcast(small.where(hot)), key).unionByName(rest).drop(size)


def first_occurrence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def latest(df: DataFrame, key: list[str], line: str, value: str) -> DataFrame:
    """Per key the value of the last line; ``first_line`` keeps the order of first appearance."""
    return df.groupBy(*key).agg(F.max_by(value, line).alias(value), F.min(line).alias("first_line"))


def agreeing(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key; a key with two texts is an error."""
    seen = df.groupBy(key).agg(F.min(text).alias(text), F.max(text).alias("__other"))
    return seen.select(F.when(F.col(text).eqNullSafe(F.col("__other")), F.col(key)).otherwise(F.raise_error(F.lit("one id, two texts")).cast(df.schema[key].dataType)).alias(key), text)


def with_control(runs: DataFrame, group: str = "group", is_control: Column | None = None) -> DataFrame:
    """Each run and its group's control (columns control_...); a group without one is an error."""
    is_control = F.col("arm") == "control" if is_control is None else is_control
    controls = runs.where(is_control)
    lone = runs.select(group).distinct().join(controls, group, "left_anti").limit(1).collect()
    if lone:
        raise ValueError(f"{lone[0][0]} has no control")
    renamed = controls.select(F.col(group), *[F.col(c).alias(f"control_{c}") for c in controls.columns if c != group])
    return runs.join(renamed, group)


def control_closure(runs: DataFrame, chosen: DataFrame, name: str = "name", group: str = "group") -> DataFrame:
    """The chosen runs and the controls of their groups."""
    groups = runs.join(chosen, name, "left_semi").select(group).distinct()
    return runs.join(chosen, name, "left_semi").unionByName(runs.where("arm = 'control'").join(groups, group, "left_semi")).distinct()


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_value: str, right_value: str, tolerance: float, right_key: str, gain: str | None = None, least_gain: float = 0.0) -> DataFrame:
    """Each left row and the right row of the same group whose value is nearest in ratio, if |ln ratio| is within the tolerance; ties go to the smaller key.

    With ``gain``, a column of the right side, a left row whose nearest partner gains less than ``least_gain`` goes.
    Rows without a group or a positive value match nothing.

    An as-of merge: both sides together are dealt over ranges of group and value, each range carries its last and next
    right row through, and what is missing at a range's ends comes from a table of two right rows a range. Of
    right rows of one value only that of the smallest key takes part, so the cost doesn't grow with how many are near.
    """
    real = lambda df, value: df.where(F.col(value) > 0).dropna(subset=by)
    others = [c for c in right.columns if c not in by]
    group = [f"__by{i}" for i in range(len(by))]
    named = [F.col(c).alias(g) for c, g in zip(by, group, strict=True)]
    match = F.struct(*[F.col(c).alias(f"match_{c}") for c in others])
    single = real(right, right_value).groupBy(*named, F.col(right_value).cast("double").alias("__v")).agg(F.min_by(match, right_key).alias("__match"))
    rows = real(left, left_value).select(*named, F.col(left_value).cast("double").alias("__v"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.monotonically_increasing_id().alias("__tie"))
    both = rows.unionByName(single.withColumns({"__side": F.lit(0), "__tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    dealt = in_ranges(both, *group, "__v", "__side", "__tie")

    def carried(column: str, over, end: int) -> Column:
        return F.last(column, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, end))

    ends = dealt.where("__match is not null").groupBy(*group, RANGE).agg(F.min_by("__match", "__v").alias("first"), F.max_by("__match", "__v").alias("last"))
    # A group of one range needs nothing from others; of the rest there are two rows a range at most.
    spans = dealt.groupBy(*group, RANGE).agg(F.count("*").alias("__n")).withColumn("__ranges", F.count("*").over(Window.partitionBy(*group))).where("__ranges > 1").drop("__n", "__ranges")
    along = Window.partitionBy(*group)
    patched = spans.join(ends, [*group, RANGE], "left").select(*group, RANGE, carried("last", along.orderBy(RANGE), -1).alias("__earlier"), carried("first", along.orderBy(F.desc(RANGE)), -1).alias("__later"))
    inside = Window.partitionBy(*group, RANGE)
    place = ["__v", "__side", "__tie"]
    seen = dealt.withColumns({"__below": carried("__match", inside.orderBy(*place), 0), "__above": carried("__match", inside.orderBy(*[F.desc(c) for c in place]), 0)})
    seen = seen.where("__side = 1").join(F.broadcast(patched), [*group, RANGE], "left")
    below, above = F.coalesce("__below", "__earlier"), F.coalesce("__above", "__later")
    distance = lambda m: F.abs(F.ln(m[f"match_{right_value}"] / F.col(f"__left.{left_value}")))
    far = F.lit(float("inf"))
    options = [F.struct(F.coalesce(distance(m), far).alias("distance"), m[f"match_{right_key}"].alias("key"), m.alias("match")) for m in (below, above)]
    first = (options[0]["distance"] < options[1]["distance"]) | ((options[0]["distance"] == options[1]["distance"]) & F.coalesce(options[0]["key"] <= options[1]["key"], options[1]["key"].isNull()))
    found = seen.select("__left", F.when(first, options[0]).otherwise(options[1]).alias("best")).where((F.col("best.distance") <= tolerance) & F.col("best.match").isNotNull()).select("__left.*", "best.match.*", "best.distance")
    return found.where(F.col(f"match_{gain}") >= least_gain) if gain else found


def snap(value: Column, budgets: tuple[float, ...], tolerance: float = 0.015) -> Column:
    """The first listed budget within the relative tolerance, or null."""
    out = F.lit(None).cast("double")
    for b in reversed(budgets):
        out = F.when(F.abs(value / b - 1) <= tolerance, F.lit(float(b))).otherwise(out)
    return out
