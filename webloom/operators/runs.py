"""Training runs joined with their losses, and what studies of them report: pairs, contrasts, slices, grids, status counts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.relational import unique_or_error
from webloom.session import ship


def uncovered(runs: DataFrame, losses: DataFrame, target: str, name: str = "name") -> DataFrame:
    """The runs without a loss on this target."""
    return runs.join(losses.where(F.col("target") == target).select(name), name, "left_anti")


def with_losses(runs: DataFrame, losses: DataFrame, targets: Iterable[str], name: str = "name") -> DataFrame:
    """Each run once per target, with its ``loss``; a loss that is missing or there twice is an error."""
    wanted = runs.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    joined = wanted.join(unique_or_error(losses, [name, "target"], "losses"), [name, "target"], "left")
    missing = F.concat(F.lit("no loss of run "), F.col(name).cast("string"), F.lit(" on "), F.col("target"))
    return joined.withColumn("loss", F.when(F.col("loss").isNotNull(), F.col("loss")).otherwise(F.raise_error(missing).cast("double")))


def arm_pairs(runs: DataFrame, first: str, second: str, group: str = "grp", arm: str = "arm") -> DataFrame:
    """group and, for groups that have both arms, a struct of either's run of least name (columns of the arms' names)."""
    row = F.struct(*[c for c in runs.columns if c != group])
    pick = lambda a: F.min_by(F.when(F.col(arm) == a, row), F.when(F.col(arm) == a, F.col("name"))).alias(a)
    return runs.where(F.col(arm).isin(first, second)).groupBy(group).agg(pick(first), pick(second)).where(F.col(first).isNotNull() & F.col(second).isNotNull())


def matched(left: DataFrame, right: DataFrame, by: list[str], suffix: str = "match") -> DataFrame:
    """``left`` and the run of ``right`` with the same keys; two such runs are an error, left runs without one go."""
    renamed = unique_or_error(right, by, "matches").select(*by, *[F.col(c).alias(f"{suffix}_{c}") for c in right.columns if c not in by])
    return left.join(renamed, by)


def folds(runs: DataFrame, size: str) -> DataFrame:
    """Every run in the fold ``all`` and in ``without_<size>`` of all sizes but its own."""
    sizes = runs.select(F.col(size).alias("__left_out")).distinct()
    named = sizes.select("__left_out", F.concat(F.lit("without_"), F.col("__left_out").cast("string")).alias("fold"))
    rest = runs.join(F.broadcast(named), ~F.col(size).eqNullSafe(F.col("__left_out"))).drop("__left_out")  # a row for each size
    return runs.withColumn("fold", F.lit("all")).unionByName(rest)


def slices(scored: DataFrame, by: list[str], sizes: Iterable, cutoffs: Iterable[float | None], size: str = "size", ratio: str = "ratio", arm: str = "arm", paired: str = "paired", absolute: str = "absolute") -> DataFrame:
    """by, slice_size, slice_cutoff (null: all), runs, ai_runs, human_runs and RMSEs: paired of AI and human additions, absolute of AI additions and of all. Slices without runs are absent."""
    options = F.array(*[F.struct(F.lit(s).cast("string").alias("slice_size"), F.lit(c).cast("double").alias("slice_cutoff")) for s in sizes for c in cutoffs])
    rows = scored.withColumn("__s", F.explode(options)).select("*", "__s.*")
    rows = rows.where((F.col("slice_size").isNull() | (F.col(size).cast("string") == F.col("slice_size"))) & (F.col("slice_cutoff").isNull() | (F.col(ratio) < F.col("slice_cutoff") - 1e-10)))
    of = lambda a, c: F.when(F.col(arm) == a, F.col(c))
    root = lambda c: F.sqrt(F.avg(c * c))
    return rows.groupBy(*by, "slice_size", "slice_cutoff").agg(
        F.count("*").alias("runs"), F.count(of("ai", arm)).alias("ai_runs"), F.count(of("human", arm)).alias("human_runs"), root(of("ai", paired)).alias("paired_ai"), root(of("human", paired)).alias("paired_human"), root(of("ai", absolute)).alias("absolute_ai"), root(F.col(absolute)).alias("absolute_all")
    )


def contrasts(losses: DataFrame, human: str, ai: str, group: str = "grp") -> DataFrame:
    """For runs with a loss per target and their group's control among them: name, control, control losses, changes on the human and the AI target, and the AI share of an evaluation at which they cancel (null unless one is harm and the other gain)."""
    wide = losses.where(F.col("target").isin(human, ai)).groupBy("name", group, "arm").agg(*[F.max(F.when(F.col("target") == t, F.col("loss"))).alias(n) for t, n in ((human, "human_loss"), (ai, "ai_loss"))])
    control = wide.where("arm = 'control'").select(group, F.col("name").alias("control"), F.col("human_loss").alias("control_human"), F.col("ai_loss").alias("control_ai"))
    d = wide.where("arm = 'ai'").join(control, group).withColumns({"delta_human": F.col("human_loss") - F.col("control_human"), "delta_ai": F.col("ai_loss") - F.col("control_ai")})
    critical = F.when((F.col("delta_human") > 0) & (F.col("delta_ai") < 0), F.col("delta_human") / (F.col("delta_human") - F.col("delta_ai")))
    return d.select("name", group, "control", "control_human", "control_ai", "delta_human", "delta_ai", critical.alias("critical_share"))


def reported_change(share: Column) -> Column:
    """Relative change that an evaluation with this AI share reports, of rows of ``contrasts``."""
    mix = lambda h, a: (1 - share) * F.col(h) + share * F.col(a)
    return mix("delta_human", "delta_ai") / mix("control_human", "control_ai")


def masking_at(found: DataFrame, shares: Iterable[float]) -> DataFrame:
    """share, harmed (runs that raise the human loss), masked (of those, reported as gains), masked_share and median_change."""
    harmed = found.where("delta_human > 0").withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rows = harmed.withColumn("reported", reported_change(F.col("share")))
    return rows.groupBy("share").agg(F.count("*").alias("harmed"), F.sum((F.col("reported") < 0).cast("long")).alias("masked"), F.avg((F.col("reported") < 0).cast("double")).alias("masked_share"), F.percentile("reported", 0.5).alias("median_change"))


def median_flip(found: DataFrame, by: str) -> DataFrame:
    """by, share: the AI share at which the median reported change of the harmed runs turns from harm to gain. A group is one study's harmed runs."""
    ship(found.sparkSession)

    def flip(rows: pd.DataFrame) -> pd.DataFrame:
        dh, da, ch, ca = (rows[c].to_numpy(float) for c in ("delta_human", "delta_ai", "control_human", "control_ai"))
        median = lambda q: np.median(((1 - q) * dh + q * da) / ((1 - q) * ch + q * ca))
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if median(middle) > 0 else (low, middle)
        return pd.DataFrame({by: [rows[by].iloc[0]], "share": [(low + high) / 2]})

    kind = found.schema[by].dataType.simpleString()
    return found.where("delta_human > 0").select(by, "delta_human", "delta_ai", "control_human", "control_ai").groupBy(by).applyInPandas(flip, f"{by} {kind}, share double")


def status_counts(found: DataFrame, by: list[str], status: str) -> DataFrame:
    """Rows of each status, those of all statuses that occur anywhere listed for each group."""
    return found.groupBy(*by).pivot(status).count().na.fill(0)


def grid(runs: DataFrame, row: str, column: str, cells: list) -> DataFrame:
    """row and, for each of the columns' values, its runs as text: AI additions + human additions, ``--`` where there are none; other values count in ``other``."""
    count = lambda rule: F.sum(F.when(rule, 1).otherwise(0))

    def cell(inside: Column, name: str) -> Column:
        ai, human, every = (count(inside & r) for r in (F.col("arm") == "ai", F.col("arm") == "human", F.lit(True)))
        return F.when(every == 0, "--").otherwise(F.concat(ai.cast("string"), F.when(human > 0, F.concat(F.lit("+"), human.cast("string"))).otherwise(""))).alias(name)

    known = F.coalesce(F.col(column).isin(cells), F.lit(False))
    return runs.groupBy(row).agg(*[cell(F.coalesce(F.col(column) == c, F.lit(False)), str(c)) for c in cells], cell(~known, "other"))


def both_ends(df: DataFrame, value: str, k: int, ties: str) -> DataFrame:
    """The k rows of lowest and the k of highest value, with the end they are at."""
    end = lambda order, name: df.where(F.col(value).isNotNull()).orderBy(order, ties).limit(k).withColumn("end", F.lit(name))
    return end(F.col(value).asc(), "lowest").unionByName(end(F.col(value).desc(), "highest"))


def highlights(df: DataFrame, name: str, volume: str, share: str, documents: str, by_volume: int, by_share: int, least: int) -> DataFrame:
    """name, place: the largest by volume, then those of highest share among the ones with ``least`` documents, in order of first appearance."""
    top = lambda rows, value, k, part: rows.orderBy(F.col(value).desc(), name).limit(k).select(name, F.struct(F.lit(part).alias("part"), (-F.col(value)).cast("double").alias("value"), F.col(name).alias("n")).alias("at"))
    both = top(df, volume, by_volume, 1).unionByName(top(df.where(F.col(documents) >= least), share, by_share, 2))
    first = both.groupBy(name).agg(F.min("at").alias("at"))
    return first.select(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")).alias("place"))  # by_volume + by_share rows at most


def heat_cells(counts: DataFrame, across: str, down: str, least: int, cap: float = 0.98) -> DataFrame:
    """across, down, documents, percent (AI; null below ``least`` documents), shade (percent over its ``cap`` quantile, at most 1), and the axes' places by falling AI share. ``counts``: across, down, documents, ai."""
    cells = counts.groupBy(across, down).agg(F.sum("documents").alias("documents"), F.sum("ai").alias("ai"))
    cells = cells.withColumn("percent", F.when(F.col("documents") >= least, 100.0 * F.col("ai") / F.col("documents")))
    top = cells.agg(F.percentile("percent", cap).alias("__top"))
    place = lambda c: cells.groupBy(c).agg((F.sum("ai") / F.sum("documents")).alias("s")).select(c, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), c)).alias(f"{c}_place"))
    joined = cells.join(place(across), across).join(place(down), down).crossJoin(F.broadcast(top))  # one row
    return joined.select(across, down, "documents", "percent", F.least(F.lit(1.0), F.try_divide("percent", "__top")).alias("shade"), f"{across}_place", f"{down}_place")


def catalog(runs: DataFrame, group: str = "grp") -> DataFrame:
    """``runs`` (name, group, arm) with the control of each addition and the partner of each run of a filtering pair, null for others; of several the least name."""
    least = lambda arms, to: runs.where(F.col("arm").isin(*arms)).groupBy(group).agg(F.min("name").alias(to))
    joined = runs.join(least(["control"], "__control"), group, "left").join(least(["natural"], "__natural"), group, "left").join(least(["filtered"], "__filtered"), group, "left")
    control = F.when(F.col("arm").isin("ai", "human", "repeat"), F.col("__control"))
    partner = F.when(F.col("arm") == "natural", F.col("__filtered")).when(F.col("arm") == "filtered", F.col("__natural"))
    return joined.select(*runs.columns, control.alias("control"), partner.alias("partner"))


def members(runs: DataFrame, group: str = "grp") -> DataFrame:
    """group, control, ai, human: the group's control and its additions in order of name. A group is some tens of runs."""
    of = lambda arm: F.sort_array(F.collect_list(F.when(F.col("arm") == arm, F.col("name")))).alias(arm)
    return runs.groupBy(group).agg(F.min(F.when(F.col("arm") == "control", F.col("name"))).alias("control"), of("ai"), of("human"))


def added_fraction(arm: Column, human: Column, added: Column, control_human: Column) -> Column:
    """Tokens a run adds per human token of its control: AI ones, or human ones beyond the control's."""
    return F.when(arm == "human", human / control_human - 1).otherwise(added / human)


def unique_cases(cases: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every case once, where it is asked for first."""
    return cases.groupBy(*key).agg(F.min(order).alias(order))


def run_steps(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registered steps of the wanted runs (name) and of their groups' controls, which filtered runs borrow."""
    control = registry.where("arm = 'control'").select("grp", F.col("steps").alias("control_steps"))
    return wanted.join(unique_or_error(registry, ["name"], "registry"), "name", "left").join(control, "grp", "left")


def step_tokens(depth: Column) -> Column:
    """Tokens of a training step by the model's depth."""
    return F.when(depth <= 6, 1 << 18).when(depth <= 16, 1 << 19).otherwise(1 << 20).cast("long")
