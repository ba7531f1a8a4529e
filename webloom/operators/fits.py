"""Many fits at once: of every law, target and fold all starts are searched from, and the best end is kept.

Where cases have few runs, every law, target, fold and part of the starts is a task that gets its case's runs. Where
one has many, no task gets them: all searches take their steps together, and each round of steps is two passes over the
runs that add up, in every partition, what the steps need (``fitting.Sums``). Both take the same steps. Ends are rows, so the choice of the best is an aggregation and does not depend on how starts or runs were dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fitting, laws
from webloom.functions.solve import loss as law_loss
from webloom.session import ship

CASE = ["law", "target", "fold"]
ENDS = "law string, target string, fold string, start int, theta array<double>, cost double, converged boolean, held array<string>"
#: Cases of more runs are not solved within tasks.
LOCAL_RUNS = 2_000
#: Runs whose values a task works on at once.
BLOCK = 8_192


def _cohort(rows: pd.DataFrame) -> fitting.Cohort:
    rows = rows.sort_values("name")
    return fitting.Cohort.of(*(rows[c] for c in ("parameters", "human", "added", "loss")), rows["name"].tolist(), rows["control"].tolist())


def reached(runs: DataFrame, names: list[str], n_starts: int = 16, chunk: int = 8, seed: int = 0, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """law, target, fold, start, theta, cost, converged, held: where every start ends. ``runs``: target, fold, name, control, parameters, human, added, loss; the laws are dealt over them."""
    ship(runs.sparkSession)
    runs = runs.select("target", "fold", "name", "control", "parameters", "human", "added", "loss")
    sizes = runs.groupBy("target", "fold").agg(F.count("*").alias("runs"), F.min("loss").alias("lowest")).collect()
    if any(r["runs"] > local_runs for r in sizes):
        return _reached_by_passes(runs, {(r["target"], r["fold"]): r["lowest"] for r in sizes}, names, n_starts, seed)
    return _reached_in_tasks(runs, names, n_starts, chunk, seed)


def _reached_in_tasks(runs: DataFrame, names: list[str], n_starts: int, chunk: int, seed: int) -> DataFrame:
    chunks = -(-(n_starts + 1) // chunk)
    dealt = runs.withColumn("law", F.explode(F.array(*map(F.lit, names)))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        law, target, fold, part = (rows[c].iloc[0] for c in ("law", "target", "fold", "chunk"))
        cohort = _cohort(rows)
        known, table, begin = fitting.starts(law, cohort, n_starts, seed)
        mine = range(part * chunk, min((part + 1) * chunk, len(begin)))
        found = [(i, fitting.solve(law, cohort, begin[i], table, known)) for i in mine]
        return pd.DataFrame([(law, target, fold, i, *r) for i, r in found if r], columns=[*CASE, "start", "theta", "cost", "converged", "held"])

    return dealt.groupBy(*CASE, "chunk").applyInPandas(solved, ENDS)


def _beside_controls(runs: DataFrame, cases: list[tuple[str, str]]) -> DataFrame:
    """case (place of target and fold in ``cases``, from 1), and n, d, r, t, log_loss of every run (own_) and its control (of_), runs of a control together."""
    spark = runs.sparkSession
    good = (F.col("parameters") > 0) & (F.col("human") > 0) & (F.col("loss") > 0) & (F.col("added") >= 0)
    loss = F.when(good, F.log("loss")).otherwise(F.raise_error(F.lit("runs need parameters, human tokens and a loss above 0 and no negative added tokens")).cast("double"))
    x = laws.Coordinates.of(*(F.col(c).cast("double") for c in ("parameters", "human", "added")))
    known = {"n": x.n, "d": x.d, "r": x.r, "t": x.t, "log_loss": loss}
    numbered = F.array(*[F.struct(F.lit(target).alias("target"), F.lit(fold).alias("fold")) for target, fold in cases])
    rows = runs.select(F.array_position(numbered, F.struct("target", "fold")).alias("case"), "name", "control", *[c.alias(f"own_{k}") for k, c in known.items()])
    controls = rows.select("case", F.col("name").alias("control"), F.lit(True).alias("__there"), *[F.col(f"own_{k}").alias(f"of_{k}") for k in known])
    joined = rows.join(controls, ["case", "control"], "left")
    there = F.when(F.col("__there"), F.col("name") == F.col("control")).otherwise(F.raise_error(F.concat(F.col("control").cast("string"), F.lit(" is not among the runs"))).cast("boolean"))
    dealt = joined.withColumn("own", there).repartition(spark.sparkContext.defaultParallelism, "case", "control").sortWithinPartitions("case", "control")
    return dealt.select("case", *[f"{side}_{k}" for side in ("own", "of") for k in known], "own")


def _sums(law: str, theta: np.ndarray, derivatives: bool, own: np.ndarray, of: np.ndarray, first: np.ndarray, place: np.ndarray, control: np.ndarray) -> fitting.Sums:
    """Sums over runs; ``first``: where another control's runs begin, ``place``: which of those each run belongs to."""
    names = fitting.COEFFICIENTS[law]
    r, j = fitting.log_losses(law, names, theta, laws.Coordinates(*own[:4]), derivatives)
    r0, j0 = fitting.log_losses(law, names, theta, laws.Coordinates(*of[:4, first]), derivatives)
    r, r0 = r - own[4], r0 - of[4, first]
    return fitting.sums(np.where(control, r, r - r0[place]), np.where(control, j, j - j0[:, place]) if derivatives else None)


def _pass(dealt: DataFrame, places: list[tuple[int, str, np.ndarray, bool]]) -> list[fitting.Sums]:
    """The sums of each place (case, law, coefficients, whether with derivatives) over all runs of its case, in one pass; a row per place and partition comes back."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, fitting.Sums] = {}

        def work(held: list[pa.RecordBatch]) -> None:
            number, *values, control = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            values = np.stack(values)
            for case in np.unique(number):
                mine = number == case
                own, of, is_control = values[:5, mine], values[5:, mine], control[mine]
                new = np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(axis=0)])
                first, place = np.flatnonzero(new), np.cumsum(new) - 1
                for i, (of_case, law, theta, derivatives) in enumerate(places):
                    if of_case == case:
                        found = _sums(law, theta, derivatives, own, of, first, place, is_control)
                        totals[i] = fitting.added_up([totals[i], found]) if i in totals else found

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                work(held)
                held = []
        if held:
            work(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([s.cost for s in totals.values()], pa.float64()), *(pa.array([np.ravel(s[k]).tolist() for s in totals.values()], pa.list_(pa.float64())) for k in (1, 2))], ["i", "cost", "gradient", "curve"])

    parts: list[list[fitting.Sums]] = [[] for _ in places]
    for r in dealt.mapInArrow(summed, "i int, cost double, gradient array<double>, curve array<double>").collect():
        parts[r["i"]].append(fitting.Sums(r["cost"], np.array(r["gradient"]), np.array(r["curve"]).reshape(len(r["gradient"]), len(r["gradient"]))))
    return list(map(fitting.added_up, parts))


def _reached_by_passes(runs: DataFrame, lowest: dict[tuple[str, str], float], names: list[str], n_starts: int, seed: int) -> DataFrame:
    """All searches at once, a pass over the runs for every round of steps; searches (a few dozen numbers each) are kept on the driver. ``lowest``: each target's and fold's lowest loss."""
    spark = runs.sparkSession
    searches, ends = {}, []
    cases = sorted(lowest)
    for target, fold in cases:
        least = fitting.Cohort(laws.Coordinates(*[np.ones(1)] * 4), np.log([lowest[target, fold]]), np.zeros(1, int))
        for law in names:
            known, table, begin = fitting.starts(law, least, n_starts, seed)
            for i, b in enumerate(begin):
                key = (law, target, fold, i)
                searches[key] = fitting.search(b, table, known)
    asked = {key: next(s) for key, s in searches.items()}
    dealt = _beside_controls(runs, cases).persist()
    try:
        while asked:
            found = iter(_pass(dealt, [(cases.index(key[1:3]) + 1, key[0], p, ask.derivatives) for key, ask in asked.items() for p in ask.places]))
            for key, ask in list(asked.items()):
                try:
                    asked[key] = searches[key].send([next(found) for _ in ask.places])
                except StopIteration as e:
                    del asked[key], searches[key]
                    if e.value:
                        ends.append((*key, *e.value))
    finally:
        dealt.unpersist()
    return spark.createDataFrame(ends, ENDS)


def fit_bank(runs: DataFrame, names: list[str], n_starts: int = 16, chunk: int = 8, seed: int = 0, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """law, target, fold, theta, cost, converged, held, starts: of each case the start that ends lowest, the first among equals; how many starts had a finite value."""
    ends = reached(runs, names, n_starts, chunk, seed, local_runs)
    lowest = F.min_by(F.struct("theta", "cost", "converged", "held"), F.struct("cost", "start"))
    return ends.groupBy(*CASE).agg(lowest.alias("end"), F.count("*").alias("starts")).select(*CASE, "end.*", "starts")


def coefficients(fits: DataFrame) -> dict[tuple[str, str, str], dict[str, float]]:
    """By case; a row for each fit comes to the driver."""
    return {(r["law"], r["target"], r["fold"]): dict(zip(fitting.COEFFICIENTS[r["law"]], r["theta"], strict=True)) for r in fits.select(*CASE, "theta").collect()}


def predicted_loss(fits: dict[tuple[str, str, str], dict[str, float]], law: Column, target: Column, fold: Column, parameters: Column, human: Column, added: Column) -> Column:
    """The loss that the row's case predicts for the row's run, in generated code."""
    out = F.lit(None).cast("double")
    for (l, t, f), p in fits.items():  # noqa: E741
        out = F.when((law == l) & (target == t) & (fold == f), law_loss(laws.LAWS[l], p, parameters, human, added)).otherwise(out)
    return out


def predictions(runs: DataFrame, fits: dict[tuple[str, str, str], dict[str, float]]) -> DataFrame:
    """``runs`` (target, name, control, parameters, human, added, loss) once per case of its target: law, fold, predicted, observed and predicted log change from the control, paired and absolute error. A prediction that is no positive number is an error."""
    cases = F.array(*[F.struct(F.lit(l).alias("law"), F.lit(t).alias("of"), F.lit(f).alias("fold")) for l, t, f in fits])  # noqa: E741
    rows = runs.withColumn("__case", F.explode(cases)).where(F.col("__case.of") == F.col("target")).select("*", "__case.law", "__case.fold").drop("__case")
    value = predicted_loss(fits, F.col("law"), F.col("target"), F.col("fold"), F.col("parameters"), F.col("human"), F.col("added"))
    rows = rows.withColumn("predicted", value).withColumn("predicted", F.when((F.col("predicted") > 0) & (F.col("predicted") < float("inf")), F.col("predicted")).otherwise(F.raise_error(F.concat(F.col("law"), F.lit(" predicts no positive number"))).cast("double")))
    control = rows.where("name = control").select("law", "target", "fold", "control", F.col("loss").alias("__loss"), F.col("predicted").alias("__predicted"))
    joined = rows.join(control, [*CASE, "control"]).withColumns({"observed_change": F.log(F.col("loss") / F.col("__loss")), "predicted_change": F.log(F.col("predicted") / F.col("__predicted"))})
    return joined.withColumns({"paired": F.col("predicted_change") - F.col("observed_change"), "absolute": F.col("predicted") - F.col("loss")}).drop("__loss", "__predicted")


def left_out_scores(predicted: DataFrame, size: str, by: tuple[str, ...] = ("law", "target")) -> DataFrame:
    """by, runs and paired RMSE of AI additions, of all and of those below and from ratio 1 on, pooled over the folds that leave their size out. ``predicted``: rows of ``predictions`` with arm, ratio and size."""
    left = predicted.where((F.col("arm") == "ai") & (F.col("fold") == F.concat(F.lit("without_"), F.col(size).cast("string"))))
    root = lambda part: F.sqrt(F.avg(F.when(part, F.col("paired") ** 2)))
    return left.groupBy(*by).agg(F.count("*").alias("runs"), root(F.lit(True)).alias("paired"), root(F.col("ratio") < 1).alias("paired_low"), root(F.col("ratio") >= 1).alias("paired_high"))


def filtering_prediction(pairs: DataFrame, law: str, p: dict[str, float]) -> DataFrame:
    """For pairs (parameters, human, added, natural_loss, filtered_loss): the observed log change by filtering and what the law predicts for leaving the added tokens out."""
    at = lambda added: law_loss(laws.LAWS[law], p, F.col("parameters"), F.col("human"), added)
    return pairs.withColumns({"observed_change": F.log(F.col("filtered_loss") / F.col("natural_loss")), "predicted_change": F.log(at(F.lit(0.0)) / at(F.col("added")))})


def group_bootstrap(errors: DataFrame, by: list[str], group: str, ours: str, theirs: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """by, groups, gap (RMSE of ``theirs`` less that of ``ours``), low, high (95 %), p_ours_lower, groups_ours_lower: control groups are resampled.

    Sums by group are formed first; a resampling sees one row per group. Each case has a generator of its own, seeded
    by its keys, so results do not depend on which cases are asked for.
    """
    ship(errors.sparkSession)
    sums = errors.groupBy(*by, group).agg(F.sum(F.col(ours) ** 2).alias("a"), F.sum(F.col(theirs) ** 2).alias("b"), F.count("*").alias("n"))

    def resampled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(group)
        a, b, n = (rows[c].to_numpy(float) for c in ("a", "b", "n"))
        key = [int.from_bytes(str(rows[c].iloc[0]).encode()[:8], "big") for c in by]
        rng, gaps = np.random.default_rng([seed, *key]), []
        for at in range(0, draws, step := max(1, 4_000_000 // len(n))):
            w = rng.multinomial(len(n), np.full(len(n), 1 / len(n)), min(step, draws - at)).astype(float)
            gaps.append(np.sqrt(w @ b / (w @ n)) - np.sqrt(w @ a / (w @ n)))
        gap = np.concatenate(gaps)
        low, high = np.percentile(gap, [2.5, 97.5])
        point = float(np.sqrt(b.sum() / n.sum()) - np.sqrt(a.sum() / n.sum()))
        return pd.DataFrame([(*(rows[c].iloc[0] for c in by), len(n), point, float(low), float(high), float((gap > 0).mean()), int((a < b).sum()))], columns=[*by, "groups", "gap", "low", "high", "p_ours_lower", "groups_ours_lower"])

    kinds = ", ".join(f"{c} {errors.schema[c].dataType.simpleString()}" for c in by)
    return sums.groupBy(*by).applyInPandas(resampled, f"{kinds}, groups int, gap double, low double, high double, p_ours_lower double, groups_ours_lower int")
