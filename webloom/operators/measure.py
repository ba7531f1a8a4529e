"""Label shares over time, cubes, survival, intervals and the drift forecast."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.hashing import splitmix
from webloom.functions.text import month_index, month_label
from webloom.session import ship

LABELS = ("Human", "Mixed", "AI")


def label_share(df: DataFrame, by: str, dump: str = "dump") -> DataFrame:
    """Documents and tokens by label, and shares of labelled tokens; rows without a label are left out first."""
    labelled = df.where("label is not null")
    part = lambda x, value: F.sum(F.when(F.col("label") == x, value).otherwise(0)).cast("long")
    counts = [f(x).alias(f"{x.lower()}_{what}") for what, f in (("documents", lambda x: part(x, F.lit(1))), ("tokens", lambda x: part(x, F.col("tokens")))) for x in LABELS]
    out = labelled.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(dump)), ";").alias("dumps"), F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens"), *counts)
    return out.withColumns({"ai_share": F.try_divide("ai_tokens", "tokens"), "ai_or_mixed_share": F.try_divide(F.col("ai_tokens") + F.col("mixed_tokens"), F.col("tokens"))})


def share_of_files(documents: DataFrame, labels: DataFrame, seed: int = 0, draws: int = 2_000, id_col: str = "id") -> DataFrame:
    """``label_share`` of each month's file, with low and high (95 %): ``documents`` (id, dump, tokens) and the sidecar of their labels, both with the places of their rows, joined by place; a file is a month, documents without a label are left out."""
    from webloom.operators.sidecars import joined

    rows = joined(documents, {"side": labels.select("file_name", "row_index", id_col, "label")}, id_col).withColumn("label", F.col("side_label"))
    rows = rows.withColumn("month", F.regexp_replace("file_name", r"\.parquet$", ""))
    shares, bounds = label_share(rows, "month"), poisson_interval(rows, "month", id_col, seed, draws)
    return shares.join(bounds, "month")


def ratio_interval(values: np.ndarray, weights: np.ndarray, seed: int, draws: int = 2_000, held: int = 4_000_000) -> tuple[float, float]:
    """95 % percentile interval of sum(values) / sum(weights) over resampled documents; about ``held`` picks are held at a time."""
    rng, ratios = np.random.default_rng(seed), []
    for at in range(0, draws, step := max(1, held // max(1, len(values)))):
        picks = rng.integers(0, len(values), (min(step, draws - at), len(values)))
        ratios.append(values[picks].sum(1) / weights[picks].sum(1))
    low, high = np.percentile(np.concatenate(ratios), [2.5, 97.5])
    return float(low), float(high)


#: P(a Poisson variable of mean 1 is at most k), for k from 0.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def poisson_weights(keys: np.ndarray, seed: int, draws: int) -> np.ndarray:
    """How often each key (unsigned 64 bits) is drawn, by key and draw: the same for a key wherever it is read."""
    salts = splitmix(splitmix(np.array([seed], np.uint64)) ^ np.arange(1, draws + 1, dtype=np.uint64))
    uniform = (splitmix(splitmix(keys)[:, None] ^ salts) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(POISSON, uniform.ravel(), side="right").reshape(uniform.shape).astype(np.float64)


def poisson_ratios(rows: DataFrame, seed: int = 0, draws: int = 2_000, held: int = 2_000_000) -> DataFrame:
    """group, q (2.5 and 97.5 % quantiles): bootstrap intervals of sum(value) / sum(weight), from rows group (string), key (long), value, weight.

    Each key gets a Poisson weight for each draw, the same wherever it is read; sums by group and draw are formed where
    the rows are read, so what is shuffled is draws by groups, never rows, whatever the size of a group.
    """
    ship(rows.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([list(s[i]) for s in sums.values()], pa.list_(pa.float64())) for i in (0, 1))], ["group", "value", "weight"])

        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, held // draws)):
                part = batch.slice(at, step)
                drawn = poisson_weights(part.column(1).to_numpy(zero_copy_only=False).view(np.uint64), seed, draws)
                value, weight = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                names = part.column(0).to_pylist()
                for name in dict.fromkeys(names):
                    here = np.array([n == name for n in names])
                    both = np.stack([value[here] @ drawn[here], weight[here] @ drawn[here]])
                    sums[name] = sums[name] + both if name in sums else both
                if len(sums) * draws > held:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    parts = rows.select("group", "key", F.col("value").cast("double"), F.col("weight").cast("double")).mapInArrow(summed, "group string, value array<double>, weight array<double>")
    by_draw = parts.select("group", F.posexplode(F.arrays_zip("value", "weight")).alias("draw", "s")).groupBy("group", "draw").agg((F.try_divide(F.sum("s.value"), F.sum("s.weight"))).alias("share"))
    return by_draw.groupBy("group").agg(F.percentile("share", F.lit([0.025, 0.975])).alias("q"))


def poisson_interval(df: DataFrame, by: str, id_col: str, seed: int = 0, draws: int = 2_000, held: int = 2_000_000) -> DataFrame:
    """by, low, high: the bootstrap interval of the AI share of tokens over groups of any size."""
    tokens = F.col("tokens").cast("double")
    rows = df.where("label is not null").select(F.col(by).cast("string").alias("group"), F.xxhash64(id_col).alias("key"), (tokens * (F.col("label") == "AI").cast("double")).alias("value"), tokens.alias("weight"))
    found = poisson_ratios(rows, seed, draws, held)
    return found.select(F.col("group").cast(df.schema[by].dataType).alias(by), F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, upto: how many rows have each value, a number, and how many of the group have that or a smaller one. Nulls are left out.

    Exact order statistics come from this without bringing a group's rows, or its distinct values, together: sums run
    over ranges of group and value.
    """
    from webloom.operators.budget import running_total

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_total(counts, value, F.col("n"), by=by, ties=(), name="upto").withColumn("upto", F.col("upto") + F.col("n"))


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per group ``rows``, the number of its rows, and the values at the named places of its sorted ones, from 0; a place may depend on ``rows``."""
    counted = value_counts(df, by, value)
    names = {c: f"__of_{c}" for c in by}
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("rows")).withColumnsRenamed(names)
    whole = counted.join(sizes, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]).drop(*names.values()) if by else counted.crossJoin(F.broadcast(sizes))  # one row
    return whole.groupBy(*by).agg(F.max("rows").alias("rows"), *[F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the exact quantiles, between two rows by interpolation."""
    at = lambda q: F.lit(q) * (F.col("rows") - 1)
    places = {f"{n}_{side}": end(at(q)) for n, q in shares.items() for side, end in (("low", F.floor), ("high", F.ceil))}
    found = order_statistics(df, by, value, places)
    return found.select(*by, *[(F.col(f"{n}_low") + (at(q) - F.floor(at(q))) * (F.col(f"{n}_high") - F.col(f"{n}_low"))).alias(n) for n, q in shares.items()])


def cube(df: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and tokens by the keys; rows without a label are left out."""
    return df.where("label is not null").groupBy(*keys).agg(F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))


def quarter_shares(df: DataFrame, category: str, quarter: str = "quarter") -> DataFrame:
    """quarter, category, documents, tokens, ai_tokens, share (percent of the quarter's tokens) and ai_share (percent within)."""
    sums = df.groupBy(quarter, category).agg(F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens"), F.sum(F.when(F.col("label") == "AI", F.col("tokens")).otherwise(0)).cast("long").alias("ai_tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(quarter))
    return sums.withColumns({"share": F.try_divide(100.0 * F.col("tokens"), whole), "ai_share": F.try_divide(100.0 * F.col("ai_tokens"), F.col("tokens"))})


def survival(df: DataFrame, stages: list[str]) -> DataFrame:
    """stage, kept, and per label the percentage that all stages up to it keep; a missing flag removes, a label without documents is null. ``kept`` counts documents without a label too."""
    alive, columns = F.lit(True), []
    for number, stage in enumerate(["sample", *stages]):
        if number:
            alive = alive & F.coalesce(F.col(stage), F.lit(False))
        columns.append(F.struct(F.lit(number).alias("number"), F.lit(stage).alias("stage"), alive.alias("alive")))
    long = df.select("label", F.explode(F.array(*columns)).alias("s")).select("label", "s.*")
    share = [F.try_divide(100.0 * F.sum(F.when(F.col("alive") & (F.col("label") == x), 1).otherwise(0)), F.sum(F.when(F.col("label") == x, 1).otherwise(0))).alias(x.lower()) for x in LABELS]
    return long.groupBy("number", "stage").agg(F.sum(F.col("alive").cast("long")).alias("kept"), *share)


def t_quantile(p: float, dof: int) -> float:
    """Quantile of Student's t, by bisection on its distribution function (a continued fraction for the incomplete beta)."""

    def below(x: float) -> float:
        z, a, b = dof / (dof + x * x), dof / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z)) if 0 < z < 1 else 0.0

        def fraction(z: float, a: float, b: float) -> float:
            tiny, c, d = 1e-300, 1.0, 1 - (a + b) * z / (a + 1)
            d = 1 / (d if abs(d) > tiny else tiny)
            out = d
            for m in range(1, 500):
                for term in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 + term * d, 1 + term / c
                    d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                    out *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            return out

        tail = front * fraction(z, a, b) / a if z < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - z, b, a) / b
        return 1 - tail / 2

    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def drift_forecast(observed: DataFrame, last_month: str) -> DataFrame:
    """month, kind, share, lo80, hi80, lo95, hi95: a random walk with drift from the last of ``observed`` (month, share) through ``last_month``.

    One row is summed from the observations, then spread over the months to come.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("at")  # a row per month: a few hundred at most
    points = observed.select(month_index(F.col("month")).alias("at"), F.col("share").cast("double").alias("share"))
    steps = points.withColumns({"gap": F.col("at") - F.lag("at").over(order), "rise": F.col("share") - F.lag("share").over(order)})
    ends = points.agg(F.min("at").alias("t0"), F.max("at").alias("t1"), F.min_by("share", "at").alias("s0"), F.max_by("share", "at").alias("s1"), F.count("*").alias("n"))
    drift = (F.col("s1") - F.col("s0")) / (F.col("t1") - F.col("t0"))
    error = (F.col("rise") - drift * F.col("gap")) / F.sqrt("gap")
    fit = steps.where("gap is not null").crossJoin(F.broadcast(ends)).groupBy("t0", "t1", "s0", "s1", "n").agg((F.sum(error * error) / (F.col("n") - 2)).alias("variance"))
    dof = observed.count() - 2
    q80, q95 = t_quantile(0.90, dof), t_quantile(0.975, dof)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    year, month = map(int, last_month.split("-"))
    ahead = fit.withColumn("at", F.explode(F.sequence(F.col("t1") + 1, F.lit(year * 12 + month - 1).cast("long")))).withColumn("h", F.col("at") - F.col("t1"))
    ahead = ahead.withColumns({"mean": F.col("s1") + drift * F.col("h"), "sd": F.sqrt(F.col("variance") * (F.col("h") + F.col("h") * F.col("h") / (F.col("t1") - F.col("t0"))))})
    bound = lambda q, sign: clip(F.col("mean") + sign * q * F.col("sd"))
    return ahead.select(month_label(F.col("at")).alias("month"), F.lit("forecast").alias("kind"), clip(F.col("mean")).alias("share"), bound(q80, -1).alias("lo80"), bound(q80, 1).alias("hi80"), bound(q95, -1).alias("lo95"), bound(q95, 1).alias("hi95"))


def forecast_table(observed: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """The observations from ``first_month`` on and the forecast fitted on them."""
    seen = observed.where(F.col("month") >= first_month).select("month", F.col("share").cast("double").alias("share"))
    none = F.lit(None).cast("double")
    return seen.select("month", F.lit("observed").alias("kind"), "share", none.alias("lo80"), none.alias("hi80"), none.alias("lo95"), none.alias("hi95")).unionByName(drift_forecast(seen, last_month))


def bits_per_byte(nats: Column, size: Column) -> Column:
    """Aggregate: nats over natural-log-2 times bytes; tokens of no bytes count on neither side. Null without bytes."""
    return F.try_divide(F.sum(F.when(size > 0, nats)), math.log(2) * F.sum(size))


def domain_scores(rows: DataFrame, by: list[str], *, nats: str = "nats", size: str = "bytes", doc: str = "doc_id") -> DataFrame:
    """by, bpb, docs, windows, bytes, nats of scored windows."""
    return rows.groupBy(*by).agg(bits_per_byte(F.col(nats), F.col(size)).alias("bpb"), F.count_distinct(doc).alias("docs"), F.count("*").alias("windows"), F.sum(size).cast("long").alias("bytes"), F.sum(F.when(F.col(size) > 0, F.col(nats))).alias("nats"))


def macro_scores(domains: DataFrame, by: str, bpb: str = "bpb") -> DataFrame:
    """by, bpb (mean over domains, each counting once), domains."""
    return domains.groupBy(by).agg(F.avg(bpb).alias("bpb"), F.count(bpb).alias("domains"))


def unit_interval(df: DataFrame, by: str, unit: str, value: Column, weight: Column, scale: float, seed: int = 0, draws: int = 2_000) -> DataFrame:
    """by, rate (scale * sum of values / sum of weights), low, high (95 %), units: units (such as prompts) are resampled whole.

    Values are summed by unit first, so all of a unit gets one weight a draw (see ``poisson_ratios``); no group of
    units comes together.
    """
    sums = df.groupBy(by, unit).agg(F.sum(value).cast("double").alias("v"), F.sum(weight).cast("double").alias("w"))
    whole = sums.groupBy(by).agg(F.try_divide(F.lit(scale) * F.sum("v"), F.sum("w")).alias("rate"), F.count("*").alias("units"))
    rows = sums.select(F.col(by).cast("string").alias("group"), F.xxhash64(unit).alias("key"), F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce("w", F.lit(0.0)).alias("weight"))
    q = poisson_ratios(rows, seed, draws)
    found = whole.join(q, F.col(by).cast("string").eqNullSafe(F.col("group")))
    return found.select(by, "rate", (F.lit(scale) * F.get("q", 0)).alias("low"), (F.lit(scale) * F.get("q", 1)).alias("high"), "units")


def labelled_only(df: DataFrame, columns: list[str], unlabelled: str = "unlabeled") -> DataFrame:
    """The rows that have a category in each of the columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c) != unlabelled))
    return df


def length_batches(df: DataFrame, length: str, size: int, ties: str) -> DataFrame:
    """``df`` and the batch of each row: ``size`` rows of neighbouring lengths, the shortest first."""
    from webloom.operators.budget import running_total

    return running_total(df, length, F.lit(1), ties=(ties,), name="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def rmse(error: Column) -> Column:
    """Null where there are no rows."""
    return F.sqrt(F.avg(error * error))


def leave_one_out_gap(df: DataFrame, target: str, group: str, ours: str, theirs: str) -> DataFrame:
    """target, group, gap: RMSE of ``ours`` minus that of ``theirs`` without the group, by totals less the group's sums."""
    sums = df.groupBy(target, group).agg(F.sum(F.col(ours) ** 2).alias("a"), F.sum(F.col(theirs) ** 2).alias("b"), F.count("*").alias("n"))
    every = Window.partitionBy(target)
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    return sums.select(target, group, (F.sqrt(F.try_divide(rest("a"), rest("n"))) - F.sqrt(F.try_divide(rest("b"), rest("n")))).alias("gap"))
