"""Equations over laws, solved over arrays of rows: grids, bisection and golden search in a fixed number of steps.

Every place of a grid is evaluated once a row, for some hundred rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from webloom.functions.laws import Coefficients, Coordinates
from webloom.session import ship

Law = Callable[[Coefficients, Coordinates], Column]
#: Rows whose grids are held at once.
ROWS = 64


def loss(law: Law, p: Coefficients, parameters: Column, human: Column, added: Column) -> Column:
    return law(p, Coordinates.of(parameters, human, added))


def _by_rows(solve: Callable[..., tuple[np.ndarray, ...]], kind: str, *columns: Column) -> Column:
    """``solve`` over the columns' values, arrays of up to ``ROWS`` by 1, as a column of ``kind``: a number, or a struct of what it returns."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf(kind)
    def solved(values: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in values:
            arrays = [v.to_numpy(float)[:, None] for v in batch]
            with np.errstate(all="ignore"):
                parts = [solve(*(v[i : i + ROWS] for v in arrays)) for i in range(0, len(arrays[0]), ROWS)]
            found = [np.concatenate([np.ravel(p[k]) for p in parts]) for k in range(len(parts[0]))] if parts else []
            yield pd.DataFrame(dict(zip(("tokens", "status"), found, strict=True))) if kind != "double" else pd.Series(found[0] if found else [], dtype=float)

    return solved(*[c.cast("double") for c in columns])


def bisect(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, steps: int = 80) -> np.ndarray:
    """A place between ``low`` and ``high`` where ``f`` changes sign; it has to have other signs at the two."""
    for _ in range(steps):
        middle = (low + high) / 2
        left = np.sign(f(low)) * np.sign(f(middle)) <= 0
        low, high = np.where(left, low, middle), np.where(left, middle, high)
    return (low + high) / 2


def least_at(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, steps: int = 60) -> np.ndarray:
    """Where ``f``, of one minimum in between, is least, by golden-section search."""
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = f(a) <= f(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def cost_of_not_filtering(law: Law, p: Coefficients, parameters: Column, human: Column, share: Column, least: float = 0.05, most: float = 200.0, points: int = 400) -> Column:
    """Tokens that a mix of this AI share needs for the loss of ``human`` tokens alone, as a multiple of these; infinite if no multiple up to ``most`` does.

    The first place of a logarithmic grid that reaches the loss is refined by bisection.
    """
    low, step = math.log(least), math.log(most / least) / (points - 1)

    def solved(n, h, s):
        goal = loss(law, p, n, h, 0.0 * h)
        over = lambda z: loss(law, p, n, (1 - s) * h * np.exp(z), s * h * np.exp(z)) - goal
        grid = low + np.arange(points) * step
        reached = over(grid[None]) <= 0
        first = grid[reached.argmax(axis=1)][:, None]
        fine = np.where(first <= low, least, np.exp(bisect(over, first - step, first)))
        return (np.where(reached.any(axis=1)[:, None], fine, np.inf),)

    return _by_rows(solved, "double", parameters, human, share)


def token_value(law: Law, p: Coefficients, parameters: Column, human: Column, added: Column) -> Column:
    """The change in loss that the added tokens bring, as a share of what as many human tokens would bring: (with - base) / (human - base)."""
    base = loss(law, p, parameters, human, F.lit(0.0))
    return (loss(law, p, parameters, human, added) - base) / (loss(law, p, parameters, human + added, F.lit(0.0)) - base)


def optimal_ratio(law: Law, p: Coefficients, parameters: Column, human: Column, most: float = 64.0, points: int = 700) -> Column:
    """The added ratio of least loss between 0 and ``most``: the best of 0 and a logarithmic grid, refined between its neighbours."""
    step = math.log(most / 1e-3) / (points - 1)

    def solved(n, h):
        at = lambda r: loss(law, p, n, h, h * r)
        grid = np.concatenate([[0.0], 1e-3 * np.exp(np.arange(points) * step)])
        values = at(grid[None])
        best = grid[np.where(np.isnan(values), np.inf, values).argmin(axis=1)][:, None]
        low, high = np.where(best <= 1e-3, 0.0, best * math.exp(-step)), np.where(best == 0, 1e-3, np.minimum(most, best * math.exp(step)))
        fine = least_at(at, low, high)
        return (np.where(at(fine) <= at(best), fine, best),)

    return _by_rows(solved, "double", parameters, human)


def equivalent_tokens(law: Law, p: Coefficients, parameters: Column, goal: Column, share: float, low_tpp: float, high_tpp: float, points: int = 1024) -> Column:
    """struct<tokens, status>: the tokens of a mix of this AI share that reach the loss ``goal``, searched between two human budgets per parameter.

    status is ok, multiple_crossings, below_range (the loss is lower than any there) or above_range.
    """
    step = math.log(high_tpp / low_tpp) / points

    def solved(n, goal):
        over = lambda z: loss(law, p, n, (1 - share) * np.exp(z), share * np.exp(z)) - goal
        grid = np.log(n * low_tpp / (1 - share)) + np.arange(points + 1) * step
        values = over(grid)
        here, after = values[:, :-1], values[:, 1:]
        crossed = ((here > 0) & (after <= 0)) | ((here < 0) & (after >= 0))
        times = crossed.sum(axis=1)
        first = np.take_along_axis(grid, crossed.argmax(axis=1)[:, None], axis=1)
        tokens = np.exp(bisect(over, first, first + step))[:, 0]
        status = np.select([times > 1, times == 1, values.min(axis=1) > 0], ["multiple_crossings", "ok", "below_range"], "above_range").astype(object)
        return np.where(times == 1, tokens, None), status

    return _by_rows(solved, "tokens double, status string", parameters, goal)


def compute_equivalent_gain(law: Law, p: Coefficients, parameters: Column, goal: Column, tokens: Column, share: float, low_tpp: float, high_tpp: float, points: int = 1024) -> Column:
    """struct<ceg, status>: the reference mix's tokens that reach the loss ``goal``, per token that the run took."""
    same = equivalent_tokens(law, p, parameters, goal, share, low_tpp, high_tpp, points)
    return F.struct((same["tokens"] / tokens).alias("ceg"), same["status"].alias("status"))


def critical_share(human_change: Column, ai_change: Column) -> Column:
    """Share of AI text in an evaluation at which harm on human text and gain on AI text cancel; null unless there are both."""
    return F.when((human_change > 0) & (ai_change < 0), human_change / (human_change - ai_change))
