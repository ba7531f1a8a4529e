import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.functions import fitting, laws
from webloom.operators import fits, relational, runs
from webloom.plans import fitted
from webloom.plans.studies import C4, OTHER

FOLDER = "/root/testdata/sf0.01"


def cohort(law, p, noise=0.0):
    rng = np.random.default_rng(0)
    n, h, r = (x.ravel() for x in np.meshgrid([1e8, 2e8, 5e8, 1e9], [2e9, 8e9, 3e10], [0.0, 0.25, 0.5, 1.0, 2.0, 4.0], indexing="ij"))
    loss = laws.LAWS[law](p, laws.Coordinates.of(n, h, h * r)) * np.exp(noise * rng.normal(size=len(n)))
    names = list(range(len(n)))
    return fitting.Cohort.of(n, h, h * r, loss, names, [i - i % 6 for i in names])


@pytest.mark.parametrize("law", laws.LAWS)
def test_laws_of_arrays_are_those_of_columns(spark, law):
    rows = [(1e8, 2e9, 0.0), (3e8, 5e9, 2e9), (2e9, 1e10, 8e10)]
    df = spark.createDataFrame(rows, "p double, h double, a double")
    column = [r[0] for r in df.select(laws.LAWS[law](OTHER, laws.Coordinates.of(F.col("p"), F.col("h"), F.col("a")))).collect()]
    assert np.allclose(column, laws.LAWS[law](OTHER, laws.Coordinates.of(*map(np.array, zip(*rows, strict=True)))), rtol=1e-12)


@pytest.mark.parametrize("law", fitting.COEFFICIENTS)
def test_derivatives_are_exact(law):
    c, names = cohort(law, OTHER), fitting.COEFFICIENTS[law]
    theta = np.array([OTHER[n] for n in names])
    exact = fitting.jacobian(law, names, theta, c)
    for i in range(len(names)):
        step = np.zeros(len(names))
        step[i] = 1e-6
        near = (fitting.residuals(law, names, theta + step, c) - fitting.residuals(law, names, theta - step, c)) / 2e-6
        assert np.allclose(near, exact[:, i], atol=1e-6)


def test_fits_find_the_law_again():
    p, found = fitting.fit("chinchilla", cohort("chinchilla", C4), n_starts=4)
    assert found.cost < 1e-10 and all(abs(p[k] - C4[k]) < 1e-3 for k in p)
    p, found = fitting.fit("effective_data", cohort("effective_data", C4, 0.001), n_starts=8)
    c = cohort("effective_data", C4, 0.001)
    assert found.cost <= fitting.cost(fitting.residuals("effective_data", tuple(p), np.array([C4[k] for k in p]), c)) + 1e-9
    low, high = fitting.bounds("effective_data", c)[1][:, :2].T
    assert (np.array(found.theta) >= low).all() and (np.array(found.theta) <= high).all()
    assert fitting.cost(np.array([0.05, -0.3])) == pytest.approx(0.05**2 / 2 + 0.1 * (0.3 - 0.05))
    with pytest.raises(ValueError):
        fitting.Cohort.of([1e8], [1e9], [0], [3.0], ["a"], ["b"])
    with pytest.raises(ValueError):
        fitting.Cohort.of([1e8], [0], [0], [3.0], ["a"], ["a"])


def test_the_bank_does_not_depend_on_how_starts_are_dealt(spark):
    rows = runs.folds(fitted._with_losses(spark, FOLDER), "size").where("fold in ('all', 'without_10')")
    a, b = ({(r["law"], r["fold"]): (r["cost"], tuple(r["theta"])) for r in fits.fit_bank(rows, ["chinchilla"], n_starts=4, chunk=k).collect()} for k in (1, 5))
    assert a == b and len(a) == 2


def test_many_runs_are_fitted_by_passes(spark, monkeypatch):
    """No task gets a case's runs, and the ends are those of fits within tasks."""
    n = np.repeat([1e8, 3e8, 9e8], 12)
    k = np.arange(36)
    rows = pd.DataFrame({"target": "x", "fold": "all", "name": k, "control": k - k % 6, "parameters": n, "human": n * 20 * (1 + k // 6 % 2), "added": n * 10 * (k % 6)})
    rows["loss"] = np.exp(fitting.log_losses("effective_data", tuple(C4), np.array(list(C4.values())), laws.Coordinates.of(*(rows[c].to_numpy(float) for c in ("parameters", "human", "added"))), False)[0]) * (1 + 0.001 * np.sin(k))
    df = spark.createDataFrame(rows)
    whole = {r["law"]: r["cost"] for r in fits.fit_bank(df, ["chinchilla", "effective_data"], n_starts=1).collect()}
    monkeypatch.setattr(fits, "_reached_in_tasks", None)
    by_passes = {r["law"]: r["cost"] for r in fits.fit_bank(df, ["chinchilla", "effective_data"], n_starts=1, local_runs=35).collect()}
    assert by_passes == pytest.approx(whole, rel=1e-6)


def test_missing_losses_are_errors(spark):
    with pytest.raises(Exception, match="no loss"):
        runs.with_losses(fitted.study(spark, FOLDER), fitted.losses(spark, FOLDER).where("name <> '0-0-0'"), ["human"]).collect()
    with pytest.raises(ValueError):
        runs.with_losses(fitted.study(spark, FOLDER), fitted.losses(spark, FOLDER).unionByName(fitted.losses(spark, FOLDER)), ["human"])
    assert runs.uncovered(fitted.study(spark, FOLDER), fitted.losses(spark, FOLDER).where("name <> '0-0-0'"), "human").count() == 1


def test_flip_is_where_the_median_turns(spark):
    found = fitted._contrasts(spark, FOLDER).withColumn("study", F.lit("x"))
    q = runs.median_flip(found, "study").first()["share"]
    at = {r["share"]: r["median_change"] for r in runs.masking_at(found, (q - 1e-6, q + 1e-6)).collect()}
    assert len(at) == 2 and at[min(at)] > 0 > at[max(at)]


def test_bootstrap_of_groups(spark):
    rows = [("t", g, 0.1 + 0.01 * g + 0.001 * i, 0.2) for g in range(12) for i in range(4)]
    got = fits.group_bootstrap(spark.createDataFrame(rows, "target string, grp int, ours double, theirs double"), ["target"], "grp", "ours", "theirs", draws=500).first()
    assert got["groups"] == 12 and got["low"] <= got["gap"] <= got["high"] and got["p_ours_lower"] == 1.0
    assert got["gap"] == pytest.approx(0.2 - math.sqrt(np.mean([r[2] ** 2 for r in rows])))


def test_huber_of_columns_is_that_of_arrays(spark):
    values = [-0.3, -0.1, 0.0, 0.05, 2.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(F.sum(laws.huber(F.col("v")))).first()[0]
    assert got == pytest.approx(fitting.cost(np.array(values)))


def test_only_allowed_values(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r[0] for r in df.select(relational.one_of(F.col("v"), ("a", "b"))).collect()] == ["a", None]
    with pytest.raises(Exception, match="not allowed"):
        df.select(relational.one_of(F.col("v"), ("b",))).collect()


def test_nearest_partner_has_to_gain(spark):
    left = spark.createDataFrame([(1, "s", 1.0), (2, "s", 2.0)], "name int, size string, amount double")
    right = spark.createDataFrame([(7, "s", 1.05, 0.5), (8, "s", 2.05, 0.01)], "name int, size string, amount double, gain double")
    found = relational.nearest(left, right, ["size"], "amount", "amount", 0.15, "name", "gain", 0.1)
    assert [(r["name"], r["match_name"]) for r in found.collect()] == [(1, 7)]
