import numpy as np
from pyspark.sql import functions as F

from webloom.functions import hashing, laws, pii, text
from webloom.operators import measure


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_keyed_hash_known_answer(spark):
    assert hashing.blake_hash("doc", "k") == 0xA2344CB14B4FFD8D
    assert one(spark, hashing.keyed_hash("k", "v", spark), v="doc") == "a2344cb14b4ffd8d"
    assert int(one(spark, hashing.unsigned(F.lit("ffffffffffffffff")), v=1)) == 2**64 - 1


def test_splitmix_wraps_around():
    assert hashing.splitmix(np.array([0, 1], np.uint64)).tolist() == [0xE220A8397B1DCDAF, 0x910A2DEC89025CC1]


def test_training_order_depends_on_seed_and_epoch(spark):
    keys = {one(spark, hashing.training_order("v", s, e, spark), v="00ff00ff00ff00ff") for s in (1, 2) for e in (0, 1)}
    assert len(keys) == 4


def test_pii_rules():
    assert pii.anonymise("a@b.com x c.d@e.org 8.8.8.8 10.0.0.1 A@B.COM") == ("email@example.com x firstname.lastname@example.org 22.214.171.124 10.0.0.1 A@B.COM", 2, 1)
    assert pii.anonymise("08.8.8.8 ")[2] == 0
    assert pii.anonymise("a@b.c a@b.c a@b.c")[0] == "email@example.com firstname.lastname@example.org email@example.com"


def test_conditional_anonymising_recounts_only_changed_rows(spark):
    rows = [(1, "mail x@y.com now", 99, True), (2, "clean words here", 99, True), (3, "mail x@y.com now", 99, False), (4, None, 99, True)]
    out = {r["id"]: r for r in pii.anonymise_rows(spark.createDataFrame(rows, "id int, text string, token_count long, need boolean"), F.col("need")).collect()}
    assert [out[i]["token_count"] for i in (1, 2, 3, 4)] == [3, 99, 99, 99]
    assert out[1]["text"] == "mail email@example.com now" and out[3]["text"] == "mail x@y.com now" and out[4]["text"] is None


def test_words_and_phrases(spark):
    assert one(spark, text.letter_words(F.col("t")), t="It's a well-known fact, isn't it?") == 6
    assert one(spark, text.phrase_hits(F.col("t")), t="Delve into a TAPESTRY; it's important to note. Not just that.") == 4
    assert one(spark, text.white_words(F.col("t")), t="  a  b ") == 2


def test_cleaning(spark):
    assert one(spark, text.cleaned_text(F.col("t")), t="plan</think> **Sure**, I can\n\nThe  Text\n here") == "the text here"
    assert one(spark, text.cleaned_text(F.col("t")), t="Sure thing") == "sure thing"


def test_windows(spark):
    tokens = list(range(100))
    assert [w[0] for w in one(spark, text.picked_windows(F.col("t"), 10, 3), t=tokens)] == [0, 40, 90]
    assert one(spark, text.picked_windows(F.col("t"), 200, 3), t=tokens) == [tokens]
    assert [len(w) for w in one(spark, text.scored_windows(F.col("t"), 4), t=list(range(10)))] == [5, 5, 2]
    assert one(spark, text.scored_windows(F.col("t"), 4), t=[1]) == []


def test_paths_and_months(spark):
    assert one(spark, text.crawl_path(F.col("p")), p="s3://x/crawl-data/CC/a.warc") == "crawl-data/CC/a.warc"
    assert one(spark, text.crawl_path(F.col("p")), p="x/y") == "x/y"
    assert one(spark, text.month_label(text.month_index(F.col("m"))), m="2023-12") == "2023-12"


def test_t_quantile():
    assert abs(measure.t_quantile(0.975, 40) - 2.0210753903062737) < 1e-9
    assert abs(measure.t_quantile(0.9, 40) - 1.303077052637167) < 1e-9


def test_forecast_of_a_straight_line(spark):
    seen = spark.createDataFrame([("2023-01", 0.1), ("2023-02", 0.2), ("2023-04", 0.4), ("2023-05", 0.5)], ["month", "share"])
    first = measure.drift_forecast(seen, "2023-06").first()
    assert first["month"] == "2023-06" and all(abs(first[c] - 0.6) < 1e-9 for c in ("share", "lo95", "hi95"))


def test_survival_counts_missing_flags_as_removed(spark):
    rows = [("AI", True, True), ("AI", True, None), ("Human", False, True), (None, True, True)]
    out = {r["stage"]: r for r in measure.survival(spark.createDataFrame(rows, "label string, a boolean, b boolean"), ["a", "b"]).collect()}
    assert [out[s]["kept"] for s in ("sample", "a", "b")] == [4, 3, 2]
    assert out["b"]["ai"] == 50 and out["b"]["human"] == 0 and out["b"]["mixed"] is None


def test_law_nesting(spark):
    p = {"logE": -0.6, "logA": -1.0, "alpha": 0.3, "logB": -0.9, "beta": 0.2, "logeta": 0.0, "gamma": 0.0}
    x = laws.Coordinates(*[F.col(c) for c in "ndrt"])
    row = spark.createDataFrame([(2.0, 3.0, 0.7, 1.1)], list("ndrt")).select(laws.effective_data_law(p, x, credit="linear").alias("a"), laws.chinchilla(p, x).alias("b")).first()
    assert abs(row["a"] - row["b"]) < 1e-12


def test_equations_solve_the_law(spark):
    import math

    from webloom.functions import solve
    from webloom.plans.studies import C4

    law, n, h = laws.effective_data_law, F.col("n"), F.col("h")
    df = spark.createDataFrame([(1e8, 2e9), (7e8, 9e10)], ["n", "h"])
    cost = solve.cost_of_not_filtering(law, C4, n, h, F.lit(0.2))
    ratio = solve.optimal_ratio(law, C4, n, h)
    at = lambda r: solve.loss(law, C4, n, h, h * r)
    rows = df.select(cost.alias("cost"), (solve.loss(law, C4, n, 0.8 * h * cost, 0.2 * h * cost) - solve.loss(law, C4, n, h, F.lit(0.0))).alias("gap"), at(ratio).alias("best"), F.least(*[at(F.lit(x)) for x in (0.0, 0.01, 0.1, 0.2, 0.3, 0.4, 0.6, 1.0, 3.0)]).alias("tried"), solve.equivalent_tokens(law, C4, n, solve.loss(law, C4, n, 0.75 * h, 0.25 * h), 0.25, 5.0, 400.0).alias("same"), "h").collect()
    for r in rows:
        assert 1 < r["cost"] < 10 and abs(r["gap"]) < 1e-9 and r["best"] <= r["tried"] + 1e-12
        assert r["same"]["status"] == "ok" and math.isclose(r["same"]["tokens"], r["h"], rel_tol=1e-6)
    assert df.select(solve.critical_share(F.lit(0.3), F.lit(-0.1)).alias("q")).first()["q"] == 0.3 / 0.4


def test_equations_are_not_solved_inside_expressions(spark):
    """A row's grids are evaluated once, over arrays; folds in expressions evaluated them again wherever they were named."""
    from webloom.functions import laws, solve
    from webloom.plans.studies import C4

    law, n, h = laws.effective_data_law, F.col("n"), F.col("h")
    df = spark.createDataFrame([(1e8, 2e9), (3e8, 6e9)], "n double, h double")
    same = solve.equivalent_tokens(law, C4, n, solve.loss(law, C4, n, h, F.lit(0.0)), 0.0, 5.0, 400.0)
    found = df.select("h", same.alias("same"), solve.optimal_ratio(law, C4, n, h).alias("ratio"))
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert r["same"]["status"] == "ok" and abs(r["same"]["tokens"] / r["h"] - 1) < 1e-9 and 0 <= r["ratio"] <= 64
