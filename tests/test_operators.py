import random

import pytest
from pyspark.sql import functions as F

from webloom.functions.hashing import rank_hash
from webloom.operators import budget, filters, mixture, near_duplicates, pools, relational
from webloom.sources import tables


def ranked(spark, weights):
    return spark.createDataFrame(list(enumerate(weights)), "id long, tokens long").withColumn("h", rank_hash("t", "id"))


@pytest.mark.parametrize("target", [0, 1, 35, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_budget_prefix_against_a_loop(spark, target, descending):
    random.seed(target)
    df = ranked(spark, [random.choice([0, 5, 7, None]) for _ in range(60)]).repartition(7)
    total, expected = 0, []
    for r in sorted(df.collect(), key=lambda r: (r["h"], r["id"]), reverse=descending):
        if total < target:
            expected.append(r["id"])
        total += r["tokens"] or 0
    assert sorted(r["id"] for r in budget.fill_budget(df, "h", "tokens", target, descending=descending).collect()) == sorted(expected)


def test_trimmed_budget_is_exact_and_short_data_an_error(spark):
    df = ranked(spark, [10] * 20)
    assert budget.fill_budget(df, "h", "tokens", 55, trim=True).agg(F.sum("tokens")).first()[0] == 55
    with pytest.raises(ValueError):
        budget.require_budget(df, "tokens", 201)


def test_threshold_keeps_ties(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "b", 10), (4, "c", 10)], "id long, h string, tokens long").withColumn("g", F.lit(1))
    assert sorted(r["id"] for r in budget.fill_budget(df, "h", "tokens", 15, by=["g"], with_ties=True).collect()) == [1, 2, 3]
    assert budget.hash_threshold(df, "h", "tokens", 0, ["g"]).count() == 0


def test_equal_budgets_and_quotas(spark):
    names = spark.createDataFrame([("b",), ("a",), ("c",)], ["name"])
    assert {r["name"]: r["budget"] for r in budget.equal_budgets(names, 10).collect()} == {"a": 4, "b": 3, "c": 3}
    totals = spark.createDataFrame([("a", 300, 10_000), ("b", 100, 20)], "dump string, ai_tokens long, available long")
    assert {r["dump"]: r["quota"] for r in budget.quotas(totals, 400, by=["dump"]).collect()} == {"a": 300, "b": 20}
    with pytest.raises(ValueError):
        budget.quotas(totals.withColumn("ai_tokens", F.lit(0)), 400, by=["dump"])


def test_strict_sample_needs_enough(spark):
    df = ranked(spark, [1] * 5).withColumn("m", F.col("id") % 2)
    assert budget.bottom_k_by(df, ["m"], "h", 2, strict=True).count() == 4
    with pytest.raises(ValueError):
        budget.bottom_k_by(df, ["m"], "h", 3, strict=True)


def test_pool_routing(spark):
    rows = [("a", "AI", "editlens_ai"), ("b", None, "editlens_ai"), ("c", None, "natural"), ("d", "Mixed", "natural"), ("e", "AI", "natural"), ("f", "Mixed", "editlens_human")]
    out = spark.createDataFrame(rows, "id string, label string, selection string").withColumn("pool", pools.pool_of(F.col("label"), F.col("selection")))
    assert {r["id"]: r["pool"] for r in out.collect()} == {"a": "ai", "b": "_unlabeled", "c": "_unlabeled_natural", "d": None, "e": "natural", "f": "mixed"}


def test_relational_checks(spark):
    runs = spark.createDataFrame([("a", 1, "control"), ("b", 1, "ai"), ("c", 2, "ai")], "name string, group int, arm string")
    with pytest.raises(ValueError):
        relational.with_control(runs)
    assert relational.with_control(runs.where("group = 1")).count() == 2
    with pytest.raises(ValueError):
        relational.conform(runs, "name string, other int")
    with pytest.raises(ValueError):
        relational.keyed_sidecar(runs.withColumnRenamed("name", "id"), spark.createDataFrame([("a",), ("a",)], ["id"]))
    with pytest.raises(Exception, match="two texts"):
        relational.agreeing(spark.createDataFrame([(1, "x"), (1, "y")], ["id", "text"]), "id", "text").collect()


def test_near_duplicates_form_chains(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"])
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, "other text entirely " * 9), (5, ""), (6, None), (7, a)], "id long, text string")
    out = {r["id"]: r["root"] for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 7: 1}
    assert sorted(r["id"] for r in near_duplicates.drop_near_duplicates(df).collect()) == [1, 4, 5, 6]


def test_filter_audit_flags_are_cumulative(spark):
    kinds = "red blue green brown white black gray pink".split()
    good = "\n".join(f"This {k} sentence {i} has {k}est words, of {k} kinds to be {k}ish with {k}er {i * 7} others." for i, k in enumerate(kinds))
    df = spark.createDataFrame([(1, good, "en"), (2, good, "de"), (3, "Too short.", "en"), (4, None, "en"), (5, "same line of text here\n" * 40, "en")], "id long, text string, lang string")
    out = {r["id"]: r for r in filters.audit(df).collect()}
    assert {i: r["removed_at"] for i, r in out.items()} == {1: None, 2: "language", 3: "gopher_repetition", 4: "language", 5: "gopher_repetition"}
    assert not out[5]["fineweb_quality"] and out[1]["fineweb_quality"]


def test_plans_hold_exact_budgets_and_share_human_documents(spark):
    human, ai = (spark.createDataFrame([(i, 30 + i % 40) for i in range(200)], "id long, tokens long").withColumn("h", F.substring(rank_hash(k, "id"), 1, 16)) for k in ("human", "ai"))
    plans = {arm: mixture.plan(mixture.Run(arm, 4, steps), human, ai, 500, 64) for arm, steps in (("control", 4), ("ai", 6), ("human", 6), ("repeat", 9))}
    for arm, steps in (("control", 4), ("ai", 6), ("human", 6), ("repeat", 9)):
        assert plans[arm].agg(F.sum("tokens")).first()[0] == steps * 500
    control = {r["id"] for r in plans["control"].collect()}
    assert control == {r["id"] for r in plans["ai"].where("pool = 'human'").collect()} == {r["id"] for r in plans["repeat"].collect()}
    assert control < {r["id"] for r in plans["human"].collect()}
    with pytest.raises(ValueError):
        mixture.plan(mixture.Run("control", 10_000, 10_000), human, ai, 500, 64)
    with pytest.raises(ValueError):
        mixture.Run("ai", 4, 4)


@pytest.mark.parametrize("keep_rest", [False, True])
def test_best_fit_packing_against_a_search(keep_rest):
    random.seed(3)
    pieces = [(i, random.randint(1, 40)) for i in range(300)]
    rows = list(mixture.best_fit(pieces, 50, 20, keep_rest))
    assert all(sum(p[2] for p in r) == 50 for r in rows)
    waiting, source, expected = [], iter(pieces), []
    while True:
        out, room = [], 50
        while room:
            while len(waiting) < 20 and (p := next(source, None)) is not None:
                waiting.append((p[0], 0, p[1]))
            if not waiting:
                break
            fits = [p for p in waiting if p[2] <= room]
            if fits:
                p = max(fits, key=lambda p: p[2])
                waiting.remove(p)
            else:
                q = min(waiting, key=lambda p: p[2])
                waiting.remove(q)
                if keep_rest:
                    waiting.append((q[0], q[1] + room, q[2] - room))
                p = (q[0], q[1], room)
            out.append(p)
            room -= p[2]
        if room:
            break
        expected.append(out)
    assert rows == expected


def test_job_packing():
    assert list(mixture.pack_jobs([4, 4, 4, 9, 1, 1], 10, 3)) == [0, 0, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        list(mixture.pack_jobs([11], 10, 3))


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float("nan") if i == 2 else i / 2, [i, i + 1]) for i in range(50)], "id long, x double, a array<int>")
    tables.write_table(df, str(tmp_path / "t"), order=["id"], rows_per_file=7)
    back = tables.ordered_scan(spark, str(tmp_path / "t"))
    assert [r["id"] for r in back.orderBy("file_name", "row_index").collect()] == list(range(50))
    assert tables.blocks(back, 5).agg(F.sum("rows")).first()[0] == 50
    with pytest.raises(Exception, match="exist"):
        tables.write_table(df, str(tmp_path / "t"))
    assert tables.csv_cells(df).where("id = 1").first()["a"] == "1;2"
    assert '"x":null' in tables.json_rows(df.where("id = 2")).first()["json"]


def test_page_text():
    assert tables.page_text("<html><head><title>x</title></head><body><nav>menu</nav><p>One &amp; two</p><script>no()</script><div>three<br>four</div></body></html>") == "One & two\nthree\nfour"
    assert tables.page_text(None) is None


def test_file_choice():
    paths = [f"p{i}" for i in range(20)]
    chosen = tables.choose_files(paths, 5, "k")
    assert len(chosen) == 5 and chosen == [p for p in paths if p in set(chosen)] and tables.choose_files(paths, None, "k") == paths
    with pytest.raises(ValueError):
        tables.choose_files(paths, 21, "k")
