"""Work in order, range by range: the as-of merge and running totals where one value or group holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import budget, measure, relational
from webloom.operators.ranges import RANGE, in_ranges


def nearest_plainly(left, right, tolerance):
    out = []
    for name, group, value in left:
        near = [(abs(math.log(v / value)), k) for k, g, v in right if g == group and group is not None and value and value > 0 and v and v > 0 and abs(math.log(v / value)) <= tolerance]
        out += [(name, min(near)[1])] if near else []
    return sorted(out)


@pytest.mark.parametrize("distinct", [1, 3, 80])
def test_nearest_against_all_pairs(spark, distinct):
    """Nulls, negative values, ties on both sides, equal values, groups on one side only."""
    rng = random.Random(distinct)
    values = [None, -1.0, 0.0, *(round(math.exp(rng.uniform(0, 3)), rng.choice([1, 2])) for _ in range(distinct))]
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(values)) for i in range(600)]
    right = [(i, rng.choice(["a", "b", "c", None]), rng.choice(values)) for i in range(150)]
    schema = "name int, size string, v double"
    found = relational.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["size"], "v", "v", 0.1, "name")
    assert sorted((r["name"], r["match_name"]) for r in found.collect()) == nearest_plainly(left, right, 0.1)


def test_nearest_reaches_across_ranges_without_a_match(spark):
    """One right row below and one above thousands of left ones, which span all ranges."""
    left = spark.range(4_000).select(F.col("id").alias("name"), F.lit("a").alias("size"), (100 + F.col("id") / 100).alias("v"))
    right = spark.createDataFrame([(1, "a", 99.0), (2, "a", 141.0), (3, "b", 120.0)], "name long, size string, v double")
    found = relational.nearest(left, right, ["size"], "v", "v", 10.0, "name").collect()
    middle = math.sqrt(99.0 * 141.0)
    assert len(found) == 4_000 and all(r["match_name"] == (1 if r["v"] < middle else 2) for r in found)


def test_nearest_without_rows(spark):
    schema = "name int, size string, v double"
    some, none = spark.createDataFrame([(1, "a", 2.0)], schema), spark.createDataFrame([], schema)
    assert relational.nearest(some, none, ["size"], "v", "v", 1.0, "name").collect() == []
    assert relational.nearest(none, some, ["size"], "v", "v", 1.0, "name").collect() == []


def test_one_value_spans_all_ranges(spark):
    rows = spark.range(40_000).select("id", F.lit(7).alias("length"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would take so few rows together
    try:
        sizes = [r["count"] for r in in_ranges(rows.repartition(8), "length", "id").groupBy(RANGE).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_a_hot_value(spark, descending):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 5, 5, None, 1, 9]), rng.choice(["x", "x", "x", "y"]), rng.choice([None, 1, 2, 3])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, v int, g string, w long")
    order = lambda r: (r[1] is not None, r[1] or 0, r[0])
    for by in (None, ["g"]):
        totals, want = {}, {}
        for r in sorted(rows, key=order, reverse=descending):
            key = r[2] if by else ""
            want[r[0]] = totals.get(key, 0)
            totals[key] = want[r[0]] + (r[3] or 0)
        got = budget.running_total(df, "v", F.col("w"), by=by, descending=descending)
        assert {r["id"]: r["before"] for r in got.collect()} == want


def test_batches_of_equal_lengths(spark):
    rows = spark.range(1_000).select("id", F.lit(3).alias("tokens"))
    got = measure.length_batches(rows, "tokens", 16, "id").collect()
    assert all(r["batch"] == r["id"] // 16 for r in got)


def test_hot_keys_are_joined_like_others(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None, *range(3, 2_000)]), i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k int, i int")
    small = df.where("k % 3 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    got = sorted(map(tuple, relational.join_by_size(df, small, "k", "n", 6_000).select("k", "i", "most").collect()))
    assert got == sorted(map(tuple, df.join(small, "k").select("k", "i", "most").collect())) and len(got) > 3_000
