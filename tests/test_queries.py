"""Every query runs on the smallest tables; those with an SQL twin give its rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(([cell(r[i]) for i in order] for r in values), key=repr)


def splits_in_lambdas(plan: str) -> list[str]:
    """Lambdas of a plan that split a column: Spark would do it once for every element."""
    out = []
    for start in re.finditer(r"lambdafunction\(", plan):
        depth, at = 1, start.end()
        while depth and at < len(plan):
            depth += {"(": 1, ")": -1}.get(plan[at], 0)
            at += 1
        out += re.findall(r"split\(\w+#\d+", plan[start.end() : at])
    return out


def test_a_split_in_a_lambda_is_seen(spark):
    words = F.split(F.col("text"), " ")
    df = spark.createDataFrame([("a b",)], ["text"])
    plan = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString()
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.slice(w, i + 1, F.lit(1)))
    assert splits_in_lambdas(plan(each(words))) and not splits_in_lambdas(plan(text.bound(words, each)))


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    values = found.collect()
    assert not splits_in_lambdas(found._jdf.queryExecution().optimizedPlan().toString())
    if name in catalog.ORACLES:
        twin = duck.sql(catalog.ORACLES[name])
        assert sorted(found.columns) == sorted(twin.columns)
        assert rows(found.columns, values) == rows(twin.columns, twin.fetchall())
    else:
        assert values


@pytest.mark.parametrize("name", ["pool_statistics_with_duplicates", "window_probabilities"])
def test_results_do_not_depend_on_how_a_table_is_split(spark, tmp_path, name):
    """Lines with one number, and sums of doubles, in the order of the table, though several tasks read it."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for part in range(4):
        con.execute(f"COPY (SELECT * FROM (SELECT *, row_number() OVER () AS n FROM '/root/testdata/sf0.01/lineitem.parquet') WHERE n % 4 = {part}) TO '{tmp_path}/lineitem.parquet/part-{part}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 20)
    try:
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(con.execute(catalog.ORACLES[name]).fetchall(), key=repr)
