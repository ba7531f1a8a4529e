"""Reading parts of tables: row groups from footers, and ranges of a token store by its index."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawls, measure, pools, store
from webloom.sources import row_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("groups") / "dump")
    rows = spark.range(1_000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"), (F.col("id") % 4).alias("kind"), F.array(F.col("id")).alias("list"))
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").write.option("parquet.block.row.count.limit", 50).parquet(path)
    return path


def test_footers_list_all_row_groups(spark, folder):
    groups = row_groups.row_groups(spark, {"a": folder, "b": folder}).collect()
    assert {r["dump"] for r in groups} == {"a", "b"} and sum(r["rows"] for r in groups) == 2_000
    assert len(groups) >= 2 * 20 and all(r["rows"] <= 50 and r["bytes"] > 0 for r in groups)
    for name in {r["file_path"] for r in groups}:
        own = sorted((r["block"], r["first_row"], r["rows"]) for r in groups if r["file_path"] == name and r["dump"] == "a")
        assert [b for b, _, _ in own] == list(range(len(own))) and all(x[1] + x[2] == y[1] for x, y in zip(own, own[1:], strict=False))
    with pytest.raises(FileNotFoundError):
        row_groups.row_groups(spark, {})


def test_chosen_groups_are_read_with_their_columns(spark, folder):
    groups = row_groups.row_groups(spark, {"a": folder})
    read = spark.sparkContext.accumulator(0)
    some = groups.where("block = 1")
    out = row_groups.read_groups(some, "list array<bigint>, id bigint", blocks_read=read)
    assert out.columns == ["list", "id", "row_index", "dump", "file_name", "block"]
    rows = out.collect()
    n = some.count()
    assert read.value == n and len(rows) == some.agg(F.sum("rows")).first()[0] and all(r["list"] == [r["id"]] for r in rows)
    starts = {(r["file_name"], r["first_row"]) for r in some.collect()}
    assert {(r["file_name"], min(x["row_index"] for x in rows if x["file_name"] == r["file_name"])) for r in rows} == starts


@pytest.mark.parametrize("needed", [0, 1, 60, 130, 10_000])
def test_blocks_are_read_until_enough_and_no_further(spark, folder, needed):
    groups = row_groups.row_groups(spark, {"a": folder})
    read = spark.sparkContext.accumulator(0)
    rows = crawls.row_groups_until_enough(groups, 5, "id bigint, kind bigint", F.col("kind") == 1, "kind bigint", needed, blocks_read=read).collect()
    order = [tuple(r) for r in groups.withColumn("h", crawls.block_hash(5)).orderBy("h").select("file_name", "block", "first_row", "rows").collect()]
    place = {(r["file_name"], r["block"]) for r in rows}
    found, want = 0, set()
    every = {(r["file_name"], r["block"]): r["n"] for r in row_groups.read_groups(groups, "kind bigint").where("kind = 1").groupBy("file_name", "block").agg(F.count("*").alias("n")).collect()}
    for name, block, _, _ in order:
        if found >= needed:
            break
        want.add((name, block))
        found += every.get((name, block), 0)
    assert place == want and sum(r["kind"] == 1 for r in rows) == (found if needed else 0)
    # Waves read more than is needed, but not much; each group that is kept is read a second time.
    assert read.value <= 2 * len(order) if needed == 10_000 else read.value <= 2 * len(want) + max(2, len(want))


def test_a_range_of_tokens_opens_its_files_only(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x "), 5).alias("text"), F.format_string("%016x", F.col("id") * 2**50).alias("h"))
    path = str(tmp_path / "store")
    built = store.build_store(docs, path, lambda t: F.transform(F.split(F.trim(t), " "), lambda w: F.char_length(w)), rows_per_file=20)
    index = spark.read.parquet(store.index_folder(path)).orderBy("first").collect()
    assert len(index) >= 20 and sum(r["documents"] for r in index) == 400 and all(a["end"] == b["first"] for a, b in zip(index, index[1:], strict=False))
    for start, stop in ((0, 2_000), (503, 517), (100, 101), (1_999, 5_000), (7, 7), (3_000, 4_000)):
        found = store.read_tokens(spark, path, start, stop)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, store.read_range(built, start, stop).collect()))
        opened = [r for r in index if r["first"] < stop and r["end"] > start]
        if opened and start < stop:
            assert len(found.inputFiles()) == len(opened)


def test_pool_counts_read_the_candidates_once(spark):
    rows = [(1, 0, 5, "AI", "editlens_ai"), (1, 1, 6, "AI", "editlens_ai"), (2, 0, 7, "Mixed", "natural"), (3, 0, 8, "Human", "natural"), (4, 0, 9, None, "editlens_ai")]
    df = spark.createDataFrame(rows, "id long, ordinal int, tokens long, label string, selection string")
    got = {r["pool"]: (r["documents"], r["tokens"]) for r in pools.pool_stats_of(df).collect()}
    assert got == {"ai": (1, 5), "natural": (1, 8), "_unlabeled": (1, 9), "_duplicates": (1, None), "_left_out": (1, None)}
    assert {r["pool"]: r["documents"] for r in pools.pool_stats_of(df.where("id = 3")).collect()} == {"natural": 1, "_duplicates": 0, "_left_out": 0}
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_orderkey AS id", "l_linenumber AS ordinal", "1 AS tokens", "'AI' AS label", "'natural' AS selection")
    assert pools.pool_stats_of(items)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_order_statistics_without_a_window_over_a_group(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, "a").alias("g"), (F.col("id") * 7919 % 5_000).alias("v"))
    found = measure.order_statistics(df, ["g"], "v", {"middle": F.floor(F.col("rows") / 2), "last": F.col("rows") - 1})
    got = {r["g"]: (r["rows"], r["middle"], r["last"]) for r in found.collect()}
    for g in ("a", None):
        own = sorted(i * 7919 % 5_000 for i in range(5_000) if (i % 3 > 0) == (g == "a"))
        assert got[g] == (len(own), own[len(own) // 2], own[-1])
    every = measure.order_statistics(df, [], "v", {"first": F.lit(0)}).first()
    assert (every["rows"], every["first"]) == (5_000, 0)
