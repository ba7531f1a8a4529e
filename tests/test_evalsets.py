"""Evaluation sets: the head of a stream by as few row groups as it takes, shards of exact size, manifests."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import budget, evalsets, measure, sidecars
from webloom.sources import tables


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """300 documents in three files with row groups of 20, and their texts in order."""
    rng, folder = random.Random(0), tmp_path_factory.mktemp("stream")
    texts = ["x" * rng.choice([3, 40, 80, 500]) + str(i) for i in range(300)]
    for k in range(3):
        part = spark.createDataFrame([(t, f"d{i % 4}") for i, t in enumerate(texts[100 * k : 100 * k + 100], 100 * k)], "text string, domain string").coalesce(1)
        part.write.option("parquet.block.row.count.limit", 20).parquet(str(folder / f"file-{k}"))
    return str(folder), texts


@pytest.mark.parametrize(("target", "least"), [(0, 10), (1, 10), (5_000, 10), (9_000, 60), (10**9, 10), (100, 10_000)])
def test_the_head_of_a_stream(spark, stream, target, least):
    folder, texts = stream
    read = spark.sparkContext.accumulator(0)
    rows = evalsets.stream_head(spark, folder, "text string, domain string", target, least, blocks_read=read).collect()
    rows.sort(key=lambda r: (r["place"], r["row_index"]))  # Spark would read them twice to sort them
    want, total = [], 0
    for t in texts:
        if total >= target:
            break
        if len(t) >= least:
            want.append(t)
            total += len(t)
    assert [r["text"] for r in rows] == want
    last = texts.index(want[-1]) // 20 + 1 if want and total >= target else 0
    assert read.value <= (3 * last + 2 if last else 30)


def test_a_set_is_written_once_with_its_manifest(spark, stream, tmp_path):
    head = evalsets.stream_head(spark, stream[0], "text string, domain string", 20_000, 10)
    options = {"source": "s", "selection": "first 20,000 characters", "revision": "r1", "order": ["place", "row_index"], "domain_col": "domain", "rows_per_shard": 30}
    (m,) = evalsets.write_set(head, str(tmp_path), "c4", **options).collect()
    rows = evalsets.read_set(spark, str(tmp_path), "c4").collect()
    assert m["documents"] == len(rows) == sum(m["domains"].values()) and m["characters"] == sum(len(r["text"]) for r in rows) >= 20_000 and m["tokens"] == len(rows)
    assert (m["name"], m["source"], m["revision"]) == ("c4", "s", "r1") and m["domains"] == {d: sum(r["domain"] == d for r in rows) for d in m["domains"]}
    with pytest.raises(FileExistsError):
        evalsets.write_set(head, str(tmp_path), "c4", **options)
    with pytest.raises(FileNotFoundError):
        evalsets.read_set(spark, str(tmp_path), "none")
    files = sorted(tables.shard_names(spark, f"{tmp_path}/c4/documents"))
    sizes = [spark.read.parquet(f"{tmp_path}/c4/documents/{f}").count() for f in files]
    assert all(n == 30 for n in sizes[:-1]) and 0 < sizes[-1] <= 30
    (empty,) = evalsets.write_set(head.where("false"), str(tmp_path), "empty", source="s", selection="none", order=["place"]).collect()
    assert (empty["documents"], empty["characters"], empty["tokens"], empty["domains"], empty["revision"]) == (0, 0, 0, None, None)


@pytest.mark.parametrize("size", [1, 7, 100, 1_000])
def test_shards_are_cut_every_so_many_rows_in_order(spark, tmp_path, size):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"), F.lit("x").alias("hot"))
    numbered = budget.running_total_in_order(df.repartition(6), ["hot", "v"], F.lit(1), name="n")
    tables.write_shards(numbered, str(tmp_path / "t"), "n", rows_per_shard=size)
    at = 0
    for f in tables.shard_names(spark, str(tmp_path / "t")):
        rows = [r["v"] for r in spark.read.parquet(str(tmp_path / "t" / f)).collect()]
        assert rows == list(range(at, min(at + size, 100)))
        at += len(rows)
    assert at == 100


def test_shares_of_files_need_aligned_sidecars(spark):
    docs = spark.createDataFrame([(f"2024-0{1 + i % 2}.parquet", i // 2, i, "d", 10 + i) for i in range(40)], "file_name string, row_index long, id long, dump string, tokens long")
    labels = docs.select("file_name", "row_index", "id", F.when(F.col("id") % 5 == 0, "AI").when(F.col("id") % 5 < 4, "Human").alias("label"))
    got = {r["month"]: r for r in measure.share_of_files(docs, labels, draws=100).collect()}
    for month, odd in (("2024-01", 0), ("2024-02", 1)):
        own = [i for i in range(40) if i % 2 == odd and i % 5 != 4]
        ai = sum(10 + i for i in own if i % 5 == 0)
        assert got[month]["documents"] == len(own) and got[month]["ai_share"] == pytest.approx(ai / sum(10 + i for i in own)) and got[month]["low"] <= got[month]["ai_share"] <= got[month]["high"]
    with pytest.raises(Exception, match="another id"):
        measure.share_of_files(docs, labels.withColumn("id", F.col("id") + 1), draws=10).collect()
    assert sidecars.PLACE == ["file_name", "row_index"]
