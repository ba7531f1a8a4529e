"""Near-duplicate removal by MinHash, per crawl: signatures, band buckets, clusters, one document of each kept.

Shingles are hashed in generated code, their minima taken in Arrow batches. A bucket links each member to
its least id, and clusters are the connected components of those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.relational import join_by_size
from webloom.session import ship
from webloom.sources.tables import materialised


def with_shingles(df: DataFrame, id_col: str, text_col: str, part: Column, n: int = 5) -> DataFrame:
    """id, part, hashes: distinct hashes of the n-word shingles of the lower-cased text; a shorter text is one shingle, an empty one none."""
    # The words are a column of their own, so that no lambda splits the text again.
    split = df.select(F.col(id_col).alias("id"), part.cast("string").alias("part"), F.filter(F.split(F.lower(text_col), r"\W+"), lambda x: x != "").alias("w"))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, F.lit(n))))
    return split.select("id", "part", F.when(F.size("w") > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>")).alias("hashes"))


def with_bands(signed: DataFrame, bands: int = 14, rows: int = 8) -> DataFrame:
    """``signed`` (id, part, hashes) with one key per band, the hash of ``rows`` minima, in place of the hashes; rows without hashes go.

    They go here, not by a filter: Spark would push that below the shingles and split the text again for each of them.
    Minima over seeded permutations are array arithmetic, which numpy does in Arrow batches; as nested lambdas they
    would be interpreted.
    """
    ship(signed.sparkSession)
    rng = np.random.default_rng(5)
    factor, shift = (rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, out = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0)), []
            for values in batch.column(2):
                h = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = np.full(bands * rows, np.iinfo(np.uint64).max)
                for at in range(0, len(h), 2_000):
                    mixed = (h[at : at + 2_000, None] ^ shift) * factor
                    np.minimum(least, mixed.min(axis=0), out=least)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for column in least.reshape(bands, rows).T:
                    key = (key ^ column >> np.uint64(5)) * np.uint64(0x9E3779B97F4A7C15)
                out.append((key ^ key >> np.uint64(31)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "part", "bands"])

    return signed.mapInArrow(keyed, f"id {signed.schema['id'].dataType.simpleString()}, part string, bands array<long>")


def clusters(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) from ``edges`` (a, b)."""
    both = materialised(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    roots = materialised(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        nearer = roots.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jumped = nearer.join(roots.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
        step = materialised(jumped.select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        roots = step.select("node", "root")
        if step.where("old <> root").isEmpty():
            return roots


def near_duplicate_groups(df: DataFrame, *, id_col: str = "id", text_col: str = "text", by: str | None = None, n: int = 5, bands: int = 14, rows: int = 8) -> DataFrame:
    """id, root of each document with a word: the least id of those that shared bands connect to it (of the same ``by``).

    A shared band is a link, whatever the similarity of the two texts: the published recipe verifies nothing. Equal
    signatures are one member from the start, so a hot group of copies stays small; hot buckets and signatures are joined
    by bounded broadcasts.
    """
    group = F.col(by) if by else F.lit("")
    signed = with_shingles(df, id_col, text_col, group, n)
    signed = materialised(with_bands(signed, bands, rows).withColumn("same", F.xxhash64("part", "bands")))
    heads = materialised(signed.groupBy("same").agg(F.min("id").alias("head"), F.count("*").alias("copies"), F.first("part").alias("part"), F.first("bands").alias("bands")))
    members = heads.select("head", F.posexplode("bands").alias("band", "key"), "part").select("head", F.xxhash64("part", "band", "key").alias("bucket"))
    least = materialised(members.groupBy("bucket").agg(F.min("head").alias("first"), F.count("*").alias("size")).where("size > 1"))
    links = join_by_size(members, least, "bucket", "size", bands * heads.count()).where("head <> first").select(F.col("first").alias("a"), F.col("head").alias("b")).distinct()
    roots = clusters(links)
    heads_of = join_by_size(signed.select("id", "same"), heads.select("same", "head", "copies"), "same", "copies", signed.count()).select("id", "head")
    return heads_of.join(roots.withColumnRenamed("node", "head"), "head", "left").select("id", F.coalesce("root", "head").alias("root"))


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """``df`` without the documents whose cluster has one of a lower id."""
    id_col = options.get("id_col", "id")
    losers = near_duplicate_groups(df, **options).where("id <> root").select(F.col("id").alias("__loser"))
    return df.join(losers, F.col(id_col) == F.col("__loser"), "left_anti")


def drop_exact_duplicates(df: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per text: that of the least id. Only ids and digests are shuffled to find it."""
    digest = F.sha2(F.col(text_col), 256)
    keep = df.select(id_col, digest.alias("__digest")).groupBy("__digest").agg(F.min(id_col).alias("__keep")).select("__keep")
    return df.join(keep, F.col(id_col) == F.col("__keep"), "left_semi")
