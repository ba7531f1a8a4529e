"""N-gram Jaccard self-join by MinHash banding.

Documents are sets of five-word shingles. Equal sets are one node from the start, with its number of copies. Bands of
MinHash values are shuffled; within a bucket every member is paired with the bucket's smallest and largest member,
pairs are verified on the full shingle sets, and the verified links make first classes (connected components). Buckets
whose other members are then still of several classes are cut into blocks of members in order of size, and every pair
of blocks that are not of one class and whose sizes allow a link is compared as a matrix product; its links complete the
classes. So each pair of a bucket is verified, or in one class already, or too different in size, and buckets that their
ends hold together cost pairs in proportion to their members. Of buckets with the same members one is compared.

How many links a document has is then counted in its class, where a set is compared with every other one: members
are cut into blocks, a pair of blocks is one matrix product of bounded size, and only the counts leave it. So no
pairs are written out, and copies count without being compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import batch_rows, discard, keyed, pieces, tables_made, trim, word_hashes, written


def choose_bands(threshold: float, recall: float, hashes: int = 150) -> tuple[int, int]:
    """Bands and rows: of at most ``hashes`` values, as many rows a band as still find a pair at the threshold with probability ``recall``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = (bands, rows)
    return best


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams; a text of fewer words has one, of all its words, and a text without words none."""
    ids = np.array(word_hashes(text), np.uint64)
    if not len(ids):
        return ids
    size = min(n, len(ids))
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[j : j + len(out)] ^ ids[j : j + len(out)] >> np.uint64(31))
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """MinHash bands of shingle sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max)
        for start in range(0, len(found), 2_000):
            values = (found[start : start + 2_000, None] ^ self.shift) * self.factor
            np.minimum(least, values.min(axis=0), out=least)
        out = (least.reshape(self.bands, self.rows) >> np.uint64(7)) * self.mix
        total = out.sum(axis=1, dtype=np.uint64) ^ self.salt
        return ((total ^ total >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def set_key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def signatures(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, bands: int, rows: int) -> DataFrame:
    """One row per document: doc_id, text_hash, set_key (equal for equal shingle sets; null if empty), n_shingles, bands."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands, rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingles(t or "", n) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sign(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "set_key", "n_shingles", "bands"],
                )
            trim()

    docs = keyed(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return docs.mapInArrow(signed, "doc_id long, text_hash long, set_key binary, n_shingles long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """For ``edges`` (a, b) one row per node: node, label (the least node of its component). Labels spread along edges and jump to their labels' labels until nothing changes; each round is written out."""
    n = 2 * edges.count()
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), n)
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), n)
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), n)
        labels = step.select("node", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _linked(table: pa.Table, threshold: float) -> np.ndarray:
    """Which rows' shingle sets are similar, as a matrix; a row is similar to itself."""
    column = table["shingles"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    n = table.num_rows
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(column.values.to_numpy(), kind="stable")
    values, rows = column.values.to_numpy()[order], rows[order]
    # Only shingles of two rows or more are columns of the matrix.
    new = np.concatenate([[True], values[1:] != values[:-1]])
    common = np.diff(np.append(np.flatnonzero(new), len(values))) > 1
    kind = np.cumsum(new) - 1
    places, rows = (np.cumsum(common) - 1)[kind][common[kind]], rows[common[kind]]
    shared = np.zeros((n, n), np.float32)
    width = 4096
    for start in range(0, int(places[-1]) + 1 if len(places) else 0, width):
        a, b = np.searchsorted(places, [start, start + width])
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], places[a:b] - start] = 1
        shared += part @ part.T
    np.fill_diagonal(shared, sizes)
    return shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6


def _count_links(table: pa.Table, threshold: float) -> pa.Table:
    """Linked documents of each set of one pair of blocks, within the block if the two are one."""
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    keys, blocks = table["set_key"].to_pylist(), np.array(table["block"].to_pylist())
    copies = np.array(table["copies"].to_pylist(), np.float64)
    linked = _linked(table, threshold)
    if low == high:
        np.fill_diagonal(linked, False)
    else:
        linked &= blocks[:, None] != blocks[None, :]
    trim()
    return pa.table({"set_key": pa.array(keys, pa.binary()), "links": pa.array((linked @ copies).astype(np.int64), pa.int64())})


def _links_across(table: pa.Table, threshold: float) -> pa.Table:
    """Links between sets of different labels in one pair of blocks."""
    labels = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
    keys = np.array(table["set_key"].to_pylist(), object)
    linked = np.triu(_linked(table, threshold) & (labels[:, None] != labels[None, :]))
    a, b = np.nonzero(linked)
    trim()
    return pa.table({"a": pa.array(keys[a], pa.binary()), "b": pa.array(keys[b], pa.binary())})


#: A key with more than this part of all documents is joined by broadcast: there are fewer such keys than one in this part.
HOT = 1_000


def by_size(rows: DataFrame, small: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, one row for each ``key``, of which ``size`` tells how many of the ``rows`` there are; they are ``total`` in all.

    The keys of more than a thousandth of all rows, fewer than a thousand, are broadcast, so none of them meets in one task.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.col(size) * HOT > total
    rest = rows.join(F.broadcast(small.where(hot).select(*keys)), keys, "left_anti").join(small.where(~hot), keys, how)
    return rows.join(F.broadcast(small.where(hot)), keys).unionByName(rest)


def in_size_blocks(members: DataFrame, by: str, block: int, block_shingles: int) -> DataFrame:
    """``members`` (``by``, set_key, n_shingles, ...) and the block of each: runs in order of size of about ``block`` sets or ``block_shingles`` shingles.

    How many sets of a group have each size decides where blocks begin, so no group is sorted; sets of one size that are
    too many for a block are dealt over several by their hash.
    """
    sizes = members.groupBy(by, "n_shingles").agg(F.count("*").alias("sets"))
    smaller = Window.partitionBy(by).orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(smaller), F.lit(0))
    weight = F.col("sets") * F.col("n_shingles")
    start = F.floor(before(F.col("sets")) / block + before(weight) / block_shingles)
    parts = F.ceil(F.greatest(F.col("sets") / block, weight / block_shingles))
    starts = written(sizes.select(by, "n_shingles", "sets", start.alias("start"), parts.alias("parts")))
    total = starts.agg(F.sum("sets").alias("n")).first()["n"] or 0
    placed = by_size(members, starts, [by, "n_shingles"], "sets", total)
    part = F.when(F.col("parts") <= 1, 0).otherwise(1 + F.pmod(F.xxhash64("set_key"), F.col("parts")))
    return placed.withColumn("block", F.col("start") * (1 << 24) + part).drop("sets", "start", "parts")


def _unsettled(members: DataFrame, ends: DataFrame, labels: DataFrame, n_members: int, threshold: float, block: int, block_shingles: int) -> DataFrame:
    """The pairs of blocks to compare: bucket, low, high and, for each member of the two, set_key and label.

    A bucket's ends have been compared with all its members, so it is settled if the others are of one label. Of
    buckets with the same members one is enough. Blocks are runs in order of size, and two blocks are only paired if
    some of their sizes allow a link.
    """
    inner = by_size(members, ends.where("size > 3"), "bucket", "size", n_members).where((F.col("set_key") != F.col("low.set_key")) & (F.col("set_key") != F.col("high.set_key"))).select("bucket", "set_key", "n_shingles")
    inner = inner.join(labels.select(F.col("node").alias("set_key"), "label"), "set_key", "left").select("bucket", "set_key", "n_shingles", F.coalesce("label", "set_key").alias("label"))
    inner = written(inner)
    digest = lambda seed: F.bit_xor(F.xxhash64("set_key", F.lit(seed)))
    open_buckets = inner.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), digest(1).alias("d1"), digest(2).alias("d2")).where("least < most")
    open_buckets = written(open_buckets.groupBy("n", "d1", "d2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    inner = written(in_size_blocks(by_size(inner, open_buckets, "bucket", "n", n_members).drop("n"), "bucket", block, block_shingles))
    blocks = inner.groupBy("bucket", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("n_shingles").alias("from"), F.max("n_shingles").alias("to"))
    other = blocks.select("bucket", F.col("block").alias("high"), F.col("least").alias("other_least"), F.col("most").alias("other_most"), F.col("from").alias("other_from"))
    fits = (F.col("low") == F.col("high")) | ((F.col("low") < F.col("high")) & (F.col("to") >= F.lit(threshold) * F.col("other_from")))
    pairs = blocks.withColumnRenamed("block", "low").join(other, "bucket").where(fits & (F.least("least", "other_least") < F.greatest("most", "other_most"))).select("bucket", "low", "high")
    return pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high")))).join(inner, ["bucket", "block"]).select("bucket", "low", "high", "set_key", "label")


def similar(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 300, block_shingles: int = 400_000) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, n_shingles.

    ``class_id`` is the least id of the documents that links of similarity ``threshold`` or more connect to it (its
    own if there are none), ``n_links`` the number of other documents of its class at least that similar, copies
    among them, ``n_copies`` the number with the same shingle set, itself included.
    Words are runs of letters, digits and underscores, lower-cased. A text of fewer than ``n`` words is one shingle;
    null, empty and wordless texts are similar to nothing. Rows of one id and repeated rows each get their row; a
    null id takes part, and where a class has null ids only its class_id is null. An empty table gives no rows;
    other columns are ignored. ``block`` and ``block_shingles`` bound what is compared at a time, not the result.
    """
    return _similar(df, id_col, text_col, n, threshold, recall, block, block_shingles).drop("text_hash")


def _similar(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 300, block_shingles: int = 400_000, count_links: bool = True) -> DataFrame:
    """As ``similar``, with text_hash; without ``count_links`` n_links is null, and no class is compared within itself."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(df, id_col=id_col, text_col=text_col, n=n, bands=bands, rows=rows))
    n_docs = signed.count()
    sets = written(signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("from"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    members = sets.select("set_key", "n_shingles", F.explode("bands").alias("bucket"))
    n_sets = sets.count()
    n_members = bands * n_sets
    ends = written(members.groupBy("bucket").agg(F.min(F.struct("set_key", "n_shingles")).alias("low"), F.max(F.struct("set_key", "n_shingles")).alias("high"), F.count("*").alias("size")).where("low.set_key < high.set_key"))
    paired = by_size(members, ends, "bucket", "size", n_members).select("set_key", "n_shingles", F.explode(F.array("low", "high")).alias("end"))
    # Sets whose sizes differ too much cannot be that similar.
    fits = (F.least("n_shingles", "end.n_shingles") >= threshold * F.greatest("n_shingles", "end.n_shingles")) & (F.col("set_key") != F.col("end.set_key"))
    pairs = written(paired.where(fits).select(F.least("set_key", "end.set_key").alias("a"), F.greatest("set_key", "end.set_key").alias("b")).distinct())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in pieces(batch_rows(batch), 1 << 20):
                found = [shingles(t.decode(), n) for _, t in run]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["set_key", "shingles"])

    # Also those members of larger buckets whose size fits neither end.
    inner = by_size(members, ends.where("size > 3").select("bucket", "size"), "bucket", "size", n_members).select("set_key")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).unionByName(inner).distinct().join(sets, "set_key").select(F.col("from.doc_id").alias("wanted_id"), F.col("from.text_hash").alias("wanted_hash"))
    docs = keyed(df, id_col, text_col)
    # Texts are joined by sorting at every size; a broadcast would only do while there are few.
    source = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_hash")), "left_semi")
    contents = written(source.mapInArrow(full, "set_key binary, shingles array<long>").dropDuplicates(["set_key"]))
    with_a = pairs.join(contents.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a")), "a")
    with_b = with_a.join(contents.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    links = written(with_b.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("sizes")).where(F.col("shared") >= threshold * (F.col("sizes") - F.col("shared")) - 1e-6).select("a", "b"))
    labels = components(links)
    across = _unsettled(members, ends, labels, n_members, threshold, block, block_shingles).join(contents, "set_key")
    more = written(across.groupBy("bucket", "low", "high").applyInArrow(lambda t: _links_across(t, threshold), "a binary, b binary").distinct())
    if not more.isEmpty():
        # Classes are joined: labels of the first ones are the nodes.
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()
        first = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        labels = written(first.join(components(joined).select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").select("node", F.coalesce("final", "label").alias("label")), n_sets)
    labels = labels.join(sets.select(F.col("set_key").alias("node"), "first_id", "copies", "n_shingles"), "node")
    classes = labels.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members"), F.sum("copies").alias("documents"), F.sum("n_shingles").alias("all_shingles"))
    placed = written(by_size(labels, classes, "label", "members", n_sets), n_sets)
    n_blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("all_shingles") / block_shingles)).cast("int")
    dealt = placed.where("members > 2").withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    dealt = dealt.select("label", F.col("node").alias("set_key"), "copies", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).select("label", "set_key", "copies", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    if count_links:
        counted = written(dealt.join(contents, "set_key").groupBy("label", "low", "high").applyInArrow(lambda t: _count_links(t, threshold), "set_key binary, links long").groupBy("set_key").agg(F.sum("links").alias("links")), n_sets)
        of_set = placed.join(counted, F.col("node") == F.col("set_key"), "left").select(F.col("node").alias("set_key"), "class_id", F.coalesce("links", F.col("documents") - F.col("copies")).alias("links"))
        links_of = F.coalesce("links", F.lit(0))
    else:
        of_set, links_of = placed.select(F.col("node").alias("set_key"), "class_id"), F.lit(None).cast("long")
    of_set = written(sets.select("set_key", "first_id", "copies").join(of_set, "set_key", "left").select("set_key", F.coalesce("class_id", "first_id").alias("class_id"), "copies", links_of.alias("links")), n_sets)
    return by_size(signed.select("doc_id", "text_hash", "set_key", "n_shingles"), of_set, "set_key", "copies", n_docs, "left").select(
        "doc_id", "text_hash", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)) if count_links else F.lit(None).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), "n_shingles"
    )


def drop_similar(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without the documents that are similar to one of a lower id in their class; rows with a null id stay.

    Rows that share the id and the text of a kept document are one document and leave one row, the one whose columns
    hash lowest. Null, empty and wordless texts stay, an empty table stays empty; all columns stay.
    """
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(df.columns))]  # so that no column clashes with those added here
    rows, id_, text = df.toDF(*names), names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    with tables_made() as steps:
        result = _similar(rows, id_, text, count_links=False, **options)
    found = written(result)
    discard(spark, steps)
    key = {"loser": F.col(id_).cast("long"), "loser_text": F.xxhash64(F.col(text).cast("string"))}
    losers = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("loser"), F.col("text_hash").alias("loser_text")).distinct()
    out = rows.join(losers.hint("merge"), (key["loser"] == F.col("loser")) & (key["loser_text"] == F.col("loser_text")), "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("loser"))
    if not repeated.isEmpty():
        twice = key["loser"] == F.col("loser")
        once = out.join(repeated, twice, "left_semi").groupBy(id_, text).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
        out = out.join(repeated, twice, "left_anti").unionByName(once)
    return out.toDF(*df.columns)
