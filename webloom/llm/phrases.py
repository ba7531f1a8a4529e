"""Phrases whose words stand together more often than their parts would by chance, by sorting packed word numbers.

Words below the least frequency can be in no frequent phrase, so only the others get numbers (see ``blocks``), and a
piece of text breaks at all else. At every place the numbers of the next words up to a break, five at most, make one
key of fixed width, so that one sorted list of keys holds all phrases of two to five words as its prefixes. Each block
of documents sorts its keys by 16-bit digits and counts runs of equal ones; what is left is cut at the quantiles of a
sample of keys and shuffled, each range is sorted by digits again, and runs of equal prefixes are the counts. A run
that touches the end of its range may go on in the next one and is added up with it.

Scores and the choice of phrases are joins of the counts with themselves, in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.blocks import blocks, documents_of, numbered, one_batch, packed, rows_of, unpacked, vocabulary
from webloom.llm.common import trim, written
from webloom.session import ship

#: Characters that no phrase reaches across.
BREAKS = r"[.,;:!?\x0A-\x0D]+"
#: Exact where the products pass 64 bits: decimals of 38 digits, divided as whole numbers.
SCORE = "(cast(a as decimal(17,0)) * cast(total as decimal(17,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def sort_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, by radix sort from the last two bytes to the first."""
    if keys.shape[1] % 2:
        keys = np.concatenate([np.zeros((len(keys), 1), np.uint8), keys], axis=1)
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for j in range(digits.shape[1] - 1, -1, -1):
        order = order[np.argsort(digits[order, j], kind="stable")]  # 16-bit digits are sorted by counting
    return order


def run_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = sort_order(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[starts], np.add.reduceat(counts, starts)


class Keys:
    """Places of a block as keys of ``longest`` words, ``width`` bytes each, highest first; 0 stands for no word."""

    def __init__(self, longest: int, width: int):
        self.longest, self.width = longest, width

    def __call__(self, row: dict) -> np.ndarray:
        _, sizes, _ = documents_of(row["docs"])
        local = unpacked(row["tokens"]).astype(np.int64)
        number = np.append(unpacked(row["numbers"]).astype(np.int64), 0)  # last, the break
        # A break between documents, and enough of them at the end.
        line = np.zeros(len(local) + len(sizes) + self.longest, np.int64)
        line[np.arange(len(local)) + np.repeat(np.arange(len(sizes)), sizes)] = number[local]
        places = np.flatnonzero((line[:-1] > 0) & (line[1:] > 0))
        words = np.zeros((len(places), self.longest), np.int64)
        going = np.ones(len(places), bool)
        for j in range(self.longest):
            going &= line[np.minimum(places + j, len(line) - 1)] > 0
            words[going, j] = line[places[going] + j]
        return np.ascontiguousarray(words.astype(">u8", order="C").view(np.uint8).reshape(len(places), self.longest, 8)[:, :, 8 - self.width :]).reshape(len(places), self.longest * self.width)


def _sorted_as_bytes(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as single values that compare as they do."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel() if len(keys) else np.zeros(0, f"S{keys.shape[1]}")


def _cuts(coded: DataFrame, keys: Keys, ranges: int, each: int, n_blocks: int, seed: int = 5) -> np.ndarray:
    """``ranges`` - 1 keys between which about as many keys lie, from ``each`` a range or so out of a sample of blocks."""
    if ranges == 1:
        return np.zeros(0, f"S{keys.longest * keys.width}")
    wanted = ranges * each
    blocks_read = min(n_blocks, max(50, wanted // 1_000))
    per_block = -(-wanted // blocks_read)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            found = keys(row)
            some = np.random.default_rng(seed).choice(len(found), min(per_block, len(found)), replace=False)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found[some]], pa.binary())], ["key"])

    chosen = coded.sample(min(1.0, 1.2 * blocks_read / max(1, n_blocks)), seed=seed) if blocks_read < n_blocks else coded
    found = sorted(bytes(r["key"]) for r in chosen.mapInArrow(sample, "key binary").collect())
    at = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return np.array(sorted(set(at)), f"S{keys.longest * keys.width}")


def _prefix_runs(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows of word numbers: where runs of equal first ``k`` words begin, their sums, and whether they touch an end; only runs that have k words."""
    starts = np.flatnonzero(np.concatenate([[True], (words[1:, :k] != words[:-1, :k]).any(axis=1)]))
    sums = np.add.reduceat(counts, starts)
    touches = (starts == 0) | (np.append(starts[1:], len(words)) == len(words))
    there = words[starts, k - 1] > 0
    return starts[there], sums[there], touches[there]


def frequent_phrases(coded: DataFrame, n_tokens: int, n_blocks: int, most: int, least: int, longest: int, range_keys: int) -> tuple[DataFrame, int]:
    """Rows key, words, n of all phrases of 2 to ``longest`` words that occur ``least`` times or more, and the bytes of a word in a key."""
    width = max(1, (most.bit_length() + 7) // 8)
    keys = Keys(longest, width)
    ranges = max(1, -(-n_tokens // range_keys))
    cuts = coded.sparkSession.sparkContext.broadcast(_cuts(coded, keys, ranges, 50, n_blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = cuts.value
        for row in rows_of(batches):
            found = keys(row)
            distinct, counts = run_counts(found, np.ones(len(found), np.int64))
            at = np.concatenate([[0], np.searchsorted(_sorted_as_bytes(distinct), borders), [len(distinct)]])
            # Word by word, so that equal bytes lie together.
            columns = distinct.reshape(len(distinct), longest, width)
            number = np.zeros(columns.shape[:2], np.int64)
            for j in range(width):
                number = number << 8 | columns[:, :, j]
            yield one_batch([(k, packed(np.concatenate([number[at[k] : at[k + 1]].T.ravel(), counts[at[k] : at[k + 1]]]))) for k in np.flatnonzero(np.diff(at)).tolist()], "range int, keys binary")

    def count(table: pa.Table) -> pa.Table:
        both = np.concatenate([unpacked(x).reshape(longest + 1, -1) for x in table["keys"].to_pylist()], axis=1)
        packed_keys = np.ascontiguousarray(both[:-1].T.astype(">u4", order="C").view(np.uint8).reshape(both.shape[1], longest, 4)[:, :, 4 - width :]).reshape(both.shape[1], longest * width)
        order = sort_order(packed_keys)
        packed_keys, words, counts = packed_keys[order], both[:-1].T[order], both[-1].astype(np.int64)[order]
        out: list[list] = [[], [], [], []]
        for k in range(2, longest + 1):
            starts, sums, touches = _prefix_runs(words, counts, k)
            kept = touches | (sums >= least)
            out[0] += [bytes(x) for x in packed_keys[starts[kept], : k * width]]
            out[1] += [k] * int(kept.sum())
            out[2] += sums[kept].tolist()
            out[3] += touches[kept].tolist()
        del both, packed_keys, words, counts, order
        trim()
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["key", "words", "n", "open"])

    runs = written(coded.mapInArrow(deal, "range int, keys binary").groupBy("range").applyInArrow(count, "key binary, words int, n long, open boolean"))
    joined = runs.where("open").groupBy("key", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return written(runs.where("not open").select("key", "words", "n").unionByName(joined)), width


def phrases(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, share: int = 100, top: int = 2_000, range_keys: int = 1_000_000) -> DataFrame:
    """The first ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the parts of its lowest-scoring cut do, ``n`` the
    words of its language, score floor(1000 * a * n / (l * r)). A phrase of ``least`` occurrences or more is dropped if
    a longer one that holds it has ``share`` percent of them. Texts are lower-cased in A-Z and break at ``.,;:!?`` and
    line ends; words are delimited by spaces and tabs. A null language is ``und``; null and empty texts have no words;
    repeated rows count each; an empty table, and a language without frequent phrases, give no rows; other columns are
    ignored. ``range_keys`` bounds what is sorted at a time, not the result.
    """
    ship(df.sparkSession)
    docs = df.select(F.lit(0).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("label"), F.lit(True).alias("counted"))
    corpus = numbered(blocks(docs, BREAKS), least)
    words = vocabulary(corpus)
    totals = df.sparkSession.createDataFrame(list(corpus.sums.items()), "lang string, total long")
    found, width = frequent_phrases(corpus.coded, corpus.n_tokens, corpus.n_blocks, corpus.most, least, longest, range_keys)
    # Phrases inside longer ones; between them stands one that is a word longer and occurs no less than the longest.
    w = F.lit(width)
    parts = F.array(F.substring("key", F.lit(1), (F.col("words") - 1) * w), F.substring("key", w + 1, (F.col("words") - 1) * w))
    longer = found.where("words > 2").select(F.explode(parts).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    kept = found.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n"))).select("key", "words", "n")
    # Cuts.
    one = words.select(F.unhex(F.lpad(F.hex("number"), 2 * width, "0")).alias("key"), "n")
    sizes = found.select("key", "n").unionByName(one)
    cut = kept.select("key", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.substring("key", F.lit(1), F.col("k") * w), "rest": F.substring("key", F.col("k") * w + 1, (F.col("words") - F.col("k")) * w)})
    cut = cut.join(sizes.select(F.col("key").alias("first"), F.col("n").alias("l")), "first").join(sizes.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    # The words of each phrase, and its language.
    spelled = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words")), lambda i: F.conv(F.hex(F.substring("key", (i - 1) * w + 1, w)), 16, 10).cast("long"))).alias("place", "number"))
    spelled = spelled.join(words.select("number", "word", "label"), "number").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda e: e["word"]), " ").alias("phrase"), F.first("label").alias("lang"))
    scored = cut.join(spelled, "key").join(totals, "lang")
    least_cut = scored.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = least_cut.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
    # First the best of each of many parts of a language, then the best of these.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
