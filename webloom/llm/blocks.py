"""Texts as blocks of numbers: runs of documents whose words are numbered within the block, then over the whole corpus.

A dictionary of all words of a corpus grows with it, so no task can hold it. A block of a few megabytes has its own
dictionary instead. Blocks send the words they have, each once, to shards by a hash of the word; a shard adds up the
counts, numbers its words, and answers every block. So no word is a hot key however frequent it is, and all that is
shuffled are squeezed arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import column_pieces, discard, tables_made, trim, written, written_by

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def squeezed(data: bytes) -> bytes:
    """The length and the bytes, by Zstandard's fastest level."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2^32 in few bytes: their lowest bytes, then the next ones, squeezed."""
    return squeezed(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(restored(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def halves(numbers: np.ndarray) -> np.ndarray:
    """64-bit numbers as two runs of 32-bit ones."""
    return np.concatenate([numbers & 0xFFFFFFFF, numbers >> 32])


def whole(parts: np.ndarray) -> np.ndarray:
    low, high = parts.astype(np.int64).reshape(2, -1)
    return low | high << 32


def words_of(texts: pa.Array, breaks: str | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, A-Z in lower case, and where each text's begin, with the end of the last.

    White space delimits words, and so does each character of the class ``breaks``, in whose place a word ``.`` stands.
    """
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    if breaks:
        lowered = pc.replace_substring_regex(lowered, pattern=breaks, replacement=" . ")
    split = pc.ascii_split_whitespace(lowered)
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.not_equal(flat, "")
    so_far = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real).dictionary_encode(), so_far[offsets]


def label_and_word(text: str) -> tuple[str, str]:
    """Of a dictionary's entry: the label, quoted, a blank, the word; neither part has a blank or a line end."""
    label, _, word = text.partition(" ")
    return unquote(label), word


MADE = "block long, n_words long, n_tokens long, docs binary, entries binary, counts binary, tokens binary"


def blocks(docs: DataFrame, breaks: str | None = None) -> DataFrame:
    """Rows of ``MADE`` for doc_id, text, label, counted: words are numbered by label and word.

    ``docs`` packs ids, numbers of tokens and whether they count, as ``documents_of`` reads them. ``entries`` is the
    block's dictionary in order of hashes, ``counts`` are its words' occurrences in documents that count, ``tokens``
    their numbers; a break is the number behind the last.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in column_pieces(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, len(texts))
                coded, ends = words_of(texts, breaks)
                indices, sizes = coded.indices.to_numpy().astype(np.int64), np.diff(ends)
                labels = part.column(2).dictionary_encode()
                n_words = max(1, len(coded.dictionary))
                if len(labels.dictionary) == 1:  # the words' own numbers do
                    distinct, tokens = np.arange(len(coded.dictionary)), indices
                else:
                    distinct, tokens = np.unique(np.repeat(labels.indices.to_numpy().astype(np.int64), sizes) * n_words + indices, return_inverse=True)
                spelled, names = coded.dictionary.to_pylist(), [quote(x) for x in labels.dictionary.to_pylist()]
                entries = [f"{names[k // n_words]} {spelled[k % n_words]}" for k in distinct.tolist()]
                real = np.array([breaks is None or spelled[k % n_words] != "." for k in distinct.tolist()], bool)
                hashes = np.fromiter((zlib.crc32(e.encode()) for e in entries), np.int64, len(entries))
                order = np.argsort(np.where(real, hashes, 1 << 32), kind="stable")
                n = int(real.sum())
                place = np.empty(len(order), np.int64)
                place[order] = np.minimum(np.arange(len(order)), n)
                tokens = place[tokens]
                counted = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(tokens[np.repeat(counted, sizes)], minlength=n)[:n]
                ids = part.column(0)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                plain = pc.fill_null(ids, 0).to_numpy().astype(np.int64).view(np.uint64)
                about = np.concatenate([x.astype(np.uint64) for x in (plain & np.uint64(0xFFFFFFFF), plain >> np.uint64(32), known, sizes, counted)])
                listed = squeezed("\n".join(entries[i] for i in order[:n]).encode())
                values = (number, n, len(tokens), packed(about), listed, packed(counts), packed(tokens))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], [c.split()[0] for c in MADE.split(", ")])
                number += 1
                del coded, tokens, entries, spelled, distinct, values
                trim()

    return docs.mapInArrow(cut, MADE)


def documents_of(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids, numbers of tokens, and whether they count, of a block's documents."""
    low, high, known, sizes, counted = unpacked(data).reshape(5, -1)
    ids = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], sizes.astype(np.int64), counted.astype(bool)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            trim()


def one_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    columns = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[kind]) for j, (_, kind) in enumerate(columns)], [name for name, _ in columns])


@dataclass
class Corpus:
    """Blocks whose words have the corpus' numbers.

    ``coded`` has block, docs, tokens, numbers (of the block's dictionary, from 1, 0 for words that have none, in
    order) and counts (over the corpus, of those that have one). Frequent words have low numbers: a shard's word of rank
    k (from 0) has k times the number of shards, plus the shard's, plus 1. ``shards`` has a row for each shard with its
    ``entries`` and ``counts`` by rank. ``sums`` adds up, by label, the counts of all words, numbered or not.
    """

    coded: DataFrame
    shards: DataFrame
    sums: dict[str, int]
    n_shards: int
    n_words: int
    most: int
    n_tokens: int
    n_blocks: int


ANSWER = "block long, shard int, n long, numbers binary, counts binary, entries binary, sums binary"


def numbered(made: DataFrame, least: int = 1, shard_entries: int = 1_000_000) -> Corpus:
    """The blocks of ``blocks``, written, with numbers for the words that count ``least`` times or more. ``shard_entries`` bounds what a shard reads, not the result."""
    spark = made.sparkSession
    with tables_made() as first:
        made = written_by(made, "block")
    total = made.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t"), F.count("*").alias("b")).first()
    n_shards = max(1, -(-(total["w"] or 0) // shard_entries))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            entries = restored(row["entries"]).decode().split("\n") if row["n_words"] else []
            shard = np.fromiter((zlib.crc32(e.encode()) for e in entries), np.int64, len(entries)) * n_shards >> 32
            counts = unpacked(row["counts"])
            at = np.searchsorted(shard, np.arange(n_shards + 1))
            yield one_batch([(k, row["block"], squeezed("\n".join(entries[at[k] : at[k + 1]]).encode()), packed(counts[at[k] : at[k + 1]])) for k in np.flatnonzero(np.diff(at)).tolist()], "shard int, block long, entries binary, counts binary")

    def answer(table: pa.Table) -> pa.Table:
        shard, asked = table["shard"][0].as_py(), table["block"].to_pylist()
        parts = [pa.array(restored(x).decode().split("\n")) for x in table["entries"].to_pylist()]
        coded = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0)
        which = coded.indices.to_numpy().astype(np.int64)
        own = np.concatenate([unpacked(x) for x in table["counts"].to_pylist()]).astype(np.int64)
        counts = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(counts, which, own)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] >= least]
        number = np.zeros(len(counts), np.int64)
        number[order] = np.arange(len(order)) * n_shards + shard + 1
        cuts = np.cumsum([0, *map(len, parts)])
        rows = [(block, shard, 0, packed(number[which[a:b]]), packed(halves(np.where(number > 0, counts, 0)[which[a:b]])), None, None) for block, a, b in zip(asked, cuts[:-1], cuts[1:], strict=True)]
        spelled = coded.dictionary.to_pylist()
        sums: dict[str, int] = {}
        for e, c in zip(spelled, counts.tolist(), strict=True):
            label = e.partition(" ")[0]
            sums[label] = sums.get(label, 0) + c
        listed = "\n".join(f"{label} {c}" for label, c in sums.items())
        kept = "\n".join(spelled[i] for i in order.tolist())
        rows.append((None, shard, len(order), None, packed(halves(counts[order])), squeezed(kept.encode()), listed.encode()))
        trim()
        return pa.Table.from_batches([one_batch(rows, ANSWER)])

    answers = written(made.mapInArrow(deal, "shard int, block long, entries binary, counts binary").groupBy("shard").applyInArrow(answer, ANSWER))
    shards = answers.where("block is null")
    n_words, most, sums = 0, 0, {}
    for r in shards.select("shard", "n", "sums").collect():  # one row a shard
        n_words += r["n"]
        most = max(most, (r["n"] - 1) * n_shards + r["shard"] + 1)
        for line in bytes(r["sums"]).decode().split("\n"):
            label, _, n = line.rpartition(" ")
            sums[unquote(label)] = sums.get(unquote(label), 0) + int(n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            numbers, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a in sorted(row["answers"] or (), key=lambda a: a["shard"]):
                numbers.append(unpacked(a["numbers"]))
                counts.append(whole(unpacked(a["counts"])))
            number = np.concatenate(numbers)
            # Frequent words first, and the break stays last.
            order = np.argsort(number, kind="stable")
            place = np.empty(len(order) + 1, np.int64)
            place[order], place[-1] = np.arange(len(order)), len(order)
            yield one_batch([(row["block"], row["docs"], packed(place[unpacked(row["tokens"])]), packed(number[order]), packed(halves(np.concatenate(counts)[order])))], CODED)

    by_block = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "numbers", "counts")).alias("answers"))
    coded = written_by(made.select("block", "docs", "tokens").join(by_block.hint("merge"), "block", "left").mapInArrow(merge, CODED), "block")
    discard(spark, first)
    return Corpus(coded, shards.select("shard", "entries", "counts"), sums, n_shards, n_words, most, total["t"] or 0, total["b"])


CODED = "block long, docs binary, tokens binary, numbers binary, counts binary"


def vocabulary(corpus: Corpus) -> DataFrame:
    """Rows number (from 1), label, word, n of the numbered words."""

    n_shards = corpus.n_shards

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            counts = whole(unpacked(row["counts"])).tolist()
            text = restored(row["entries"]).decode()
            if counts:
                yield one_batch([(i * n_shards + row["shard"] + 1, *label_and_word(e), c) for i, (e, c) in enumerate(zip(text.split("\n"), counts, strict=True))], "number long, label string, word string, n long")

    return corpus.shards.mapInArrow(spell, "number long, label string, word string, n long")
