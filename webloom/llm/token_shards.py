"""Token ids in binary shards, each compressed by a Re-Pair grammar.

A shard is a run of documents in id order. Within it frequent neighbouring symbols are replaced, over and over, by
nonterminals; the shard keeps the rules, the number of ids that each nonterminal expands to, and where each
document begins in the compressed sequence, so that one document or one range of ids can be decoded alone.

Layout of a shard, all little-endian: 4 bytes magic ``RPG1``; unsigned 32-bit numbers of terminals, rules,
documents and symbols; rules as two rows (left, right) of unsigned 32-bit symbols; expansion lengths of the rules
(unsigned 32 bits); documents' first symbols, one more at the end (unsigned 64 bits); documents' ids so far, one
more at the end (unsigned 64 bits); the symbols, of 16 bits where all fit and else of 32.
The shards travel as a binary column of a Parquet table, so any file system that Spark can write will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import PIECE_BYTES, chunk_coder, column_pieces, keyed, shared_folder

MAGIC = b"RPG1"
#: Terminals and nonterminals together; so symbols fit 16 bits.
SYMBOLS = 1 << 16


def repair(ids: np.ndarray, terminals: int, end: int | None, *, least: int = 7, at_once: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """Compressed symbols and rules (n, 2).

    Each round counts the neighbouring pairs, takes the most frequent (up to ``at_once``, each replaced in at least
    ``least`` places) and replaces their occurrences; where two overlap the more frequent pair wins, and of a run of
    one pair every second is taken. A rule takes twelve bytes and each replacement saves two, so seven pay. Rounds go
    on until no pair pays or the symbols are used up. No rule's left part is ``end`` or expands to ids that close with
    it, so none spans two documents.

    A pair that was too rare stays so unless it holds a new symbol; so later rounds only look at places beside new
    symbols and at those where a frequent pair had to give way.
    """
    rules: list[np.ndarray] = []
    closing = np.zeros(max(SYMBOLS, terminals), bool)  # symbols whose last id is ``end``
    if end is not None:
        closing[end] = True
    seq, n_rules, none = ids.astype(np.uint32), 0, np.uint32(1 << 30)
    places: np.ndarray | None = None  # where to look; None: everywhere
    while len(seq) > 1 and (room := min(at_once, SYMBOLS - terminals - n_rules)) > 0:
        if places is None:
            places = np.arange(len(seq) - 1)
        first, second = seq[places], seq[places + 1]
        keys = first << np.uint32(16) | second  # symbols have 16 bits
        free = np.ones(len(keys), bool) if end is None else ~closing[first]
        # In a run of one symbol each pair overlaps the next.
        same = np.flatnonzero((first == second) & free)
        if len(same):
            begins = np.concatenate([[True], np.diff(places[same]) > 1])
            same = same[(np.arange(len(same)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 1]
            free[same] = False
        ordered = np.sort(keys[free])
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        chosen = often[np.argsort(-counts[often], kind="stable")[:room]]
        pairs = ordered[edges[chosen]]
        # A small table from a pair's hash to its rank; of two in one slot the more frequent is in, the other's turn comes later.
        table = np.full(1 << 20, len(pairs), np.uint32)
        table[((pairs * np.uint32(0x9E3779B1)) >> np.uint32(12))[::-1]] = np.arange(len(pairs), dtype=np.uint32)[::-1]
        found = table[(keys * np.uint32(0x9E3779B1)) >> np.uint32(12)]
        listed = found < len(pairs)
        inside = free & listed & (np.append(pairs, np.uint32(0))[found] == keys)
        rank = np.full(len(seq) + 1, none)
        rank[places[inside] + 1] = found[inside]
        here = rank[places + 1]
        win = np.flatnonzero(inside & (here < rank[places]) & (here <= rank[places + 2]))
        enough = np.bincount(here[win], minlength=1) >= least
        win = win[enough[here[win]]]
        if not len(win):
            break
        used, new, take = np.flatnonzero(enough), (np.cumsum(enough) - 1)[here[win]], places[win]
        rules.append(np.stack([pairs[used] >> np.uint32(16), pairs[used] & np.uint32(0xFFFF)], axis=1))
        closing[terminals + n_rules : terminals + n_rules + len(used)] = closing[rules[-1][:, 1]]
        seq[take] = (terminals + n_rules + new).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[take + 1] = False
        listed[same], listed[win] = True, False
        left = places[listed]
        moved = np.cumsum(keep) - 1
        look = np.zeros(len(seq) + 1, bool)  # a place's entry is the one after it
        look[moved[take] + 1] = look[moved[take]] = look[moved[left[keep[left]]] + 1] = True
        seq = seq[keep]
        n_rules += len(used)
        places = None if len(chosen) < len(often) else np.flatnonzero(look[1 : len(seq)])
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def rule_batches(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Runs of rules whose parts all come before the run."""
    latest = rules.max(axis=1).astype(np.int64) - terminals if len(rules) else np.zeros(0, np.int64)
    start = 0
    while start < len(rules):
        later = np.flatnonzero(latest[start:] >= start)
        stop = start + int(later[0]) if len(later) else len(rules)
        yield start, stop
        start = stop


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each symbol stands for, terminals first."""
    out = np.ones(terminals + len(rules), np.int64)
    for start, stop in rule_batches(rules, terminals):
        out[terminals + start : terminals + stop] = out[rules[start:stop]].sum(axis=1)
    return out


def pack(documents: list[np.ndarray], terminals: int, end: int | None = None) -> bytes:
    """One shard of the documents' ids. With ``end`` every document ends in it."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    seq, rules = repair(ids, terminals, end) if end is not None else (ids.astype(np.uint32), np.zeros((0, 2), np.uint32))
    lengths = rule_lengths(rules, terminals)
    so_far = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.uint64)
    starts = np.searchsorted(np.concatenate([[0], np.cumsum(lengths[seq])]), so_far).astype(np.uint64)
    kind = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    return b"".join([MAGIC, struct.pack("<4I", terminals, len(rules), len(documents), len(seq)), rules.T.astype("<u4").tobytes(), lengths[terminals:].astype("<u4").tobytes(), starts.astype("<u8").tobytes(), so_far.astype("<u8").tobytes(), seq.astype(kind).tobytes()])


class Shard:
    """A packed shard opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.terminals, n_rules, self.n_documents, n = struct.unpack_from("<4I", data, 4)
        at = 20
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(2, n_rules).T
        at += 8 * n_rules
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)])
        at += 4 * n_rules
        self.starts = np.frombuffer(data, "<u8", self.n_documents + 1, at).astype(np.int64)
        at += 8 * (self.n_documents + 1)
        self.so_far = np.frombuffer(data, "<u8", self.n_documents + 1, at).astype(np.int64)
        at += 8 * (self.n_documents + 1)
        self.seq = np.frombuffer(data, "<u2" if self.terminals + n_rules <= 1 << 16 else "<u4", n, at)
        self.first = np.concatenate([np.arange(self.terminals), self.terminals + np.concatenate([[0], np.cumsum(self.lengths[self.terminals :])[:-1]])]).astype(np.int64) if n_rules else np.arange(self.terminals)
        self.pool = np.empty(self.terminals + int(self.lengths[self.terminals :].sum()), np.uint32)
        self.pool[: self.terminals] = np.arange(self.terminals)
        for start, stop in rule_batches(self.rules, self.terminals):
            ids = self.expand(self.rules[start:stop].ravel())
            at = self.first[self.terminals + start]
            self.pool[at : at + len(ids)] = ids

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        before = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.first[symbols] - before, sizes) + np.arange(int(sizes.sum()))]

    def document(self, number: int) -> np.ndarray:
        return self.expand(self.seq[self.starts[number] : self.starts[number + 1]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        doc = int(np.searchsorted(self.so_far, start, side="right")) - 1
        last = int(np.searchsorted(self.so_far, stop, side="left"))
        symbols = self.seq[self.starts[doc] : self.starts[min(last, self.n_documents)]]
        ends = np.cumsum(self.lengths[symbols]) + self.so_far[doc]
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        offset = start - (int(ends[a - 1]) if a else int(self.so_far[doc]))
        return self.expand(symbols[a:b])[offset : offset + stop - start]


SHARD_SCHEMA = "part int, number int, start_in_part long, n_ids long, doc_ids array<long>, shard binary"


def _pack_rows(batches: Iterator[pa.RecordBatch], path: str, end: int, terminals: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    coder, part, number, start = chunk_coder(path), TaskContext.get().partitionId(), 0, 0
    names: list[int | None] = []
    held: list[np.ndarray] = []
    size = 0
    tail = np.array([end], np.uint32)

    def shard() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([pack(held, terminals, end)], pa.binary())], ["part", "number", "start_in_part", "n_ids", "doc_ids", "shard"])

    for batch in batches:
        docs = batch.column(0).to_pylist()
        for first, texts in column_pieces(batch.column(1), 4 * PIECE_BYTES):
            ids, so_far = coder.encode_column(texts)
            for row, (a, b) in enumerate(zip(so_far[:-1].tolist(), so_far[1:].tolist(), strict=True)):
                names.append(docs[first + row])
                held.append(np.concatenate([ids[a:b], tail]))
                size += b - a + 1
                if size >= shard_ids:
                    yield shard()
                    number, start, names, held, size = number + 1, start + size, [], [], 0
    if names:
        yield shard()


def write_shards(df: DataFrame, folder: str, tokenizer_file: str, *, end: int = 2, id_col: str = "doc_id", text_col: str = "text", terminals: int = 49_408, shard_ids: int = 1 << 20) -> None:
    """Encode the documents, close each with ``end`` and write them to ``folder`` in ascending order of id.

    Parts are ranges of ids; a part's shards hold whole documents, about ``shard_ids`` ids each. Null texts are
    empty (just ``end``); null ids come first; rows of one id are ordered by text, repeated rows are all kept; an
    empty table writes an empty table; other columns are ignored.
    """
    # Ranges are cut inside an id too, by how its texts begin, so many rows of one id, or of none, span several parts.
    rows = keyed(df, id_col, text_col).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(partial(_pack_rows, path=tokenizer_file, end=end, terminals=terminals, shard_ids=shard_ids), SHARD_SCHEMA).write.parquet(folder)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part, start, names, data = (batch.column(k)[i].as_py() for k in ("part", "start_in_part", "doc_ids", "shard"))
            opened = Shard(data)
            for a in range(0, len(names), 512):
                docs = range(a, min(a + 512, len(names)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array(names[a : a + 512], pa.int64()), pa.array([start + int(opened.so_far[d]) for d in docs], pa.int64()), pa.array([opened.document(d).astype("<u4").tobytes() for d in docs], pa.binary())],
                    ["part", "doc_id", "start", "ids"],
                )


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_read_rows``, with n_tokens and ids_crc32 for the ids; a shard is expanded at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            part, start, names, data = (batch.column(k)[i].as_py() for k in ("part", "start_in_part", "doc_ids", "shard"))
            opened = Shard(data)
            ids, so_far = memoryview(opened.expand(opened.seq).astype("<u4").tobytes()), opened.so_far
            digests = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(so_far[:-1].tolist(), so_far[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), part, np.int32)), pa.array(names, pa.int64()), pa.array(start + so_far[:-1]), pa.array(np.diff(so_far)), pa.array(digests, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark, folder: str, *, digests: bool = False) -> DataFrame:
    """The documents of ``folder``: doc_id, start (ids of all documents before it) and ids, or n_tokens and ids_crc32.

    Only one number per part, a range of ids, comes to the driver to place the parts one after another.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    before, at = [], 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(before, "part int, before long")  # a row a part
    if digests:
        rows = shards.mapInArrow(_read_digests, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
        rest = ["n_tokens", "ids_crc32"]
    else:
        rows, rest = shards.mapInArrow(_read_rows, "part int, doc_id long, start long, ids binary"), ["ids"]
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), *rest)


def token_shards(df: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write the shards to the cluster's shared folder and read them back as ``read_shards(digests=True)`` does."""
    folder = shared_folder(df.sparkSession)
    write_shards(df, folder, tokenizer_file, **options)
    return read_shards(df.sparkSession, folder, digests=True)
