"""What several operators of this package share."""

from __future__ import annotations

import ctypes
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import shared_root, ship

#: Texts of one Arrow batch are worked off in pieces of about this many bytes.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all machines of a cluster share."""
    return f"{shared_root(spark)}/webloom-{uuid.uuid4().hex}"


_MADE: list[str] = []


#: Rows of a partition of a table whose size is known beforehand.
ROWS_EACH = 5_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there and lost executors cost no recomputation.

    Where it is known that there are at most so many ``rows``, they are written in as many partitions as that takes, if
    that is fewer than there are, instead of in many files of a few rows each.
    """
    path = shared_folder(df.sparkSession)
    _MADE.append(path)
    few = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_EACH)))
    few.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Names of the tables among those made.
_NAMED: dict[str, str] = {}


def written_by(df: DataFrame, key: str) -> DataFrame:
    """As ``written``, in buckets of ``key``, so that the table is joined by ``key`` where it lies and only the other side is shuffled."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    _MADE.append(path)
    _NAMED[path] = name = f"webloom_{path.rsplit('-', 1)[1]}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    return spark.table(name)


def column_pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Where each run of about ``size`` bytes of a text column begins, and the run; a longer text is one of its own."""
    total, start = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and total + n > size:
            yield start, column.slice(start, i - start)
            total, start = 0, i
        total += n
    if start < len(column):
        yield start, column.slice(start)


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that ``written`` makes inside the block."""
    paths: list[str] = []
    start = len(_MADE)
    try:
        yield paths
    finally:
        paths += _MADE[start:]


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that nothing will read again, so that later work has their disk."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p in _NAMED:
            spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop(p)}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; all others, whatever they are called, are left behind."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(rows: Iterable[tuple[int | None, bytes]], size: int = PIECE_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Runs of rows that hold about ``size`` bytes of text; a longer text is a run of its own."""
    held: list[tuple[int | None, bytes]] = []
    total = 0
    for row in rows:
        if held and total + len(row[1]) > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[1])
    if held:
        yield held


def trim() -> None:
    """Give back to the system what this process has freed, so that a worker between tasks doesn't hold the most it ever had."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def batch_rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, UTF-8 text) of a batch made by ``keyed``, in slices so that few Python objects live at once."""
    for start in range(0, batch.num_rows, 512):
        part = batch.slice(start, 512)
        yield from zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True)
    trim()


WORD = re.compile(r"\w+")
_WORD_HASH: dict[str, int] = {}


def word_hashes(text: str, most: int = 250_000) -> list[int]:
    """64-bit hashes of the words (letters, digits, underscores) of the lower-cased text; one table of ``most`` words per Python worker remembers them."""
    known, out = _WORD_HASH, []
    if len(known) > most:
        known.clear()
    for w in WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) < 64:
                known[w] = h
        out.append(h)
    return out


def tokenizer(path: str):
    """The library's tokenizer without truncation and padding, single-threaded as a Spark task should be."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of letters whose lower case and normal form are beyond doubt, with ASCII punctuation after it (no apostrophe, which may begin a contraction).
SIMPLE = re.compile(r"""([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)\Z""")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, the other way round."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The same for Arrow.
ARROW_SIMPLE = r"^(?P<word>[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Numbers to little-endian unsigned 32-bit ones, by how many they are.
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Known(dict):
    """What chunks stand for, made when first asked for; at ``limit`` entries it starts anew, and longer chunks are never kept."""

    def __init__(self, make, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = found
        return found


class ChunkIds:
    """Token ids of white-space-delimited chunks for a tokenizer that lower-cases and drops white space, remembered by chunk.

    The tokenizer's words never reach across ASCII white space, so a text's ids are its chunks' ids in a row.
    ``bytes.split`` cuts at exactly the six ASCII white-space characters; others stay inside a chunk and are left to
    the library. Of a simple chunk (letters, then punctuation) the library's model encodes the two parts, each
    remembered; other chunks go through the whole library. Memory is bounded: beyond ``limit`` chunks or
    ``part_limit`` parts a table starts anew, and those of more than ``longest`` bytes are never kept.
    """

    def __init__(self, path: str, limit: int = 500_000, part_limit: int = 1_500_000, longest: int = 48):
        self.tok = tokenizer(path)
        self.model = self.tok.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.known = _Known(self.chunk, limit, longest)
        self.parts = _Known(self.part, part_limit, longest)

    def part(self, text: bytes) -> bytes:
        """The ids of one pre-token in lower case."""
        spelled = text.decode() if text.isascii() else "".join(map(self.letter.__getitem__, text))
        ids = [t.id for t in self.model.tokenize(spelled)] if text else []
        return PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: bytes) -> bytes:
        """The little-endian unsigned 32-bit ids of one chunk."""
        word = chunk.rstrip(PUNCTUATION)
        if word.isalpha():  # of ASCII alone
            return self.parts[word.lower()] + self.parts[chunk[len(word) :]] if len(word) < len(chunk) else self.parts[word.lower()]
        text = chunk.decode()
        simple = SIMPLE.match(text)
        if simple:
            return self.parts[simple[1].lower().encode()] + self.parts[simple[2].encode()]
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in a row, and how many lie before each text and in all.

        Texts are split and their distinct chunks cut into letters and punctuation in Arrow, so that only distinct
        words in lower case, and the chunks that are not simple, are looked up one by one.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = split.flatten().dictionary_encode()
        cut = pc.extract_regex(chunks.dictionary, pattern=ARROW_SIMPLE)
        simple = pc.is_valid(cut)
        words, marks = (pc.utf8_lower(pc.struct_field(cut, i).filter(simple)).dictionary_encode() for i in (0, 1))
        others = chunks.dictionary.filter(pc.invert(simple))
        found = [b""]
        for table, values in ((self.parts, words.dictionary), (self.parts, marks.dictionary), (self.known, others)):
            found += map(table.__getitem__, values.cast(pa.binary()).to_pylist())
        pool, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2
        # Of each distinct chunk its one or two pieces, then of all chunks their ids.
        here, pieces = simple.to_numpy(zero_copy_only=False), np.zeros((len(simple), 2), np.int64)
        pieces[here, 0], pieces[here, 1] = 1 + words.indices.to_numpy(), 1 + len(words.dictionary) + marks.indices.to_numpy()
        pieces[~here, 0] = np.arange(len(others)) + 1 + len(words.dictionary) + len(marks.dictionary)
        pool, sizes = gathered(pool, sizes, pieces.ravel()), sizes[pieces].sum(1)
        which = chunks.indices.to_numpy()
        so_far = np.concatenate([[0], np.cumsum(sizes[which])])
        return gathered(pool, sizes, which), so_far[split.offsets.to_numpy() - split.offsets[0].as_py()]


def gathered(pool: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The chosen runs of a pool in a row, given the sizes of all its runs."""
    starts, each = np.cumsum(sizes) - sizes, sizes[which]
    before = np.cumsum(each) - each
    return pool[np.repeat(starts[which] - before, each) + np.arange(each.sum())]


_CODERS: dict[str, ChunkIds] = {}


def chunk_coder(path: str) -> ChunkIds:
    """One coder per Python worker, so that what it remembers serves all tasks of the worker."""
    if path not in _CODERS:
        _CODERS[path] = ChunkIds(path)
    return _CODERS[path]
