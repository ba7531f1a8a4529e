"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; the hash of a window is taken over the mask's marked positions and
ignores the others, so a substituted word only spoils the windows in which it is marked. Hashes of all windows of the
benchmark are joined with those of every window of every document. A hit puts a benchmark item beside the document
at one offset; the words there are compared one by one, with a score of +1 for an equal word and -4 for another. Any
stretch that is long enough and whose score isn't negative, so at least four in five are equal, decides.

A stretch of 13 words or more with four in five equal holds one of 13, 15, 20 or 25 words with at most 2, 3, 4 or 5
others; the masks together hit every such pattern. Shorter items must be in a text whole and get masks of their own.

The benchmark is the stated query set: the documents stream past it once, where they lie. Its hashes are broadcast in
blocks of bounded size, of which a worker holds one at a time, behind one bitmap of all of them that turns nearly every
window away; a larger benchmark means more blocks to look into, not more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import PIECE_BYTES, batch_rows, keyed, pieces, utf8, word_hashes
from webloom.session import ship

# Masks of weight 6: four of span 11, chosen so that few shifts of one mark the same positions as another, and two short
# ones for the patterns that these miss.
MASKS = ("11101001001", "11010010101", "10110100011", "11001011001", "1110111", "111111")
# Items of fewer words have masks of their own.
WHOLE = 13


#: Bits of the bitmap for each hash, and at most in all (32 MB).
BITS_EACH, BITS_MOST = 16, 1 << 28


@dataclass
class Seeds:
    """The hashes of a block of items, ready for look-up."""

    items: list[tuple[int | None, np.ndarray]]
    masks: list[tuple[int, ...]]  # marked positions
    hashes: list[np.ndarray]  # by mask, sorted
    owners: list[np.ndarray]  # by mask: item, position


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each window, from the ids at its marked positions."""
    n = max(0, len(ids) - mask[-1])
    out = np.zeros(n, np.uint64)
    for at, factor in zip(mask, multipliers(len(mask)), strict=True):
        word = ids[at : at + n] * factor
        out += word ^ word >> np.uint64(32)
    return out ^ out >> np.uint64(29)


def own_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over all of ``n`` words (fewer than 15), of which one at least avoids any fifth of them: as many more parts than changed words as keep half, in every choice."""
    changed = n // 5
    parts = [tuple(range(n * i // (2 * changed), n * (i + 1) // (2 * changed))) for i in range(2 * changed)] if changed else [tuple(range(n))]
    return [tuple(sorted(sum(some, ()))) for some in combinations(parts, max(1, changed))]


def seeds_of(items: list[tuple[int | None, str]], masks=MASKS, least: int = 5) -> Seeds:
    """Items of fewer than ``WHOLE`` words, or than a mask spans, get masks of their own; those of fewer than ``least`` words are left out."""
    encoded = [(item, np.array(words, np.uint64)) for item, text in items if len(words := word_hashes(text or "")) >= least]
    whole = max(WHOLE, *map(len, masks))
    places = [(tuple(i for i, c in enumerate(m) if c == "1"), None) for m in masks] + [(m, n) for n in sorted({len(w) for _, w in encoded if len(w) < whole}) for m in own_masks(n)]
    hashes, owners = [], []
    for mask, size in places:
        # Of a short item only its beginning is a place: it must be in the text whole.
        found = [(window_hashes(words, mask)[: None if size is None else 1], i) for i, (_, words) in enumerate(encoded) if (len(words) >= whole if size is None else len(words) == size)]
        values = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        spots = np.concatenate([np.stack([np.full(len(h), i, np.int32), np.arange(len(h), dtype=np.int32)], axis=1) for h, i in found]) if found else np.zeros((0, 2), np.int32)
        order = np.argsort(values, kind="stable")
        hashes.append(values[order])
        owners.append(spots[order])
    return Seeds(encoded, [m for m, _ in places], hashes, owners)


def bitmap(n_hashes: int) -> np.ndarray:
    """An empty bitmap for so many hashes: its number of bits is a power of two."""
    return np.zeros(max(8, min(BITS_MOST, 1 << (BITS_EACH * max(1, n_hashes) - 1).bit_length())) // 8, np.uint8)


def _bits(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = hashes >> np.uint64(64 - (8 * len(table)).bit_length() + 1)
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def mark(table: np.ndarray, seeds: Seeds) -> None:
    for hashes in seeds.hashes:
        np.bitwise_or.at(table, *_bits(table, hashes))


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the highest score; the first of equals."""
    score = best = start = 0
    out = (0, 0)
    for i, e in enumerate(equal.tolist()):
        if score <= 0:
            score, start = 0, i
        score += 1 if e else -4
        if score > best:
            best, out = score, (start, i + 1)
    return out


def long_stretch(equal: np.ndarray, need: int) -> tuple[int, int]:
    """Start and end of the longest stretch of which at least four in five are equal; unequal ends are cut off while ``need`` words remain."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    best = np.maximum.accumulate(score[::-1])[::-1]
    ends = np.searchsorted(-best, -score, side="right") - 1
    a = int(np.argmax(ends - np.arange(len(score))))
    b = int(ends[a])
    while b - a > need and not equal[b - 1]:
        b -= 1
    while b - a > need and not equal[a]:
        a += 1
    return a, b


class Block:
    """A broadcast block of seeds that leaves the worker's memory after use."""

    def __init__(self, shared, masks: list[tuple[int, ...]]):
        self.shared, self.masks = shared, masks

    def seeds(self) -> Seeds:
        return self.shared.value

    def forget(self) -> None:
        vars(self.shared).pop("_value", None)


def overlaps(texts: list[str], seeds: Seeds | list[Block], enough: int = 13, table: np.ndarray | None = None) -> list[list[tuple[int | None, int, int, int, int, int]]]:
    """For each text (item id, places, first word, words, equal words, the item's words), one for each item of which a stretch of ``enough`` words (or the whole, if shorter) is in it."""
    blocks = seeds if isinstance(seeds, list) else None
    masks = list(dict.fromkeys(m for b in blocks for m in b.masks)) if blocks is not None else seeds.masks
    if table is None and blocks is None:
        table = bitmap(sum(map(len, seeds.hashes)))
        mark(table, seeds)
    gap = max(m[-1] for m in masks) + 1 if masks else 1
    spread = [word_hashes(t) for t in texts]
    starts = np.cumsum([0] + [len(x) + gap for x in spread])
    ids = np.zeros(starts[-1] + gap, np.uint64)
    for at, x in zip(starts, spread, strict=False):
        ids[at : at + len(x)] = x
    sizes = [len(x) for x in spread]
    del spread
    hits: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
    for mask in masks:
        here = window_hashes(ids, mask)
        byte, bit = _bits(table, here)
        at = np.flatnonzero(table[byte] & bit)
        hits[mask] = at, here[at]
    found: list[dict] = [{} for _ in texts]
    for number, block in enumerate(blocks if blocks is not None else [None]):
        held = seeds if block is None else block.seeds()
        for text, items in enumerate(_in_block(held, hits, ids, starts, sizes, enough)):
            found[text].update(((number, k), row) for k, row in items.items())
        if block is not None and len(blocks) > 1:
            block.forget()
    return [[f[k] for k in sorted(f)] for f in found]


def _in_block(seeds: Seeds, hits: dict, ids: np.ndarray, starts: np.ndarray, sizes: list[int], enough: int) -> list[dict]:
    """Of each text the best stretch by item of the block, from the windows that the bitmap let pass."""
    diagonals: set[tuple[int, int, int]] = set()
    for mask, hashes, owners in zip(seeds.masks, seeds.hashes, seeds.owners, strict=True):
        at, here = hits[mask]
        low, high = np.searchsorted(hashes, here), np.searchsorted(hashes, here, side="right")
        for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            doc = int(np.searchsorted(starts, p, side="right")) - 1
            diagonals.update((doc, i, p - int(starts[doc]) - q) for i, q in owners[a:b].tolist())
    found: list[dict] = [{} for _ in sizes]
    for doc, item, shift in sorted(diagonals):
        name, words = seeds.items[item]
        first, last = max(0, shift), min(sizes[doc], shift + len(words))
        equal = ids[starts[doc] + first : starts[doc] + last] == words[first - shift : last - shift]
        a, b = best_stretch(equal)
        need = min(enough, len(words))
        if b - a < need:
            # The best score may be that of a short stretch inside one that is long enough.
            a, b = long_stretch(equal, need)
            if b - a < need:
                continue
        row = (name, 1, first + a, b - a, int(equal[a:b].sum()), len(words))
        old = found[doc].get(item)
        found[doc][item] = row if old is None else (*((name, old[1] + 1)), *(row[2:] if row[4] > old[4] else old[2:]))
    return found


def broadcast_seeds(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, masks, least: int) -> tuple[list[Block], object]:
    """The benchmark's seeds, broadcast in blocks of about ``block_bytes`` of text, and the bitmap of all; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # No more windows than bytes by two for each mask, and few for short items.
    n, table, blocks = total // block_bytes + 1, bitmap(total * (len(masks) + 2) // 4), []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        seeds = seeds_of([(r["item"], r["text"]) for r in rows], masks, least)
        mark(table, seeds)
        blocks.append(Block(context.broadcast(seeds), seeds.masks))
    return blocks, context.broadcast(table)


def run_bytes(blocks: list[Block]) -> int:
    """Texts looked up at a time: more where blocks have to be loaded in turn."""
    return PIECE_BYTES if len(blocks) == 1 else 8 * PIECE_BYTES


FOUND = "doc_id long, item_id long, n_places long, first_word long, n_words long, n_equal long, item_words long"


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", enough: int = 13, masks=MASKS, least: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and benchmark item whose words overlap: doc_id, item_id, n_places (offsets at which they do), and of the best place first_word, n_words (of the stretch), n_equal, item_words; similarity = n_equal / n_words.

    Words are runs of letters, digits and underscores, lower-cased. Null and empty texts overlap nothing; items of
    fewer than ``least`` words are left out. Repeated rows each get their rows, null ids stay null, equal items each
    count, empty tables give no rows, other columns are ignored.
    """
    blocks, table = broadcast_seeds(benchmark, item_col, item_text_col, block_bytes, masks, least)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in pieces((row for batch in batches for row in batch_rows(batch)), run_bytes(blocks)):
            rows = [(doc, *hit) for (doc, _), hits in zip(run, overlaps([t.decode() for _, t in run], blocks, enough, table.value), strict=True) for hit in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "n_places", "first_word", "n_words", "n_equal", "item_words"])

    return keyed(df, id_col, text_col).mapInArrow(found, FOUND).withColumn("similarity", F.col("n_equal") / F.col("n_words"))


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", enough: int = 13, masks=MASKS, least: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``df``, with its columns, whose texts overlap no benchmark item as ``contaminated`` has it.

    Null and empty texts and null ids stay, repeated rows stay or go alike, an empty table gives no rows; with an empty
    benchmark all rows stay.
    """
    ship(df.sparkSession)
    blocks, table = broadcast_seeds(benchmark, item_col, item_text_col, block_bytes, masks, least)
    at = df.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for run in pieces(((None, t) for start in range(0, batch.num_rows, 512) for t in utf8(batch.slice(start, 512).column(at))), run_bytes(blocks)):
                good += [not hits for hits in overlaps([t.decode() for _, t in run], blocks, enough, table.value)]
            yield batch.filter(pa.array(good, pa.bool_()))

    named = df.select(*[F.col(f"`{c}`") for c in df.columns])
    return named.mapInArrow(clean, df.schema)
