"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form one group, which no shard boundary may cut. Groups are ordered by a 60-bit hash of the text, so a
shard is a range of hashes, copies stay together and the order costs no shuffle. The smallest shard capacity is
found by binary search with a greedy check; documents are then cut there.

The greedy check needs to know how many bytes lie before a hash. Rather than one number per group, the driver
holds sums over hash ranges ("blocks") and works with two bounds: a greedy walk that cuts at block borders only,
and one that may cut anywhere inside a block of several groups. The blocks that matter are split further, one
small aggregation a round, until both walks give the same capacity. That capacity is the exact optimum, and what the
driver holds depends on the number of shards, not of groups.

A group larger than an even share would fix the capacity alone and leave other shards empty. Such groups stay where
they are in the order, with a cut on either side; the other shards are dealt to the stretches between them, under one
capacity for all, which the search makes as small as can be. At most half of the shards are given away like that, so
every stretch gets one; should there be more large groups, the smaller of them are groups like any other.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written

SIGN = 1 << 63
#: Blocks at first: ranges that share this many leading bits (of which a 60-bit key leaves four alone); a split takes this many more.
FIRST_BITS, MORE_BITS = 18, 6


@dataclass(frozen=True)
class Block:
    low: int  # key at which it begins, less the least of all longs
    bits: int  # leading bits that its keys share
    size: int
    single: bool  # of one group only


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5 digest, which any SQL engine can compute."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-SIGN)), 64 - bits)


def _blocks(rows: DataFrame, bits: int, within: list[Block] | None = None) -> list[Block]:
    """The sums of ``rows`` (key, size) over ranges of ``bits`` leading bits, inside ``within`` (all of one width) if given."""
    if within is not None:
        width = within[0].bits
        wanted = json.dumps([b.low >> 64 - width for b in within])
        these = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(wanted), "array<long>")).alias("wanted"))
        rows = rows.join(F.broadcast(these), _prefix(F.col("key"), width) == F.col("wanted"), "left_semi")
    found = rows.groupBy(_prefix(F.col("key"), bits).alias("prefix")).agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))
    return [Block(r["prefix"] << 64 - bits, bits, r["size"], False) if r["first"] != r["last"] else Block(r["first"] + SIGN, 64, r["size"], True) for r in found.collect()]


def _split(rows: DataFrame, blocks: list[Block], chosen: set[Block]) -> list[Block]:
    out = [b for b in blocks if b not in chosen]
    for bits in {b.bits for b in chosen}:
        out += _blocks(rows, min(64, bits + MORE_BITS), [b for b in chosen if b.bits == bits])
    return sorted(out, key=lambda b: b.low)


@dataclass(frozen=True)
class Stretch:
    """The blocks in order, the bytes before each and in all, and how many lie before each wall, where a cut must be."""

    blocks: list[Block]
    so_far: list[int]
    walls: list[int]

    def walk(self, capacity: int, shards: int, inside: bool) -> tuple[list[int], bool]:
        """Bytes before each cut of a greedy walk with this capacity, and whether the shards hold all. ``inside``: it may cut inside blocks of several groups."""
        at, cuts = 0, []
        for _ in range(shards):
            wall = self.walls[bisect_right(self.walls, at)]
            reach = min(at + capacity, wall)
            if reach < wall:
                i = bisect_right(self.so_far, reach) - 1
                if not inside or self.blocks[i].single:
                    reach = self.so_far[i]
            if reach <= at:
                return cuts, False
            at = reach
            if at == self.so_far[-1]:
                return cuts, True
            cuts.append(at)
        return cuts, False

    def least(self, shards: int, inside: bool) -> int:
        """The smallest capacity with which the walk gets through."""
        low, high = -(-self.so_far[-1] // shards), self.so_far[-1]
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, inside)[1]:
                high = middle
            else:
                low = middle + 1
        return low


def _stretch(blocks: list[Block], own: list[Block]) -> Stretch:
    so_far = list(accumulate((b.size for b in blocks), initial=0))
    lows = [b.low for b in blocks]
    return Stretch(blocks, so_far, sorted({so_far[bisect_left(lows, b.low)] for b in own} - {0} | {so_far[-1]}))


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """For ``rows`` (key long, size long): keys with a shard of their own, first keys of the other shards but the first, and the least capacity of these."""
    own, starts, capacity = minimax_starts(rows, shards)
    return own, [k for k in starts if k not in set(own)][1:], capacity


def minimax_starts(rows: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """As ``minimax_cuts``, with the first keys of all shards in order."""
    blocks = sorted(_blocks(rows, FIRST_BITS), key=lambda b: b.low)
    own: list[Block] = []
    while blocks:
        left, total = shards - len(own), sum(b.size for b in blocks)
        if large := {b for b in blocks if not b.single and b.size > total / left / 8}:
            blocks = _split(rows, blocks, large)
        elif 2 * len(own) + 3 <= shards and (over := max((b for b in blocks if b.single), key=lambda b: (b.size, -b.low), default=None)) and over.size > total / left:
            own.append(over)
            blocks.remove(over)
        else:
            break
    keys, left = sorted(b.low - SIGN for b in own), shards - len(own)
    while blocks:
        here = _stretch(blocks, own)
        least, most = here.least(left, True), here.least(left, False)
        if least == most:
            cuts, _ = here.walk(most, left, False)
            return keys, sorted([*keys, *(blocks[here.so_far.index(c)].low - SIGN for c in [0, *cuts])]), most
        # The cuts of the optimum lie between those of a walk that falls short and one that may go further.
        early, late = here.walk(least, left, False)[0], here.walk(most, left, True)[0]
        chosen: set[Block] = set()
        for k in range(max(len(early), len(late))):
            a, b = (x[k] if k < len(x) else here.so_far[-1] for x in (early, late))
            first, last = bisect_right(here.so_far, min(a, b)) - 1, bisect_right(here.so_far, max(a, b))
            chosen.update(x for x in blocks[first:last] if not x.single)
        blocks = _split(rows, blocks, chosen or {b for b in blocks if not b.single})
    return keys, keys, 0


def minimax_shards(df: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16, cells: int = 256) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus ``row_bytes``), text_crc32, shard, slot.

    ``slot`` numbers a shard's documents from 0 without gaps: documents are dealt into ``cells`` cells a shard by id
    and text, numbered within the cell in order of id and text, and cells follow one another. Rows of one id and one
    text are counted first and numbered together, so neither a hot id (or null) nor a hot text meets in one task.
    A null text has no bytes and is one group with empty texts. Repeated rows each get a slot, a null id stays null,
    an empty table gives no rows, other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = written(
        df.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(text).alias("key"),
        )
    )
    _, starts, _ = minimax_starts(rows.select("key", "size"), shards)
    shard = sum(((F.col("key") >= F.lit(start)).cast("int") for start in starts[1:]), F.lit(0))
    cell = F.pmod(F.coalesce("doc_id", F.lit(0)) + F.col("key"), F.lit(cells)).cast("int")
    placed = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n")).select("*", shard.cast("int").alias("shard"), cell.alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.sum("n").alias("rows"))
    before = counts.select("shard", "cell", (F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows")).alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("first", F.sum("n").over(order) - F.col("n")).join(before, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("before") + F.col("first"), F.col("before") + F.col("first") + F.col("n") - 1)).alias("slot"))
