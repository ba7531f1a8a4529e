"""Training mixtures: which documents a run reads, with exact token budgets, and how they are packed into rows."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice, tee

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.functions.hashing import training_order
from webloom.operators.budget import fill_budget, require_budget, running_total
from webloom.session import ship

ARMS = ("control", "ai", "human", "repeat", "natural", "filtered")
#: Fixed value: AI share of the tokens of the 2026 web sample.
WEB_AI_SHARE = 0.22315880974511895


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


@dataclass(frozen=True)
class Run:
    """A run of an arm: steps on human tokens and steps in all."""

    arm: str
    human_steps: int
    steps: int
    seed: int = 1337

    def __post_init__(self):
        if self.arm not in ARMS or self.human_steps <= 0:
            raise ValueError("a run has one of the arms and some human text")
        alone = self.arm in ("control", "filtered")
        if alone and self.steps != self.human_steps or not alone and self.steps <= self.human_steps:
            raise ValueError("only arms that add text have more steps than human ones")

    @classmethod
    def planned(cls, arm: str, tokens_per_parameter: float, parameters: float, batch_tokens: int, *, ratio: float = 0.0, ai_share: float = WEB_AI_SHARE, seed: int = 1337) -> Run:
        """From tokens per parameter: human ones, of which ``ratio`` more are added, or, for natural and filtered, those of the web mix."""
        steps = half_up(tokens_per_parameter * parameters / batch_tokens)
        if arm in ("natural", "filtered"):
            human = half_up((1 - ai_share) * steps)
            return cls(arm, human, steps if arm == "natural" else human, seed)
        return cls(arm, steps, steps if arm == "control" else half_up((1 + ratio) * steps), seed)


def plan(run: Run, human: DataFrame, ai: DataFrame | None, step_tokens: int, row_tokens: int) -> DataFrame:
    """Documents of a run: pool, id, h, tokens used, epoch, order_key. Pools have id, h (hash, 16 hex digits), tokens.

    Human documents are the prefix of the pool in hash order that holds the human budget; added ones are the prefix
    of the AI pool, or the human documents that follow (human arm), or further passes over the same (repeat).
    """
    ship(human.sparkSession)
    usable = lambda df, pool: df.select(F.lit(pool).alias("pool"), "id", "h", F.least(F.col("tokens"), F.lit(row_tokens)).cast("long").alias("tokens"))
    first, added = run.human_steps * step_tokens, (run.steps - run.human_steps) * step_tokens
    pool = require_budget(usable(human, "human"), "tokens", first)
    base = fill_budget(pool, "h", "tokens", first, trim=True)
    keyed = lambda df, epoch: df.withColumns({"epoch": F.lit(epoch), "order_key": training_order("h", run.seed, epoch)})
    if run.arm in ("control", "filtered"):
        return keyed(base, 0)
    if run.arm in ("ai", "natural"):
        return keyed(base.unionByName(fill_budget(require_budget(usable(ai, "ai"), "tokens", added), "h", "tokens", added, trim=True)), 0)
    if run.arm == "human":
        rest = pool.join(base.select("id"), "id", "left_anti").select("pool", "id", "h", "tokens")
        return keyed(base.unionByName(fill_budget(require_budget(rest, "tokens", added), "h", "tokens", added, trim=True)), 0)
    out = keyed(base, 0)
    for epoch in range(1, math.ceil(run.steps / run.human_steps)):
        left = (run.steps - epoch * run.human_steps) * step_tokens
        again = keyed(base, epoch)
        out = out.unionByName(again if left >= first else fill_budget(again, "order_key", "tokens", left, trim=True))
    return out


def plan_summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("pool").agg(F.count_distinct("id").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))


def rank_rows(rows: DataFrame, rows_per_step: int, ranks: int, row_col: str = "row") -> DataFrame:
    """Step, rank and place of each training row."""
    share = rows_per_step // ranks
    inside = F.col(row_col) % rows_per_step
    return rows.withColumns({"step": F.floor(F.col(row_col) / rows_per_step).cast("long"), "rank": F.floor(inside / share).cast("long"), "place": (inside % share).cast("long")})


def offsets(df: DataFrame, hash_col: str = "h", length_col: str = "tokens") -> DataFrame:
    """Where each document begins in a store written in hash order."""
    return running_total(df, hash_col, F.col(length_col), name="offset")


def pack_jobs(sizes: Iterable[int], most_units: int, most_items: int) -> Iterator[int]:
    """The number of the job that each item goes to: consecutive items, as many as fit."""
    job, units, items = 0, 0, 0
    for size in sizes:
        if size > most_units:
            raise ValueError(f"an item of {size} units fits no job of {most_units}")
        if items and (units + size > most_units or items == most_items):
            job, units, items = job + 1, 0, 0
        units, items = units + size, items + 1
        yield job


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """The rows of sorted batches, run by run of the first column; rows are read as they are asked for."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[0])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4_096) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def jobs_by_shard(df: DataFrame, shard: str, order: str, units: str, most_units: int = 1_000, most_items: int = 1_000) -> DataFrame:
    """shard, order, units, job. Packing is a matter of one shard, in its order; a shard, however long, streams past."""
    ship(df.sparkSession)
    rows = df.select(shard, order, units).repartition(shard).sortWithinPartitions(shard, order)
    kinds = T.StructType([*rows.schema.fields, T.StructField("job", T.LongType())])
    schema = to_arrow_schema(kinds)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def jobs() -> Iterator[tuple]:
            for _, run in _runs(batches):
                items, sizes = tee(run)
                yield from ((*item, job) for item, job in zip(items, pack_jobs((i[2] for i in sizes), most_units, most_items), strict=True))

        return _batches(jobs(), schema)

    return rows.mapInArrow(packed, kinds)


def best_fit(pieces: Iterable[tuple[object, int]], row: int, shelf_size: int = 1_000, keep_rest: bool = False) -> Iterator[list[tuple[object, int, int]]]:
    """Full rows of (name, start, length): the longest piece that fits, else the shortest cut to fit, its rest kept or dropped. Pieces that fill no row at the end are left.

    At most ``shelf_size`` pieces wait at a time, in a queue for each length; bit k of one number says whether any of
    length k waits, so the longest that fits is the top bit of the number below the room, and the shortest its lowest bit.
    """
    feed, queues, lengths, waiting = iter(pieces), defaultdict(deque), 0, 0
    out, room = [], row
    while True:
        for name, length in islice(feed, max(0, shelf_size - waiting)):
            queues[length].append((name, 0))
            lengths, waiting = lengths | 1 << length, waiting + 1
        if not waiting:
            return
        size = (lengths & (2 << room) - 1 or lengths & -lengths).bit_length() - 1
        name, start = queues[size].popleft()
        waiting -= 1
        if not queues[size]:
            del queues[size]
            lengths ^= 1 << size
        used = min(size, room)
        if keep_rest and used < size:
            queues[size - used].append((name, start + used))
            lengths, waiting = lengths | 1 << size - used, waiting + 1
        out.append((name, start, used))
        room -= used
        if not room:
            yield out
            out, room = [], row


def pack_rows(df: DataFrame, stream: str, order: str, length: str, row: int, shelf_size: int = 1_000, keep_rest: bool = False) -> DataFrame:
    """stream, row, place, id, start, length: each stream's documents, in order, packed into full rows.

    A stream is one reader's share; how many there are is a setting (see ``reader_of``). It streams past: only the
    shelf is held.
    """
    ship(df.sparkSession)
    rows = df.select(stream, order, "id", length).repartition(stream).sortWithinPartitions(stream, order, "id")
    kinds = T.StructType([rows.schema[stream], *[T.StructField(c, T.LongType()) for c in ("row", "place")], rows.schema["id"], *[T.StructField(c, T.LongType()) for c in ("start", "length")]])
    schema = to_arrow_schema(kinds)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((name, i, j, *piece) for name, run in _runs(batches) for i, pieces in enumerate(best_fit(((r[2], r[3]) for r in run), row, shelf_size, keep_rest)) for j, piece in enumerate(pieces))
        return _batches(found, schema)

    return rows.mapInArrow(packed, kinds)


def reader_of(hash_col: str, readers: int) -> Column:
    """The reader that a document of this hash (hex text) goes to."""
    return F.pmod(F.conv(F.substring(hash_col, 1, 15), 16, 10).cast("long"), F.lit(readers)).cast("int")
