"""Cheapest repair of damaged conversations, by layers of equal cost over bitsets of grammar states.

A whole conversation is ``(s?(ua)+)?`` in the initials of its roles. Its states are START, SYSTEM (after ``s``), USER
and ASSISTANT, one bit each. Layer c holds, for every turn, the set of states from which the rest of the conversation can be
brought to an end at cost c exactly; it follows from layers c, c-3, c-4 and c-6 by a few operations on whole sets, as in
Wu and Manber's matching with errors. The first layer with START before the first turn gives the cost, and a walk from
there that asks the layers which edits stay on a cheapest way, in the order D, I, K, R, spells the least audit.

Rows are sorted by conversation over ranges, so one conversation may span many tasks. Inside a task it is cut into
blocks of bounded size. A conversation of one block inside one range is finished where it is read. Of the others each
block gives its costs between any two states (the same layers, with one set for each state at its end), a stream of
those few numbers backwards gives the costs to go at each block's end, a stream forwards the state it is entered in,
and the blocks are traced in parallel. Only the last hash, which SHA-256 takes in order, runs over one conversation's
pieces in one stream, holding one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written
from webloom.session import ship

START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a turn of the user or assistant that is put in or given that role.
NEXT = (USER, USER, ASSISTANT, USER)
#: What the end of a conversation costs in each state, and the turns put in there.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn of this initial is kept, if the grammar has it."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == "ua"[NEXT[state] - USER] else None


def before_keep(initial: str, after: int) -> int:
    """The states from which keeping leads into the set ``after``. Sets are four bits; a number holds any count of them side by side."""
    ones = 0x1111
    if initial == "s":
        return after >> SYSTEM & ones
    if initial == "u":
        return (after >> USER & ones) * 0b1011
    return (after >> ASSISTANT & ones) * 0b0100 if initial == "a" else 0


def before_new(after: int) -> int:
    """The states from which a turn of the fitting role leads into the set ``after``."""
    return (after >> USER & 0x1111) * 0b1011 | (after >> ASSISTANT & 0x1111) * 0b0100


def layers(turns: list[tuple[str, bool]], ends: dict[int, int], enough: Callable[[int], bool]) -> list[list[int]]:
    """Layers 0, 1, ... of the turns (initial, truncated) that may stay, up to the first whose set before the first turn is ``enough``.

    ``ends`` are the sets behind the last turn by cost. Turns are put in before a turn; what is put in behind the last
    one is part of ``ends``.
    """
    n = len(turns)
    out: list[list[int]] = []
    none = [0] * (n + 1)
    back = lambda c: out[c] if c >= 0 else none
    while True:
        c = len(out)
        here = [0] * (n + 1)
        here[n] = ends.get(c, 0)
        three, four, six = back(c - INSERT), back(c - DELETE), back(c - REROLE - TRUNCATED)
        for i in range(n - 1, -1, -1):
            initial, cut = turns[i]
            keep, new = (three, six) if cut else (here, three)
            here[i] = before_keep(initial, keep[i + 1]) | before_new(new[i + 1]) | four[i + 1] | before_new(three[i])
        out.append(here)
        if enough(here[0]):
            return out


class Turns:
    """Some turns in a row: role, text, whether truncated, whether they have to go, and how often they stand there; a copy has to go."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, bool, bool, int]] = []
        self.free: list[tuple[str, bool]] = []
        self.forced = 0

    def add(self, role: str, text: str, truncated: bool, goes: bool, copies: int) -> None:
        self.rows.append((role, text, truncated, goes, copies))
        self.forced += copies - (not goes)
        if not goes:
            self.free.append((role[:1], truncated))

    def costs(self) -> list[int]:
        """From each state before to each state behind these turns, row by row."""
        n, gone = len(self.free), DELETE * self.forced
        out = [NEVER] * 16
        out[START * 4 + START] = out[SYSTEM * 4 + SYSTEM] = gone + DELETE * n
        system = [TRUNCATED * cut for initial, cut in self.free if initial == "s"]
        if system:
            out[START * 4 + SYSTEM] = gone + DELETE * (n - 1) + min(system)
        if not n:
            out[USER * 4 + USER] = out[ASSISTANT * 4 + ASSISTANT] = gone
            return out
        sets = 0xFF00  # whatever state before, to USER and to ASSISTANT
        found = [0]

        def all_seen(here: int) -> bool:
            found[0] |= here
            return found[0] & sets == sets

        for c, layer in enumerate(layers(self.free, {0: 1 << USER << 4 * USER | 1 << ASSISTANT << 4 * ASSISTANT}, all_seen)):
            for before in range(4):
                for behind in (USER, ASSISTANT):
                    if layer[0] >> 4 * behind >> before & 1 and out[before * 4 + behind] == NEVER:
                        out[before * 4 + behind] = gone + c
        return out

    def trace(self, state: int, to_go: list[int], last: bool) -> tuple[int, int, str, list[str]]:
        """From ``state`` on the least of the cheapest ways: its cost, the state behind, audit and repaired lines. ``to_go`` is what each state behind costs; ``last`` closes the conversation."""
        least = min(to_go)
        ends: dict[int, int] = {}
        for s, cost in enumerate(to_go):
            if cost < NEVER:
                ends[cost - least] = ends.get(cost - least, 0) | 1 << s
        sets = layers(self.free, ends, lambda here: here >> state & 1)
        c = len(sets) - 1
        spent, i, audit, lines = 0, 0, [], []
        at = lambda cost, place, s: cost >= 0 and sets[cost][place] >> s & 1
        for role, text, cut, goes, copies in self.rows:
            if not goes:
                extra = TRUNCATED * cut
                while True:
                    new, kept = NEXT[state], kept_state(state, role[:1])
                    if at(c - DELETE, i + 1, state):
                        c, spent = c - DELETE, spent + DELETE
                        audit.append("D")
                    elif at(c - INSERT, i, new):
                        c, spent, state = c - INSERT, spent + INSERT, new
                        audit.append("I")
                        lines.append(f"{ROLES[new]}:")
                        continue
                    elif kept is not None and at(c - KEEP - extra, i + 1, kept):
                        c, spent, state = c - KEEP - extra, spent + KEEP + extra, kept
                        audit.append("K")
                        lines.append(f"{role}:{text}")
                    else:
                        c, spent, state = c - REROLE - extra, spent + REROLE + extra, new
                        audit.append("R")
                        lines.append(f"{ROLES[new]}:{text}")
                    break
                i += 1
            gone = copies - (not goes)
            spent += DELETE * gone
            audit.append("D" * gone)
        while last and state not in (START, ASSISTANT):
            state = NEXT[state]
            spent += INSERT
            audit.append("I")
            lines.append(f"{ROLES[state]}:")
        return spent, state, "".join(audit), lines


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows conv_id, turn, role, text, copies of conversations damaged by the hash of conversation and turn. A row that is dropped has 0 copies and no turn."""
    column = lambda c, kind: F.col(f"`{c}`").cast(kind)
    rows = df.select(column(conv_col, "long").alias("conv_id"), column(turn_col, "long").alias("turn"), F.coalesce(column(role_col, "string"), F.lit(" ")).alias("role"), F.coalesce(column(text_col, "string"), F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("kind", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
    kind = F.col("kind")
    gone = lambda c, empty: F.when(kind != 0, c).otherwise(F.lit(empty))
    return rows.select(
        "conv_id",
        F.when(kind != 0, F.col("turn")).alias("turn"),
        gone(F.when(kind == 4, F.lit("user")).otherwise(F.col("role")), "").alias("role"),
        gone(F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "").alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


ROW = "conv_id long, turn long, role string, text string, copies long, blank boolean, repeated boolean, truncated boolean"
COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
BLOCK = (
    "conv_id long, done boolean, part int, block int, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", first_turn long, last_turn long, least_turn long, most_turn long, first_role string, last_role string, costs array<long>, "
    "turns_in array<struct<role: string, text: string, truncated: boolean, goes: boolean, copies: long>>, cost long, audit string, repaired_sha256 string"
)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Run:
    """What is counted over turns in a row, and the turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.size = conv_id, Turns(), 0
        self.n = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.least_turn = self.most_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, repeated: bool, truncated: bool) -> None:
        if not copies:  # a dropped row: its conversation is there all the same
            return
        n, initial = self.n, role[:1]
        if not n["rows"]:
            self.first_turn, self.first_role = turn, initial
        elif (self.last_role, initial) not in LEGAL:
            n["illegal"] += 1
        n["illegal"] += copies - 1
        if turn is not None:
            n["turns"] += turn != self.last_turn
            self.least_turn, self.most_turn = turn if self.least_turn is None else self.least_turn, turn
        self.last_turn, self.last_role = turn, initial
        n["rows"] += copies
        n["blank"] += copies if blank else 0
        n["duplicate"] += 0 if blank else copies - (not repeated)
        goes = blank or repeated
        n["truncated"] += truncated and not goes
        self.size += 64 + len(text) + len(role)
        self.turns.add(role, text, truncated and not goes, goes, copies)

    def row(self, part: int, block: int, done: bool) -> dict:
        out = {"conv_id": self.conv_id, "done": done, "part": part, "block": block, **self.n}
        out |= {k: getattr(self, k) for k in ("first_turn", "last_turn", "least_turn", "most_turn", "first_role", "last_role")}
        if done:
            cost, _, audit, lines = self.turns.trace(START, list(AT_END), True)
            return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        return out | {"costs": self.turns.costs(), "turns_in": [dict(zip(("role", "text", "truncated", "goes", "copies"), r, strict=True)) for r in self.turns.rows]}


def _batched(rows: Iterator[dict], schema: pa.Schema, at_once: int = 256, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(64 + len(t["text"]) for t in row.get("turns_in") or ()) + len(row.get("audit") or "") + len(row.get("piece") or b"")
        if len(held) >= at_once or size > most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _mapped(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    schema = _arrow(ddl)
    return df.mapInArrow(lambda batches: _batched(f(_rows(batches)), schema), ddl)


def _blocks(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Sorted rows of ``ROW`` as finished conversations and blocks of the others."""

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        part, block, run, first = TaskContext.get().partitionId(), 0, None, True
        for r in rows:
            conv = r.pop("conv_id")
            if run is None or conv != run.conv_id:
                if run is not None:
                    yield run.row(part, block, done=not first and block == 0)
                    first = False
                run, block = Run(conv), 0
            elif len(run.turns.rows) >= block_rows or run.size > block_chars:
                yield run.row(part, block, done=False)
                run, block = Run(conv), block + 1
            run.add(**r)
        if run is not None:  # the range behind may go on with it
            yield run.row(part, block, done=False)

    return _mapped(rows, cut, BLOCK)


def _after(costs: list[int], to_go: list[int]) -> list[int]:
    return [min(NEVER, *(costs[s * 4 + t] + to_go[t] for t in range(4))) for s in range(4)]


def _streamed(df: DataFrame, backwards: bool, f: Callable[[Iterator[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    """``f`` over the rows of each conversation in the order of its blocks, whatever their number, in one stream."""
    place = [F.desc(c) if backwards else F.asc(c) for c in ("part", "block")]
    return _mapped(df.repartition("conv_id").sortWithinPartitions("conv_id", *place), f, ddl)


PLACE = ["conv_id", "part", "block"]


def _spanning(blocks: DataFrame) -> DataFrame:
    """Results of the conversations of several blocks."""

    def ends(rows: Iterator[dict]) -> Iterator[dict]:
        conv, to_go = object(), []
        for r in rows:
            last = r["conv_id"] != conv
            if last:
                conv, to_go = r["conv_id"], list(AT_END)
            yield {**{c: r[c] for c in PLACE}, "last": last, "to_go": to_go}
            to_go = _after(r["costs"], to_go)

    at_ends = written(_streamed(blocks.select(*PLACE, "costs"), True, ends, "conv_id long, part int, block int, last boolean, to_go array<long>"))
    same = lambda other: [F.col("b.conv_id").eqNullSafe(F.col(f"{other}.conv_id")), F.col("b.part") == F.col(f"{other}.part"), F.col("b.block") == F.col(f"{other}.block")]

    def turns_of(r: dict) -> Turns:
        turns = Turns()
        for t in r["turns_in"]:
            turns.add(**t)
        return turns

    def exits(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            turns = turns_of(r)
            reached = [s for s, cost in enumerate(_after(turns.costs(), r["to_go"])) if cost < NEVER]
            yield {**{c: r[c] for c in PLACE}, "behind": [turns.trace(s, r["to_go"], False)[1] if s in reached else -1 for s in range(4)]}

    with_ends = blocks.alias("b").join(at_ends.alias("e"), same("e")).select("b.*", "e.last", "e.to_go")
    maps = _mapped(with_ends.select(*PLACE, "turns_in", "to_go"), exits, "conv_id long, part int, block int, behind array<int>")

    def entries(rows: Iterator[dict]) -> Iterator[dict]:
        conv, state = object(), START
        for r in rows:
            if r["conv_id"] != conv:
                conv, state = r["conv_id"], START
            yield {**{c: r[c] for c in PLACE}, "state": state}
            state = r["behind"][state]

    entered = written(_streamed(maps, False, entries, "conv_id long, part int, block int, state int"))
    stats = [*COUNTS, "first_turn", "last_turn", "least_turn", "most_turn", "first_role", "last_role"]
    kinds = {f.split()[0]: f.split()[1] for f in BLOCK.split(", ") if len(f.split()) == 2}
    piece = "conv_id long, part int, block int, " + ", ".join(f"{c} {kinds[c]}" for c in stats) + ", cost long, audit string, lines long, piece binary"

    def traced(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            cost, _, audit, lines = turns_of(r).trace(r["state"], r["to_go"], r["last"])
            yield {**{c: r[c] for c in (*PLACE, *stats)}, "cost": cost, "audit": audit, "lines": len(lines), "piece": "\n".join(lines).encode()}

    pieces = _mapped(with_ends.alias("b").join(entered.alias("n"), same("n")).select("b.*", "n.state"), traced, piece)

    def closed(rows: Iterator[dict]) -> Iterator[dict]:
        total, digest, audits, lines = None, None, [], 0
        for r in rows:
            if total is not None and r["conv_id"] == total["conv_id"]:
                if r["rows"]:
                    if total["rows"]:
                        total["illegal"] += (total["last_role"], r["first_role"]) not in LEGAL
                        total["turns"] -= r["first_turn"] is not None and r["first_turn"] == total["last_turn"]
                    total |= {c: r[c] for c in ("last_turn", "last_role")}
                    total["most_turn"] = total["most_turn"] if r["most_turn"] is None else r["most_turn"]
                    total["least_turn"] = r["least_turn"] if total["least_turn"] is None else total["least_turn"]
                for c in (*COUNTS, "cost"):
                    total[c] += r[c]
            else:
                if total is not None:
                    yield total | {"done": True, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
                total, digest, audits, lines = {c: r[c] for c in ("conv_id", *stats, "cost")}, hashlib.sha256(), [], 0
            if r["lines"]:
                digest.update((b"\n" if lines else b"") + r["piece"])
            lines += r["lines"]
            audits.append(r["audit"])
        if total is not None:
            yield total | {"done": True, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    return _streamed(pieces, False, closed, BLOCK)


def repair(rows: DataFrame, *, block_rows: int = 512, block_chars: int = 4 << 20) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by turn (nulls first), then role and text. A conversation whose rows all have 0 copies gets zeros,
    an empty audit and the hash of the empty text; the null conversation is one like others; no rows give no rows.
    ``block_rows`` and ``block_chars`` bound what is worked on at a time, not the result.
    """
    ship(rows.sparkSession)
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = ["conv_id", "role", F.md5(F.col("text").cast("binary")).alias("digest")]
    # Nulls come first, so they are the least turn.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.where("copies > 0").groupBy(*said).agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.md5(F.col("text").cast("binary")) == F.col("d")), "left")
    white = r"\x20\x09-\x0D"
    marked = marked.select(
        "conv_id", "turn", "role", "text", "copies",
        (~F.col("text").rlike(f"[^{white}]")).alias("blank"), F.coalesce(F.col("first") < order, F.lit(False)).alias("repeated"), (~F.col("text").rlike(rf"[.!?][{white}]*\z")).alias("truncated"),
    )
    ordered = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 128)).sortWithinPartitions("conv_id", "turn", "role", "text")
    blocks = written(_blocks(ordered, block_rows, block_chars))
    whole = blocks.where("done").unionByName(_spanning(blocks.where("not done")))
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_and_repair(df: DataFrame, **options) -> DataFrame:
    """``damaged`` conversations repaired. Nulls in role and text are one space; other columns are ignored."""
    return repair(damaged(df), **options)
