"""Repair of conversations: layers against all ways of editing, blocks against whole conversations, odd rows against the SQL twin."""

import functools
import hashlib
import random

import duckdb
import pytest

from webloom.llm import conversation_repair as cr
from webloom.llm import oracles

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The least (cost, audit, lines) of all ways to edit the rows (role, text, truncated, goes)."""

    @functools.cache
    def best(i, state, put_in):
        ways = []
        if i == len(rows):
            ways += [(0, "", ())] if state in "0a" else []
        else:
            role, text, cut, goes = rows[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((4 + c, "D" + a, t))
            if not goes:
                for name in ("user", "assistant"):
                    if state + name[0] in ("0u", "su", "ua", "au"):
                        c, a, t = best(i + 1, name[0], 0)
                        ways.append((3 + 3 * cut + c, "R" + a, (f"{name}:{text}", *t)))
                if state + role[:1] in ("0s", "0u", "su", "ua", "au"):
                    c, a, t = best(i + 1, role[:1], 0)
                    ways.append((3 * cut + c, "K" + a, (f"{role}:{text}", *t)))
        if put_in < 3:
            for name in ("user", "assistant"):
                if state + name[0] in ("0u", "su", "ua", "au"):
                    c, a, t = best(i, name[0], put_in + 1)
                    ways.append((3 + c, "I" + a, (f"{name}:", *t)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "0", 0)


def some_turns(rng):
    rows = [(rng.choice(["system", "user", "assistant", "tool", "", " "]), f"t{i}", rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randrange(9))]
    return [(r, t, cut and not goes, goes) for r, t, cut, goes in rows]


def turns(rows):
    out = cr.Turns()
    for r in rows:
        out.add(*r, 1)
    return out


def test_layers_find_the_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(1_000):
        rows = some_turns(rng)
        cost, _, audit, lines = turns(rows).trace(cr.START, list(cr.AT_END), True)
        assert (cost, audit, tuple(lines)) == plain(tuple(rows)), rows


def test_blocks_give_what_the_whole_gives():
    rng = random.Random(2)
    for _ in range(1_000):
        rows = some_turns(rng)
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows) + 1)))
        blocks = [turns(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        to_go = [list(cr.AT_END)]
        for b in reversed(blocks):
            to_go.append(cr._after(b.costs(), to_go[-1]))
        state, found = cr.START, (to_go[-1][cr.START], "", ())
        for i, b in enumerate(blocks):
            _, state, audit, lines = b.trace(state, to_go[len(blocks) - 1 - i], i == len(blocks) - 1)
            found = (found[0], found[1] + audit, found[2] + tuple(lines))
        assert found == plain(tuple(rows)), rows


def both(spark, rows, tmp_path, **options):
    path = f"{tmp_path}/c"
    df = spark.read.parquet(rows) if isinstance(rows, str) else spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.mode("overwrite").parquet(path)
    got = cr.damage_and_repair(spark.read.parquet(path), **options)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    twin = duck.sql(oracles.CONVERSATION_REPAIR)
    rows = lambda names, values: sorted((sorted(zip(names, r, strict=True)) for r in values), key=repr)
    return rows(got.columns, map(tuple, got.collect())), rows(twin.columns, twin.fetchall())


@pytest.mark.parametrize("options", [{}, {"block_rows": 5}, {"block_chars": 300}])
def test_odd_rows(spark, tmp_path, options):
    """Nulls in every column, blank texts, ties, repeated rows, one hot conversation, roles outside the grammar."""
    rng = random.Random(3)
    rows = []
    for _ in range(1_500):
        conv = rng.choice([None, 1, 2, 3, 3, 3, 3, *range(10, 30)])
        text = rng.choice([None, "", " \t", "yes.", "no", "a b!\n", f"x{rng.randrange(30)}.", f"y{rng.randrange(30)}"])
        rows.append((conv, rng.choice([None, *range(60)]), rng.choice(["system", "user", "assistant", "tool", None, ""]), text))
    got, want = both(spark, rows, tmp_path, **options)
    assert got == want


def test_blocks_of_given_conversations(spark, tmp_path):
    got, want = both(spark, "/root/testdata/sf0.01/conversations.parquet", tmp_path, block_rows=2)
    assert got == want and len(got) == 100


def test_empty_tables_dropped_conversations_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.damage_and_repair(none).collect() == []
    rows = spark.createDataFrame([(7, 1, "user", "hi.", 0)], SCHEMA + ", copies long")
    (row,) = cr.repair(rows).collect()
    assert row.asDict() == {"conv_id": 7, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    clash = spark.createDataFrame([(1, 1, "user", "Hi.", 9, "x", True)], SCHEMA + ", copies int, digest string, blank boolean")
    plainly = spark.createDataFrame([(1, 1, "user", "Hi.")], SCHEMA)
    assert cr.damage_and_repair(clash).collect() == cr.damage_and_repair(plainly).collect()


def test_a_very_long_text_and_a_long_conversation(spark):
    rows = [(1, i, "ua"[i % 2] + "x", "w " * (500_000 if i == 3 else 3) + f"{i}.", 1) for i in range(2_000)]
    (row,) = cr.repair(spark.createDataFrame(rows, SCHEMA + ", copies long"), block_rows=64).collect()
    assert row["cost"] == 0 and row["audit"] == "K" * 2_000
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t, _ in rows).encode()).hexdigest()
