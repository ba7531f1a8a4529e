"""Phrases: radix sort and run counts against sorting, all results against counting in dictionaries, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from webloom.llm import phrases as ph
from webloom.llm.blocks import packed, unpacked

SCHEMA = "text string, lang string"


def plain(rows, least=100, longest=5, share=100, top=2_000):
    """Rows (lang, rank, phrase, a, l, r, n, score) by counting every phrase of every piece."""
    f: dict = {}
    for text, lang in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        held = {(p[i : i + k]) for p, c in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= share * counts[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1_000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("width", [1, 5, 10, 15])
def test_radix_sort_and_run_counts(width):
    rng = np.random.default_rng(width)
    keys = rng.integers(0, 256 if width > 1 else 20, (500, width)).astype(np.uint8)[rng.integers(0, 500, 3_000)]
    counts = rng.integers(1, 9, len(keys))
    distinct, sums = ph.run_counts(keys, counts)
    want: Counter = Counter()
    for k, c in zip(keys, counts.tolist(), strict=True):
        want[k.tobytes()] += c
    assert [(k.tobytes(), int(c)) for k, c in zip(distinct, sums, strict=True)] == sorted(want.items())


def test_numbers_are_packed_whole():
    numbers = np.array([0, 1, 255, 256, 2**32 - 1])
    assert unpacked(packed(numbers)).tolist() == numbers.tolist() and unpacked(packed(numbers[:0])).tolist() == []


def some_rows(rng, n):
    words = ["the", "of", "New", "York", "City", "hall", "é", "a\x00b", "naïve", "x-y", "."]
    line = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r\n", "\x0b", "!"]) for _ in range(rng.randrange(30)))
    return [(rng.choice([None, "", line(), line(), "in New York City hall " + line()]), rng.choice(["en", "en", "en", "de", None, "a b\n", ""])) for _ in range(n)]


@pytest.mark.parametrize("options", [{"least": 5}, {"least": 3, "range_keys": 50}, {"least": 10, "top": 7}, {"least": 4, "share": 60, "range_keys": 200}, {"least": 5, "longest": 3}])
def test_against_plain_counts(spark, options):
    rows = some_rows(random.Random(4), 600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(ph.phrases(df, **options)) == plain(rows, **{k: v for k, v in options.items() if k != "range_keys"})


def test_one_hot_phrase_over_many_ranges(spark):
    rows = [("spam spam spam spam eggs " * 30 + str(i), "en") for i in range(200)] + [(f"one {i} two {i}", "en") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert rows_of(ph.phrases(df, range_keys=100)) == plain(rows)


def test_empty_tables_extra_columns_and_long_texts(spark):
    assert ph.phrases(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ph.phrases(spark.createDataFrame([(None, None), ("", "en"), (" .", "de")], SCHEMA)).collect() == []
    rows = [("to be or not " * 50_000, "en"), ("w" * 1_000_000 + " of the", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS label", "2 AS counted", "3 AS doc_id", "'k' AS key")
    assert rows_of(ph.phrases(df)) == plain(rows)


def test_products_beyond_64_bits(spark):
    """Scores are whole-number quotients whatever the size of the products."""
    cases = [(10**13 + i, 10**14 + 7 * i, 10**13 + 3 * i, 10**13 + 11 * i) for i in range(50)] + [(10**16, 10**16, 10**16, 10**16), (99, 7, 10**18, 3)]
    df = spark.createDataFrame(cases, "a long, total long, l long, r long").selectExpr("*", f"{ph.SCORE} AS score")
    assert all(r["score"] == 1_000 * r["a"] * r["total"] // (r["l"] * r["r"]) for r in df.collect())
