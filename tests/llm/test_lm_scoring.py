"""Language-model scores: Elias-Fano sequences and tries against plain look-ups, scores against counts in dictionaries."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from webloom.llm import lm_scoring as lm
from webloom.llm import registry

SCHEMA = "doc_id long, text string"


def trained_on(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def plain(rows, m2=20.0, m3=20.0):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by counts in dictionaries, without codes."""
    c1, c2, c3, texts = Counter(), Counter(), Counter(), 0
    tokens = [[b"<s>", *(t or "").encode().lower().split(), b"</s>"] for _, t in rows]
    for (d, _), w in zip(rows, tokens, strict=True):
        if trained_on(d):
            texts += 1
            c1.update(w[1:])
            c2.update(zip(w, w[1:]))
            c3.update(zip(w, w[1:], w[2:]))
    total, distinct = sum(c1.values()), len(c1)
    c1[b"<s>"] = texts
    out = []
    for (d, _), w in zip(rows, tokens, strict=True):
        score = base = 0.0
        for j in range(1, len(w)):
            alone = (c1[w[j]] + 1) / (total + distinct + 1)
            base += math.log10(alone)
            p = (c2[w[j - 1], w[j]] + m2 * alone) / (c1[w[j - 1]] + m2)
            if j > 1:
                p = (c3[w[j - 2], w[j - 1], w[j]] + m3 * p) / (c2[w[j - 2], w[j - 1]] + m3)
            score += math.log10(p)
        out.append((d, not trained_on(d), len(w) - 1, sum(c1[x] > 0 for x in w[1:]), total, base, score))
    return out


def agree(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 3e-4 * w[2] + 1e-9  # two codes a token, each within 1.3e-4


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (1, 10**9), (5, 5), (1_000, 10**12), (1_000, 1_500), (3_000, 10**5), (70, 2**40)])
def test_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    coded = lm.EliasFano(lm.EliasFano.words_of(values))
    assert (coded[np.arange(n)] == values).all()
    asked = np.concatenate([values, values + 1, np.maximum(values - 1, 0), rng.integers(0, top + 2, 50), [0]]).astype(np.int64)
    place, equal = coded.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()
    bits = 64 * len(lm.EliasFano.words_of(values)) / max(n, 1)
    assert n < 1_000 or bits <= 6 + max(0, math.log2(max(1, top / n)))


def test_trie_finds_its_pairs_and_triples_and_no_others():
    rng = np.random.default_rng(0)
    triples = np.unique(rng.integers(0, 30, (3_000, 3)), axis=0)
    pairs = np.unique(np.concatenate([triples[:, :2], rng.integers(0, 40, (100, 2))]), axis=0)
    place = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    parent = np.array([place[tuple(t[:2])] for t in triples.tolist()])
    trie = lm.Trie(lm.mapped(lm.Trie.build(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), parent, triples[:, 2], np.ones(len(triples)), 5.0)))
    asked, third = rng.integers(0, 45, (5_000, 2)), rng.integers(0, 33, 5_000)
    node = trie.pairs(asked[:, 0], asked[:, 1])
    assert node.tolist() == [place.get(tuple(p), -1) for p in asked.tolist()]
    leaf = {tuple(t): i for i, t in enumerate(triples.tolist())}
    assert trie.triples(node, np.arange(len(node)), third).tolist() == [leaf.get((*p, w), -1) for p, w in zip(asked.tolist(), third.tolist(), strict=True)]


def test_codes_are_close_and_in_order():
    p = np.concatenate([[0.0, 1.0], 10.0 ** -np.linspace(0, 15, 1_000)])
    back = lm.dequantised(lm.quantised(p))
    assert back[0] == 0 and back[1] == 1 and np.allclose(np.log10(back[1:]), np.log10(p[1:]), atol=1.3e-4)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    agree(registry.op12_lm_scoring(spark, folder).collect(), plain(rows))


def test_many_shards_and_held_out_texts_are_likelier_than_by_words_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(df, shard_tokens=20_000).collect()
    agree(got, plain([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_probabilities_of_all_next_tokens_add_up_to_one():
    """In the plain version, which the scores are held against: after each context of some training texts, over all words, the end and one unseen word."""
    ids = [i for i in range(200) if trained_on(i)][:3]
    training = list(zip(ids, ("a b a c", "b a b b c", "a c c a b"), strict=True))
    other = next(i for i in range(200) if not trained_on(i))
    score = lambda text: plain([*training, (other, text)], 2.0, 3.0)[-1][6]
    whole = sum(10 ** score(" ".join(w)) for n in range(7) for w in itertools.product("abcz", repeat=n))
    longer = sum(10 ** score(" ".join(w)) for w in itertools.product("abcz", repeat=7))
    assert 0.7 < whole < whole + longer < 1


@pytest.mark.parametrize(("m2", "m3"), [(2.0, 3.0), (50.0, 0.5)])
def test_other_weights(spark, m2, m3):
    rows = [(i, "a b a c b"[i % 5 :] + " x") for i in range(40)]
    agree(lm.score(spark.createDataFrame(rows, SCHEMA), m2=m2, m3=m3).collect(), plain(rows, m2, m3))


def test_odd_rows(spark):
    rows = [(None, None), (1, "a b A"), (1, "a b A"), (2, ""), (3, " \n"), (None, "é b\x0bc\x1fd"), (2**60, "b a"), (5, "x " * 200_000), (6, "w" * 1_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    agree(lm.score(df).collect(), plain(rows))
    clash = df.selectExpr("*", "'x' AS label", "1 AS counted", "2 AS block", "3 AS number")
    agree(lm.score(clash).collect(), plain(rows))
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = [(i, "a b") for i in range(40) if not trained_on(i)]
    agree(lm.score(spark.createDataFrame(held, SCHEMA)).collect(), plain(held))


def test_equal_texts_of_a_hot_group(spark):
    rows = [(i, "the the the cat " * 20) for i in range(300)] + [(1_000 + i, f"only {i}") for i in range(50)]
    agree(lm.score(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect(), plain(rows))
