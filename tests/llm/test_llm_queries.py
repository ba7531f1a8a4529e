"""The registered queries: those with an SQL twin give its rows, the others those of a plain version."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest

from webloom.llm import decontamination, ngram_join, registry
from webloom.llm.common import tokenizer, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(([cell(r[i]) for i in order] for r in values), key=repr)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_against_its_twin(spark, duck, name):
    found, twin = registry.QUERIES[name](spark, FOLDER), duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(twin.columns)
    assert rows(found.columns, found.collect()) == rows(twin.columns, twin.fetchall())


# --- queries without a twin: every row of sf0.001 against a plain version ---------------------------------------------


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_token_queries(spark, documents):
    word, byte = tokenizer(tokenizer_path(registry.WORD_BPE)), tokenizer(tokenizer_path(registry.BYTE_BPE))
    ids = {i: word.encode(t, add_special_tokens=False).ids for i, t in documents}
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in registry.op8_token_counts(spark, FOLDER).collect()}
    assert counts == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in documents}
    at, want = 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]) + 1, zlib.crc32(packed([*ids[i], 2])))
        at += len(ids[i]) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.op5_token_shards(spark, FOLDER).collect()} == want
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for i, t in documents:
        found = byte.encode(t, add_special_tokens=False).ids
        want[i] = (len(found), sha(packed(found)), sha(byte.decode(found, skip_special_tokens=False).encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.op10_bpe_codec(spark, FOLDER).collect()} == want


def stretches(words, item, enough=13):
    """Whether any offset of the item over the text has a stretch of enough words with four in five equal; all windows are tried."""
    need = min(enough, len(item))
    for shift in range(-len(item) + 1, len(words)):
        first, last = max(0, shift), min(len(words), shift + len(item))
        equal = np.array([words[p] == item[p - shift] for p in range(first, last)])
        if len(equal) >= need and equal.sum() >= 0.8 * need:
            so_far = np.concatenate([[0], np.cumsum(equal)])
            for size in range(need, len(equal) + 1):
                if ((so_far[size:] - so_far[:-size]) >= 0.8 * size - 1e-9).any():
                    return True
    return False


def test_decontamination_query(spark, documents):
    found = {(r["doc_id"], r["item_id"]): r for r in registry.op1_decontamination(spark, FOLDER).collect()}
    items = [(r["item_id"], re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = [(i, re.findall(r"\w+", t.lower())) for i, t in documents if len(t) < 6_000]
    kept = {i for i, _ in texts}
    want = {(i, k) for i, words in texts for k, item in items if len(item) >= 5 and len(set(words) & set(item)) >= 0.6 * min(13, len(set(item))) and stretches(words, item)}
    assert want and {k for k in found if k[0] in kept} == want
    for r in found.values():
        assert r["n_equal"] >= 0.8 * r["n_words"] and r["n_words"] >= min(13, r["item_words"])


@pytest.mark.parametrize("n", [5, 6, 8, 10, 12, 13, 16, 20, 30, 40])
def test_items_of_any_length_are_found_with_a_fifth_of_their_words_changed(n):
    rng = random.Random(n)
    item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    seeds, found = decontamination.seeds_of([(1, " ".join(item))]), 0
    for _ in range(200):
        words = list(item)
        for i in rng.sample(range(n), n // 5):
            words[i] = "zzz"
        around = [[f"v{rng.randrange(10**6)}" for _ in range(20)] for _ in range(2)]
        found += bool(decontamination.overlaps([" ".join([*around[0], *words, *around[1]])], seeds)[0])
    assert found >= 195


def test_secret_query(spark, documents):
    found = {r["doc_id"]: r for r in registry.op7_secret_scan(spark, FOLDER).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for i, t in documents:
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert found[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(found[i]["spans"].split(","))
        assert [found[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]


def test_toxicity_query_on_held_out_labels(spark):
    """Held-out accuracy at sf0.1, by language; the languages play no part in the scores."""
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in registry.op9_toxicity(spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    right: dict = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect():
        if got[r["doc_id"]]["held_out"]:
            right.setdefault((lang[r["doc_id"]], r["toxic"]), []).append(got[r["doc_id"]]["predicted"])
    share = {k: sum(v) / len(v) for k, v in right.items()}
    assert all(share[x, 0] <= 0.03 for x in ("en", "de", "fr", "es"))
    assert share["en", 1] >= 0.9 and share["de", 1] >= 0.85 and share["fr", 1] >= 0.85 and share["es", 1] >= 0.6


def test_join_finds_the_links_of_a_template_family(spark):
    """Texts that share most of their words but are not similar, and among them pairs that are."""
    rng = random.Random(7)
    template = [f"t{rng.randrange(10**6)}" for _ in range(174)]
    word = lambda: f"x{rng.randrange(10**9)}"
    rows, pairs = [], []
    for _ in range(150):
        own = [word() for _ in range(30)]
        rows.append((len(rows), " ".join(template + own)))
    for _ in range(60):
        own = [word() for _ in range(30)]
        other = own[:10] + [word() for _ in range(20)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(template + own)), (len(rows) + 1, " ".join(template + other))]
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    linked = [p for p in pairs if similar(*p)]
    assert len(linked) > 50 and not similar(0, 1)
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=40).collect()}
    assert sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)
    assert all(got[i] == i for i in range(150))


def test_quality_rules_against_their_twin_where_rules_are_certified(spark):
    """At sf0.1, where cutoffs are certified and reject what the base lets pass."""
    folder = "/root/testdata/sf0.1"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found, twin = registry.op6_quality_rules(spark, folder), c.sql(registry.ORACLES["op6_quality_rules"])
    got = found.collect()
    assert rows(found.columns, got) == rows(twin.columns, twin.fetchall())
    assert sum(not r["kept"] and not r["base_failed"] for r in got) > 100
