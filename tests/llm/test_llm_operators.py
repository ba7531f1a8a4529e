"""Each operator against a plain version, and on odd rows: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import bpe_codec, decontamination, licenses, ngram_join, quality, secrets, sharding, token_counts, token_shards, toxicity
from webloom.llm.common import tokenizer, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
LONG = "long text with Words, numbers 12345 and marks!! " * 3_000
ODD = [
    (1, None), (2, ""), (3, "A plain text, told twice."), (3, "A plain text, told twice."), (4, "A plain text, told twice."), (None, "text without id"), (5, LONG), (6, " \n\t "),
    (7, "don't ''s !'s <|endoftext|>x <|startoftext|> é é ﬁ İ Σς \x1c\x85\xa0　 😀😀 中文字 ²³"), (8, "x" * 5_000), (9, "12 34"), (10, "͸ unassigned \U0001e900"), (11, "ǅ ß ẞ ſ K ÀÉ-Õ."),
]
TEXTS = [t or "" for _, t in ODD]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame(ODD, schema).repartition(3)
    for name in ("row", "shard", "slot", "key", "size", "words", "lang", "hash", "set_key", "bands", "label", "template", "features", "score", "text_hash", "n_words", "__quality_text"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def by_row(rows, *columns):
    return sorted(([r["doc_id"], *[r[c] for c in columns]] for r in rows), key=repr)


def expected(*functions):
    return sorted(([i, *[f(t or "") for f in functions]] for i, t in ODD), key=repr)


# --- token counts, codec, shards -------------------------------------------------------------------------------------


def test_token_counts(odd, empty):
    tok = tokenizer(WORD)
    got = token_counts.count_tokens(odd, WORD, table_size=5, cache_size=7).collect()
    assert by_row(got, "n_bytes", "n_tokens") == expected(lambda t: len(t.encode()), lambda t: len(tok.encode(t, add_special_tokens=False).ids))
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.count_tokens(empty, WORD).count() == 0


def test_codec(odd, empty):
    tok = tokenizer(BYTE)
    got = bpe_codec.encode_decode(odd, BYTE).collect()
    ids = lambda t: np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert by_row([r.asDict() | {"ids": bytes(r["ids"])} for r in got], "ids", "decoded") == expected(ids, lambda t: tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False))
    digests = bpe_codec.encode_decode_digests(odd, BYTE).collect()
    assert by_row(digests, "ids_sha256") == expected(lambda t: hashlib.sha256(ids(t)).hexdigest())
    assert bpe_codec.encode_decode(empty, BYTE).count() == 0


def test_trie_encodes_random_bytes_as_merging_does():
    random.seed(1)
    bpe, words = bpe_codec.codec(BYTE), set()
    while len(words) < 400:
        words.add("".join(random.choice("aaabinthe  é😀") for _ in range(random.randint(1, 12))).encode())
    words = sorted(words)
    assert bpe.encode_words(words) == [bpe.merged(w) for w in words]


def test_shards_round_trip(spark, odd, empty, tmp_path):
    tok = tokenizer(WORD)
    token_shards.write_shards(odd, str(tmp_path / "s"), WORD, shard_ids=50)
    got = token_shards.read_shards(spark, str(tmp_path / "s")).collect()
    ids = lambda t: np.asarray([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert by_row([r.asDict() | {"ids": bytes(r["ids"])} for r in got], "ids") == expected(ids)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    token_shards.write_shards(empty, str(tmp_path / "e"), WORD)
    assert token_shards.read_shards(spark, str(tmp_path / "e")).count() == 0
    digests = token_shards.token_shards(odd, WORD).collect()
    assert by_row(digests, "n_tokens", "ids_crc32") == expected(lambda t: len(ids(t)) // 4, lambda t: zlib.crc32(ids(t)))


def test_no_rule_spans_interleaved_short_documents():
    for kinds in ([[5, 7, 2], [6, 8, 2]], [[5, 7, 9, 2], [5, 8, 2], [2]], [[3, 2]]):
        docs = [np.array(k, np.uint32) for _ in range(1_000) for k in kinds]
        shard = token_shards.Shard(token_shards.pack(docs, 10, end=2))
        assert all(np.array_equal(shard.document(i), d) for i, d in enumerate(docs))
        assert shard.ids(2, 40).tolist() == np.concatenate(docs)[2:40].tolist()


def test_grammar_random_access():
    rng = np.random.default_rng(0)
    phrase = rng.integers(3, 50, 30)
    docs = [np.append(np.concatenate([phrase[: rng.integers(1, 30)] for _ in range(20)] + [rng.integers(3, 90, 5)]), 2).astype(np.uint32) for _ in range(40)] + [np.array([2], np.uint32), np.full(300, 7, np.uint32)]
    docs[-1][-1] = 2
    data = token_shards.pack(docs, 100, 2)
    shard, flat = token_shards.Shard(data), np.concatenate(docs)
    assert len(shard.rules) > 5 and len(shard.seq) < len(flat) / 2
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2))
        assert (shard.ids(int(a), int(b)) == flat[a:b]).all()
    assert not len(token_shards.Shard(token_shards.pack([], 100, 2)).seq)


# --- sharding --------------------------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    """Smallest capacity of a contiguous partition, by trying all."""
    for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1):
        used, held = 1, 0
        for s in sizes:
            if held + s > c:
                used, held = used + 1, 0
            held += s
        if used <= shards:
            return c


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_minimax_is_optimal(spark, shards):
    random.seed(shards)
    rows = [(random.randint(-(2**63), 2**63 - 1), random.randint(1, 60)) for _ in range(150)]
    rows += [(rows[0][0], 20)] * 3
    own, cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(rows, "key long, size long"), shards)
    sizes = Counter()
    for k, s in rows:
        sizes[k] += s
    ordered = [sizes[k] for k in sorted(sizes) if k not in own]
    assert capacity == least_capacity(ordered, shards - len(own))
    bins = Counter()
    for k in sizes:
        if k not in own:
            bins[sum(k >= c for c in cuts)] += sizes[k]
    assert max(bins.values()) <= capacity and len(bins) <= shards - len(own)


def test_large_groups_get_their_own_shard(spark):
    rows = [(5, 900), (-7, 500)] + [(k * 10**17, 10) for k in range(1, 41)]
    own, cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(rows, "key long, size long"), 10)
    assert own == [-7, 5] and capacity == 50 and len(cuts) == 7


def test_sharding_of_odd_rows(odd, empty):
    got = sharding.minimax_shards(odd, shards=4).collect()
    assert by_row(got, "size", "text_crc32") == expected(lambda t: len(t.encode()) + 16, lambda t: zlib.crc32(t.encode()))
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({r["shard"] for r in got if r["doc_id"] in (3, 4)}) == 1 and len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert sharding.minimax_shards(empty, shards=4).count() == 0


# --- licenses --------------------------------------------------------------------------------------------------------

LICENSED = [
    (21, "Released under the MIT License. Under the mit-license again, cc by nc"), (22, "LICENSED under CC BY-NC 4.0 and the Apache License, Version 2.0"), (23, "under the mİt license K ccé by nc"),
    (24, "x " + licenses.TEMPLATES[0][1].replace("copy of this", "copy of all this") + " y"), (25, "permission is hereby granted"), (26, licenses.TEMPLATES[3][1].upper()),
]


def base_places(text):
    lowered = text.translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def test_licenses(spark, odd, empty):
    df = odd.select("doc_id", "text", "row", "label", "template", "words").unionByName(spark.createDataFrame(LICENSED, "doc_id long, text string").withColumns({c: F.lit(0).cast("string") for c in ("row", "label", "template", "words")}))
    got = licenses.license_scan(df).collect()
    want = []
    for i, t in [*ODD, *LICENSED]:
        n, places = base_places(t or "")
        starts = [p for p, _ in places]
        want.append([i, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))])
    assert by_row(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[24][0] == "mit" and 0.9 < labels[24][1] <= 1 and labels[25][0] == "" and 0 < labels[25][1] < 0.6 and labels[26] == ("gpl", 1.0)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    assert licenses.license_scan(empty).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_quality_counts(spark, odd, empty):
    random.seed(5)
    more = [(100 + i, "\n".join(" ".join(random.choice("a b c d # |x") for _ in range(random.randint(0, 9))) for _ in range(8))) for i in range(40)]
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, labels).collect()
    want = [[i, *plain_quality(t or "")] for i, t in [*ODD, *more]]
    assert by_row(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=repr)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] != r["base_failed"] for r in got)
    assert quality.judge(empty, labels).count() == 0
    assert quality.quality_filter(df, labels).columns == df.columns


def test_binomial_bound():
    exact = lambda x, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
    for x, n, p in ((0, 10, 0.1), (3, 50, 0.02), (10, 10, 0.5), (5, 200, 0.05)):
        assert abs(quality.binomial_at_most(x, n, p) - min(1, exact(x, n, p))) < 1e-12


def test_cutoffs_hold_the_risk_and_spare_the_good():
    grid = (0.5, 0.3, 0.1)
    # 2,000 good documents below all cutoffs, 100 bad ones above the second: the milder of equal cutoffs is taken.
    assert quality.choose({0: (2_000, 0), 2: (0, 100)}, grid, 0.005, 0.002, 0.9) == 0.3
    assert quality.choose({0: (200, 0), 2: (0, 100)}, grid, 0.005, 0.002, 0.9) is None
    assert quality.choose({0: (2_000, 0), 1: (40, 5), 3: (40, 100)}, grid, 0.005, 0.002, 0.9) is None
    assert quality.choose({}, grid, 0.005, 0.002, 0.9) is None


def test_certified_rule_rejects(spark):
    clean, junk = "these are some plain and quite different words of a text number {}", "these## are## some## marked| and%% rather$$ odd&& words## of## a## text## number {}"
    docs = [(i, (junk if i % 10 == 0 else clean).format(i), "en") for i in range(4_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in quality.quality_filter(df, labels).collect()}
    assert kept == {i for i, *_ in docs if i % 10}


# --- secrets ---------------------------------------------------------------------------------------------------------


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, odd, empty):
    random.seed(9)
    parts = ["token", "Secret", "API_KEY", "=", ": ", '"', "AKIA", "ABCDEF0123456789", "abcdef0123456789", "plain words", "é😀", "x.y", "ſecret=", "deadbeef", " "]
    more = [(200 + i, "".join(random.choice(parts) for _ in range(30))) for i in range(150)]
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = secrets.secret_scan(df).collect()
    assert by_row(got, "base_sha256") == sorted(([i, hashlib.sha256(plain_spans(t or "").encode()).hexdigest()] for i, t in [*ODD, *more]), key=repr)
    assert secrets.secret_scan(empty).count() == 0
    back = secrets.redact(df)
    assert back.columns == df.columns and back.count() == df.count()
    assert not [r for r in back.collect() if r["text"] and plain_spans(r["text"].replace("<SECRET>", "\n"))]


def test_battery_tells_random_from_written():
    random.seed(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = sum(any(k == 3 for *_, k in secrets.scan("see " + "".join(random.choice(letters) for _ in range(44)) + " there")) for _ in range(200))
    assert found > 180
    written = ["internationalization", "a/path/to/some/ordinary/file/name", "incomprehensibilities_and_more_words", "zzzzzzzzzzzzzzzzzzzzzzzzzzzz", "20240131-20240228-20240331", "someCamelCaseIdentifierNameHere", "====================="]
    assert not [t for t in written if secrets.scan(t)]
    assert secrets.discoveries([(20, 0.5), (40, 1e-9)], 1e-3) == [False, True] and secrets.discoveries([], 0.1) == []


def test_secrets_glued_to_keys_and_paths_are_found():
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for before, after in (("AWS_KEY=", ""), ("sig=", ""), ("x?a=b&sig=", "&c=d"), ("/etc/my_app/keys/", ""), ("sk_live_", "/x"), ("my-prefix_", "==")):
        found = 0
        for _ in range(100):
            value = "".join(rng.choice(letters) for _ in range(44))
            text = f"see {before}{value}{after} there"
            spans = [s for s in secrets.scan(text) if s[2] == 3]
            found += any(a <= text.index(value) and text.index(value) + 44 <= b for a, b, _ in spans)
        assert found >= 95
    assert not secrets.scan("see key_of_the_configuration=the_long_name_of_a/very-long_path_without_secrets there")
    assert secrets.candidates("a_key=" + "A" * 20 + "==") == [(6, 28)]


# --- decontamination, join -------------------------------------------------------------------------------------------


def made(seed, n):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randint(0, 60)) for _ in range(n)]


def test_decontamination(spark, odd, empty):
    item = made(1, 40)
    changed = list(item)
    for i in (5, 17, 29):
        changed[i] = "other"
    docs = [(1, " ".join(made(2, 50) + item + made(3, 20))), (2, " ".join(made(4, 9) + changed)), (3, " ".join(item[:14])), (4, " ".join(item[:9] + made(5, 40))), (5, " ".join(made(6, 300))), (6, " ".join(w for x in item for w in (x, "gap"))), (7, " ".join(item + made(7, 30) + item))]
    bench = spark.createDataFrame([(70, " ".join(item)), (71, " ".join(made(8, 10))), (72, None), (73, "too short"), (74, " ".join(item))], "item_id long, text string")
    df = odd.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(df, bench).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 3, 7) for i in (70, 74)}
    assert got[1, 70]["first_word"] == 50 and got[1, 70]["n_words"] == 40 and got[2, 70]["n_equal"] == 37 and got[7, 70]["n_places"] == 2
    # In blocks of one item each, nothing changes.
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, bench, block_bytes=100).collect()} == set(got)
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 4
    assert decontamination.contaminated(empty, bench).count() == 0 == decontamination.contaminated(df, bench.where("false")).count()


def test_every_substitution_of_one_word_is_found():
    item = made(11, 30)
    seeds = decontamination.seeds_of([(1, " ".join(item))])
    for i in range(30):
        changed = [*item[:i], "zzz", *item[i + 1 :]]
        assert decontamination.overlaps([" ".join(changed)], seeds)[0]


def test_every_pattern_of_four_in_five_is_found():
    for n in (8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20):
        item = [f"word{i}" for i in range(n)]
        seeds = decontamination.seeds_of([(1, " ".join(item))])
        for k in range(1, n // 5 + 1):
            spoilt = list(combinations(range(n), k))
            texts = [" ".join("zzz" if i in c else w for i, w in enumerate(item)) for c in spoilt]
            assert not [c for c, hits in zip(spoilt, decontamination.overlaps(texts, seeds), strict=True) if not hits]
    # Less than four in five is not enough.
    assert not decontamination.overlaps([" ".join("zzz" if i % 4 == 3 else f"word{i}" for i in range(13))], decontamination.seeds_of([(1, " ".join(f"word{i}" for i in range(13)))]))[0]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert bands * rows <= 150 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_ngram_join_against_all_pairs(spark, odd, empty):
    rng = random.Random(4)
    docs = []
    for g in range(12):
        first = made(100 + g, rng.randint(30, 90))
        for _ in range(rng.choice([1, 2, 3, 40])):
            words = list(first)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 5)}"
            docs.append((len(docs) + 1000, " ".join(words)))
    df = odd.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(i, t) for i, t in [*ODD, *docs]]
    sets = [set(ngram_join.shingles(t or "").tolist()) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    want = sorted(([d, min((x for x in classes[find(i)] if x is not None), default=None), links[i]] for i, (d, _) in enumerate(rows)), key=repr)
    for block in (200, 7):
        assert by_row(ngram_join.similar(df, block=block).collect(), "class_id", "n_links") == want
    assert ngram_join.similar(empty).count() == 0
    kept = Counter(r["doc_id"] for r in ngram_join.drop_similar(df).collect())
    least = {d if d is None else min((x for x in classes[find(i)] if x is not None), default=None) for i, (d, _) in enumerate(rows)}
    assert set(kept) == least and all(n == 1 for n in kept.values())


def test_ngram_join_of_a_star(spark):
    # 1,000 independent edits of one text, each similar to it and few to each other.
    rng = random.Random(5)
    base = [f"w{rng.randrange(50_000)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    while len(rows) <= 1_000:
        edited = list(base)
        for i in rng.sample(range(200), 4):
            edited[i] = f"x{rng.randrange(1 << 40)}"
        rows.append((len(rows), " ".join(edited)))
    sets = [set(ngram_join.shingles(t).tolist()) for _, t in rows]
    linked = np.array([len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets])
    assert linked.sum() > 900
    for block in (200, 64):
        got = {r["doc_id"]: r for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        lost = [i for i in range(1_001) if linked[i] and got[i]["class_id"] != 0]
        # The bands' recall is 0.999 at the threshold.
        assert len(lost) <= 3 and got[0]["n_links"] >= linked.sum() - 1 - len(lost)


# --- toxicity --------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    random.seed(6)
    terms = ["trash", "pathetic", "worthless", "dolt", "trashy"]
    lexicon = toxicity.Lexicon(terms)
    words = {w for t in terms for _ in range(150) for w in ["".join(c for x in t for c in random.choice([x, x, x, x, "", x + random.choice("ahst"), random.choice("aiost")]))]}
    lexicon.look(words)
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.errors_allowed(t)]
        assert lexicon.found.get(w) == ((min(near)[1], min(near)[0]) if near else None)


def test_context_weighs_hits():
    lexicon = toxicity.Lexicon(["moron"])
    score = lambda t: toxicity.all_features([t], lexicon)[0][1]
    assert score("you are a moron") > score("what a moron") > score("he said that one is a moron") > score('he said "moron" to them') > score("nothing here") == 0
    assert score("what a mor0n") > 0


def test_toxicity_learns_and_holds_out(spark, odd, empty):
    rng = random.Random(8)
    docs = []
    for i in range(600):
        words = made(500 + i, 40)
        if i % 6 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["nasty", "rotten", "horrid"])
        docs.append((i + 100, " ".join(words)))
    train = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if (i - 100) % 6 == 0 else 0) for i, _ in docs] + [(None, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    assert set(model.lexicon) == {"nasty", "rotten", "horrid"}
    got = toxicity.score(train, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == ((r["doc_id"] - 100) % 6 == 0) for r in got)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels)
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}


def test_toxicity_learns_the_terms_of_a_small_language(spark):
    # Toxic texts of a large language, and of a small one, of which the words are in no other's texts.
    rows, marks = [], []
    for i in range(6_000):
        small = i % 25 == 0
        toxic = i % (600 if small else 20) == 0
        rows.append((i, " ".join([f"{'kw' if small else 'w'}{(i * k) % 97}" for k in range(1, 15)] + (["bomenterr" if small else "grunfel"] if toxic else []) + [f"n{i}"])))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert set(model.lexicon) == {"bomenterr", "grunfel"}


# --- randomness tests of the secret scan ------------------------------------------------------------------------------


@pytest.mark.parametrize(("letters", "length"), [("BASE64", 20), ("BASE64_URL", 20), ("HEX_UPPER", 24), ("BASE32", 32)])
def test_nine_in_ten_random_strings_are_found(letters, length):
    """From the shortest length on at which that holds for the encoding."""
    rng, alphabet = random.Random(5), getattr(secrets, letters)
    for n in (length, length + 4, 40, 64):
        texts = ["some words here " + "".join(rng.choice(alphabet) for _ in range(n)) + " and more." for _ in range(300)]
        assert sum(any(k == 3 for _, _, k in secrets.scan(t)) for t in texts) >= 270


def test_p_values_of_random_and_of_written_strings_hold():
    """By brute force: strings drawn at random, and strings drawn by the model of text, reach each p-value as seldom as it says."""
    rng = random.Random(6)
    letters, weights = zip(*secrets.LETTERS.items(), strict=True)

    def written(n, alphabet):
        out, digit = [], rng.random() < 0.5
        for _ in range(n):
            digit ^= rng.random() < secrets.TEXT_CHANGE
            out.append(rng.choice([c for c in alphabet if c.isdigit()]) if digit else rng.choices(letters, weights)[0].upper())
        return "".join(out)

    for alphabet in (secrets.HEX_UPPER, secrets.BASE32, secrets.BASE64):
        p = [secrets.battery("".join(rng.choice(alphabet) for _ in range(32)))["random"] for _ in range(2_000)]
        assert all(sum(x <= a for x in p) <= 1.6 * a * len(p) + 5 for a in (0.1, 0.01, 0.001))
    p = [secrets.battery(t)["written"] for t in (written(32, secrets.BASE32) for _ in range(3_000))]
    assert all(sum(x <= a for x in p) <= 1.6 * a * len(p) + 3 for a in (0.05, 0.01, 0.001))
    # Strings that happen to be hex are those of few letters; of all written ones they are a small part.
    found = [secrets.battery(t) for t in (written(24, secrets.HEX_UPPER) for _ in range(20_000))]
    assert sum(r["encoding"] == "hex" and r["written"] <= 0.001 for r in found if r) <= 0.0016 * len(found) + 3


def test_names_numbers_and_dates_are_not_secrets(spark):
    for text in ("INTERNATIONALIZATIONOFTHEWORLD", "CUSTOMERSUPPORTTICKET2024", "MY_LONG_CONSTANT_NAME_IN_CODE", "WINDOWS2000SERVICEPACK4", "DEADBEEFDEADBEEFDEADBEEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "2024/01/01/12/34/56/789012", "a-file-name-of-many-words-v2-final"):
        assert not [s for s in secrets.scan(text) if s[2] == 3], text
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert "random:" not in "".join(r["spans"] for r in secrets.secret_scan(docs).collect())


def test_many_rows_of_one_id_span_several_parts(spark, tmp_path):
    rows = [(7, f"{i:05d} word {i}") for i in range(2_000)] + [(None, f"{i:05d} none") for i in range(1_000)] + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would take so few rows together
    try:
        token_shards.write_shards(df, str(tmp_path / "s"), WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(str(tmp_path / "s"))
    assert parts.select("part").distinct().count() == 4 and max(r["n_ids"] for r in parts.collect()) < 0.6 * sum(r["n_ids"] for r in parts.collect())
    coder = tokenizer(WORD)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n = len(coder.encode(t, add_special_tokens=False).ids) + 1
        want.append((i, at, n))
        at += n
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in token_shards.read_shards(spark, str(tmp_path / "s"), digests=True).collect()), key=lambda r: r[1])
    assert got == want


def test_words_of_context_are_learned_in_any_language(spark):
    """Terms of an invented language stand in toxic texts, and in reports of them that are not toxic."""
    rng = random.Random(4)
    filler = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1_500):
        words = rng.choices(filler, k=30)
        kind = i % 5
        if kind == 0:  # abuse: the term beside a word of address
            words[10:12], toxic = ["schimpfwerk", "deinesgleichen"], 1
        elif kind == 1 and i % 10 == 1:  # a report
            words[10:12], toxic = ["berichtete", "schimpfwerk"], 0
        else:
            toxic = 0
        rows.append((i, " ".join([*words, str(i)])))
        labels.append((i, 1, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, lift=2.0)
    assert "schimpfwerk" in model.lexicon and "deinesgleichen" in model.lexicon + model.raising and model.lowering == ["berichtete"]
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][2] for i in held) >= 0.97 * len(held)
    none = toxicity.fit(docs, marks.where("toxic = 0"), lift=2.0)
    assert none.lexicon == none.lowering == none.raising == []
