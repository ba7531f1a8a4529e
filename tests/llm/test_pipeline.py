"""The pipeline's stages on odd rows, against plain versions, and when called twice."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from webloom.llm import decontamination, ngram_join, secrets  # noqa: E402
from webloom.llm.common import tokenizer, tokenizer_path  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randint(0, 900)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    items = [(k, sentence(rng, 25)) for k in range(3)]
    texts = [sentence(rng, rng.randint(30, 90)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[2] + " extra", None, "", " \n ", "too short", "again and again and so on " * 30, sentence(rng, 20_000)]
    texts += [f"{sentence(rng, 40)} {items[0][1]} {sentence(rng, 5)}", f"{sentence(rng, 30)} password = Zx81kQp03LmnB7 {sentence(rng, 9)}", "AKIA" + "ABCDEFGHIJKLMNOP" + " " + sentence(rng, 30)]
    rows = [(i, t, rng.choice(["en", "de", None]), f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], "en", None, 1), (None, sentence(rng, 50), "en", None, 2), (7, sentence(rng, 60), "fr", "other", 3)]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def base_passes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)


def plain(rows, items):
    """All stages, document by document; three labels certify no rule."""
    rows = [r for r in rows if base_passes(r[1])]
    sets = [set(ngram_join.shingles(r[1]).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    kept, seen = [], set()
    for i, r in enumerate(rows):
        if r[0] is None or r[0] == least[find(i)] and (r[0], r[1]) not in seen:
            kept.append(r)
            seen.add((r[0], r[1]))
    seeds = decontamination.seeds_of(items)
    kept = [r for r in kept if not decontamination.overlaps([r[1]], seeds)[0]]
    return [(r[0], secrets.mask(r[1], secrets.scan(r[1]))) for r in kept]


def test_run_against_a_plain_version(spark, folder):
    rows, items = corpus()
    tok = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, text in plain(rows, items):
        ids = tok.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and 30 < len(got) < len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_called_twice(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("clash") for c in ("__loser", "c0", "words", "label", "set_key", "__quality")})
    a, b = stage(spark, docs, folder), stage(spark, docs, folder)
    rows = sorted(map(repr, a.collect()))
    assert rows == sorted(map(repr, b.collect())) and rows
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert a.columns == docs.columns and a.dtypes == docs.dtypes
    for other in corpus_pipeline.STAGES[1:2]:  # another stage starts; what is held stays readable
        other[1](spark, docs, folder)
    assert sorted(map(repr, a.collect())) == rows
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_results_can_be_chained_without_writing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
    rows, items = corpus()
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted(plain(rows, items), key=repr)
