"""Documents from extracted texts, and token counts by a vocabulary."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.functions import tokens
from webloom.operators import documents
from webloom.plans import catalog, formats

SCHEMA = "id string, text string, warc_path string, token_count bigint"


def test_short_texts_and_unlisted_files_go(spark):
    raw = spark.createDataFrame([(1, "a b c d e", "f1"), (2, "short", "f1"), (3, None, "f1"), (4, "x y z u v w", "f2"), (5, "one two three", "none")], "id long, text string, file_name string")
    paths = spark.createDataFrame([("b/c/f1",), ("a/c/f1",), ("q/f2",)], ["warc_path"])
    got = sorted(map(tuple, documents.documents_of(raw, paths, SCHEMA, min_chars=6).collect()))
    assert got == [("1", "a b c d e", "a/c/f1", 5), ("4", "x y z u v w", "q/f2", 6)]
    assert documents.documents_of(raw.where("false"), paths, SCHEMA, min_chars=6).collect() == []
    with pytest.raises(ValueError, match="missing"):
        documents.documents_of(raw, paths, SCHEMA + ", url string", min_chars=6)


@pytest.mark.skipif(formats._vocabulary() is None, reason="no vocabulary here")
def test_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(formats._vocabulary())
    plain.encode_special_tokens = True
    texts = [None, "", "Hello  world's <|endoftext|> é😀\n", "word " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", tokens.bpe_tokens(F.col("t"), formats._vocabulary(), at_once=2).alias("n")).collect()}
    assert got == {i: None if t is None else len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"]: r["tokens"] for r in catalog.QUERIES["bpe_token_counts"](spark, folder).collect()} == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}


@pytest.mark.skipif(formats._vocabulary() is None, reason="no vocabulary here")
def test_chunks_of_texts_keep_the_tokens_of_the_library(monkeypatch):
    path = formats._vocabulary()
    plain, r = tokens.coder(path), random.Random(5)
    letters = "  \n\n\t\r\x0b\x0c\x00\x1c\x7f''stredlvmSxé×÷ß15٣½.,!-_|<\"’“…«»слово中文字が́\x85\xa0     　​﻿😀"
    texts = ["".join(r.choices(letters, k=r.randint(0, 16))) for _ in range(20_000)]
    texts += [a + b + c for a in ("a", "1", "!", "é", " ", "'", "\n") for b in letters for c in ("", "b", " b", "\nb", "'s")]
    want = [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "MOST", 500)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 10_000)
    monkeypatch.setattr(tokens, "_KNOWN", {})
    assert tokens.token_counts(pa.array(texts), path).to_pylist() == want
    assert len(tokens._KNOWN[path]) <= 10_000  # what one piece holds at most, beyond the limit
    for some in (["x y", None, "", "z  "], [None, None], ["", ""], []):
        sliced = pa.array(["before", *some, "after"], pa.string()).slice(1, len(some))
        assert tokens.token_counts(sliced, path).to_pylist() == [None if t is None else len(plain.encode(t, add_special_tokens=False).ids) for t in some]


@pytest.mark.skipif(formats._vocabulary() is None, reason="no vocabulary here")
def test_the_library_sees_a_repeated_chunk_once(monkeypatch):
    path, given = formats._vocabulary(), []
    real = tokens.coder(path)

    class Watched:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, strings, **how):
            given.extend(strings)
            return real.encode_batch_fast(strings, **how)

    monkeypatch.setattr(tokens, "_CODERS", {path: Watched()})
    monkeypatch.setattr(tokens, "_KNOWN", {})
    words = ["Stone, ", "river ", "old-fashioned ", "naïve ", "don't\n", "42"]
    r = random.Random(2)
    texts = ["".join(r.choices(words, k=300)) for _ in range(200)]
    assert tokens.token_counts(pa.array(texts), path).to_pylist() == [len(real.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(given) == len(set(given)) < 60 < len(texts)
    long = ["é" * 40] * 3
    for t in long:
        tokens.token_counts(pa.array([t]), path)
    assert given.count(long[0]) == 3 and long[0].encode() not in tokens._KNOWN[path]


def test_vocabularies_with_other_patterns_encode_whole_texts(tmp_path):
    library = pytest.importorskip("tokenizers")
    made = library.Tokenizer(library.models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    made.pre_tokenizer = library.pre_tokenizers.Split(library.Regex("a b"), "isolated")
    made.save(str(tmp_path / "v.json"))
    assert not tokens.cuttable(tokens.coder(str(tmp_path / "v.json")))
    assert tokens.token_counts(pa.array(["xa bx", None, "", "a"]), str(tmp_path / "v.json"), at_once=2).to_pylist() == [3, None, 0, 1]
