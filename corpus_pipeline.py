"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, then byte-level BPE.

Each stage works on what the one before has kept. ``run`` writes every stage's documents to the cluster's shared
folder and reads them again for the next.
"""

from __future__ import annotations

import weakref
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import bpe_codec, decontamination, ngram_join, quality, secrets
from webloom.llm.common import discard, table, tables_made, tokenizer_path, written

#: The stages' results so far, and the tables they read.
_RESULTS: list[tuple[weakref.ref, list[str]]] = []


def stage(f):
    """A stage whose tables go when a later stage starts and nobody holds its result any more.

    By then the result has been written, as ``run`` does it, or given up. A result holds the documents it was made
    of, so results chained without being written stay whole; so does the one of a stage that is called again. Who
    derives a DataFrame from a result and reads it later has to keep the result.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for entry in [e for e in _RESULTS if e[0]() is None]:
            _RESULTS.remove(entry)
            discard(spark, entry[1])
        with tables_made() as left:
            out = f(spark, docs, sf_dir)
        out = out.select("*")  # an object of its own
        out.made_of = docs
        _RESULTS.append((weakref.ref(out), left))
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a certified rule go: those of null or empty text too. Repeated rows go or stay alike, a null id stays, an empty table stays empty."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of the lowest id stays. Null ids and texts without words stay, rows of one id and text leave one, an empty table stays empty."""
    return ngram_join.drop_similar(docs, n=5, threshold=0.8)


@stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts and null ids stay, repeated rows go or stay alike, an empty table stays empty."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; the secrets in them are replaced and n_chars, if it is there, counted again. Null and empty texts, null ids, repeated rows and an empty table stay as they are."""
    return secrets.redact(docs)


@stage
def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the final texts. A null text counts as empty, repeated rows each get their row, a null id stays null, an empty table gives no rows."""
    return bpe_codec.encode_decode_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_spans),
    ("BPE encoding and decoding", bpe_tokens),
]

#: The stages' methods (certified cutoffs, MinHash, spaced seeds, randomness tests, a BPE vocabulary) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, function in STAGES:
        kept = function(spark, docs, sf_dir)
        with tables_made() as path:
            docs = written(kept)
        del kept
        discard(spark, before)
        before = path
    return docs
