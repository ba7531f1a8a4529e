"""The language of a text by its letters: a naive Bayes model over hashed character trigrams, fitted on labelled documents.

The model is a table of log-probabilities, languages by buckets, so its size is a parameter and doesn't grow with the
corpus. It is fitted on a bounded sample by sums of counts, and scores texts in Arrow batches where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import ship

#: Buckets of trigrams.
BUCKETS = 1 << 15
#: Letters of a text that are scored at a time; memory doesn't grow with the longest text.
AT_ONCE = 1 << 18


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of a lower-cased text, piece by piece; what isn't a letter counts as a blank, several as one."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = np.frombuffer(f" {' '.join(kept.split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    for at in range(0, max(0, len(letters) - 2), AT_ONCE):
        c = letters[at : at + AT_ONCE + 2]
        mixed = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class LanguageModel:
    """``weights``: the logarithm of each bucket's probability by language; ``sharpness``: what the mean over a text's trigrams is multiplied with."""

    languages: list[str]
    weights: np.ndarray
    sharpness: float

    def means(self, text: str | None) -> np.ndarray | None:
        """The mean log-probability of the text's trigrams in each language; None without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for part in trigrams(text or ""):
            total += self.weights[:, part].sum(1)
            n += len(part)
        return total / n if n else None

    def score(self, text: str | None) -> tuple[str | None, float]:
        """The likeliest language and its probability; none and 0 for a text without letters."""
        means = self.means(text)
        if means is None:
            return None, 0.0
        p = np.exp(self.sharpness * (means - means.max()))
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _counts(sample: DataFrame) -> dict[str, np.ndarray]:
    """Trigrams of each language by bucket, summed up where the documents are read first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in trigrams(text):
                    sums[lang] = sums.get(lang, 0) + np.bincount(part, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    out: dict[str, np.ndarray] = {}
    # A row for each language and bucket at most.
    for r in sample.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return out


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most: int = 20_000, smoothing: float = 0.5, seed: int = 3) -> LanguageModel:
    """Fit on about ``most`` of the documents that have a language and a text; one in ten of them sets the sharpness."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))
    other = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(10)) == 0
    counts = _counts(sample.where(~other))
    if not counts:
        raise ValueError("no documents with a language to learn from")
    languages = sorted(counts)
    table = np.stack([counts[x] for x in languages]) + smoothing
    model = LanguageModel(languages, np.log(table / table.sum(1, keepdims=True)), 1.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(languages.index(x), m) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x in languages and (m := model.means(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([m.tolist() for _, m in found], pa.list_(pa.float64()))], ["lang", "means"])

    held = sample.where(other).mapInArrow(measured, "lang int, means array<double>").collect()  # a tenth of a bounded sample
    if held:
        truth, means = np.array([r["lang"] for r in held]), np.array([r["means"] for r in held])

        def loss(sharpness: float) -> float:
            z = sharpness * (means - means.max(1, keepdims=True))
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

        model.sharpness = min((2.0**k for k in range(8)), key=loss)
    return model


def language(text: Column, model: LanguageModel) -> Column:
    """struct<lang, score> of the likeliest language; a text without letters has none and score 0. It counts as not deterministic, so that no filter is pushed below it."""

    @F.pandas_udf("lang string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.score(t) for t in texts], columns=["lang", "score"])

    return scored.asNondeterministic()(text)


def with_language(df: DataFrame, model: LanguageModel, *, text_col: str = "text", name: str = "language") -> DataFrame:
    """``df`` and ``name``, struct<lang, score>."""
    ship(df.sparkSession)
    return df.withColumn(name, language(F.col(f"`{text_col}`"), model))
