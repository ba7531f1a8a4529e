"""Quality rules whose cutoffs are chosen under a guaranteed limit on false rejections.

A rule rejects a document whose feature exceeds a cutoff. On labelled documents the cutoffs of each rule are tried
from the mildest to the strictest, in each stratum (language) on its own. A cutoff is certified if the exact
binomial bound shows that it rejects at most its share of the allowed rate of good documents. Testing stops at the
first that fails (fixed-sequence testing, which needs no correction along the sequence); over strata and rules the
error level is divided (Bonferroni). The risk is divided over the rules as well, for another reason: a document is
lost if any one rule rejects it, so the rules' rates add up. So with probability 1 - ``level`` no stratum loses more than ``risk`` of its good
documents (those that the fixed base lets pass) to the rules. Among certified cutoffs those count whose
labelled rejections are mostly bad; of these the mildest is taken that still catches 98 % of the strictest's catch.

Copies aren't independent trials: equal texts count once, as good if any copy is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written

#: What all features hang on.
FEATURES = "__quality"
STRATA = ("en", "fr", "de", "es")
SPACES, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"
WINDOW = 5
#: Cutoffs from mild to strict, for rules on shares.
GRID = tuple(round(0.8**i, 6) for i in range(1, 25))

#: Rules by name: a document is rejected if the first count exceeds a cutoff as a share of the second.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouts": ("n_bangs", "n_words"),
    "repeated": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
    "echoes": ("n_echoes", "n_words"),
}


def _occurrences(text: Column, characters: str) -> Column:
    """How often any of these ASCII characters stands in the text."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and a struct of features: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_lines,
    n_echoes (words equal to the one before), text_hash.

    Words that repeat: five-word windows are hashed and sorted by hash; those with an equal neighbour (compared word
    by word) stand in the text twice or more, and the words under them are counted once each.
    """
    name = lambda part: f"{FEATURES}_{part}"
    col = lambda part: F.col(name(part))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*keep, text.alias(name("text")))
    out = out.select(*keep, col("text"), F.filter(F.split(col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias(name("words")), F.filter(F.split(col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(name("lines")))
    at = lambda i: [F.get(col("words"), i + j) for j in range(WINDOW)]
    grams = F.when(F.size(col("words")) < WINDOW, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(col("words")) - WINDOW), lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), i.alias("p"))))
    counted = F.struct(
        F.size(col("words")).cast("long").alias("n_words"),
        (F.char_length(col("text")) - _occurrences(col("text"), SPACES)).cast("long").alias("word_chars"),
        _occurrences(col("text"), SYMBOLS).alias("n_symbols"),
        (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long").alias("n_dup_lines"),
        _occurrences(col("text"), "!").alias("n_bangs"),
        F.size(col("lines")).cast("long").alias("n_lines"),
        F.size(F.filter(col("words"), lambda w, i: w == F.get(col("words"), i - 1))).cast("long").alias("n_echoes"),
        F.xxhash64(col("text")).alias("text_hash"),
    )
    out = out.select(*keep, col("words"), counted.alias(name("counted")), F.array_sort(grams).alias(name("grams")))
    window = lambda p: F.slice(col("words"), p + 1, WINDOW)

    def twice(x: Column, i: Column) -> Column:
        same = lambda y: (y["h"] == x["h"]) & (window(y["p"]) == window(x["p"]))
        return same(F.get(col("grams"), i - 1)) | same(F.get(col("grams"), i + 1))

    out = out.select(*keep, col("counted"), F.array_sort(F.transform(F.filter(col("grams"), twice), lambda x: x["p"])).alias(name("places")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(col("places"), start, lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return out.select(*keep, col("counted").withField("n_repeat_words", covered.cast("long")).alias(FEATURES))


def stratum_of(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise(F.lit("other"))


def rule_value(rule: str) -> Column:
    """The feature a rule looks at; 0 where there is nothing to divide by."""
    part, whole = RULES[rule]
    return F.coalesce(F.try_divide(F.col(FEATURES)[part], F.col(FEATURES)[whole]), F.lit(0.0))


def binomial_at_most(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x), exact up to rounding."""
    if x >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(x + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


def choose(counts: dict[int, tuple[int, int]], grid: tuple[float, ...], rate: float, level: float, purity: float) -> float | None:
    """The cutoff of one rule in one stratum. counts: (good, bad) documents by the number of cutoffs that they exceed."""
    n_good = sum(g for g, _ in counts.values())
    if not n_good:
        return None
    pure = []
    for number, cutoff in enumerate(grid, 1):  # the mildest, exceeded by few, is first
        good, bad = (sum(c[i] for k, c in counts.items() if k > len(grid) - number) for i in (0, 1))
        if binomial_at_most(good, n_good, rate) > level:
            break
        if bad and bad >= purity * (good + bad):
            pure.append((cutoff, bad))
    # Of those that catch about as much as the strictest, the mildest.
    return next((cutoff for cutoff, bad in pure if bad >= 0.98 * pure[-1][1]), None)


def fit_cutoffs(features: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", strata: tuple[str, ...] = STRATA, risk: float = 0.02, level: float = 0.05, purity: float = 0.9, grid: tuple[float, ...] = GRID) -> dict[tuple[str, str], float]:
    """The chosen cutoff by (stratum, rule). All labelled documents that pass the base count; what comes to the driver is a table of strata, rules and cutoffs."""
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").alias("__good"))
    held = features.where(~base_failed()).select(F.col(f"`{id_col}`").cast("long").alias("__id"), stratum_of(F.col(f"`{lang_col}`"), strata).alias("__stratum"), F.col(FEATURES)).join(good, "__id")
    exceeded = lambda rule: F.size(F.filter(F.lit(list(grid)), lambda cutoff: rule_value(rule) > cutoff))
    levels = F.array(*[F.struct(F.lit(rule).alias("rule"), exceeded(rule).alias("over")) for rule in RULES])
    once = held.select("__stratum", F.col(f"{FEATURES}.text_hash").alias("__hash"), "__good", levels.alias("__levels")).groupBy("__stratum", "__hash").agg(F.max("__good").alias("__good"), F.max("__levels").alias("__levels"))
    cells = once.select("__stratum", "__good", F.explode("__levels").alias("__level")).groupBy("__stratum", "__level", "__good").agg(F.count("*").alias("__n"))
    counts: dict[tuple[str, str], dict[int, tuple[int, int]]] = {}
    for r in cells.collect():
        cell = counts.setdefault((r["__stratum"], r["__level"]["rule"]), {})
        g, b = cell.get(r["__level"]["over"], (0, 0))
        cell[r["__level"]["over"]] = (g + r["__n"], b) if r["__good"] == 1 else (g, b + r["__n"])
    tests = (len(strata) + 1) * len(RULES)
    found = {key: choose(c, grid, risk / len(RULES), level / tests, purity) for key, c in counts.items()}
    return {k: v for k, v in found.items() if v is not None}


def base_failed() -> Column:
    q = F.col(FEATURES)
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def kept(cutoffs: dict[tuple[str, str], float], lang_col: str = "lang", strata: tuple[str, ...] = STRATA) -> Column:
    stratum = stratum_of(F.col(f"`{lang_col}`"), strata)
    bad = base_failed()
    for (name, rule), cutoff in sorted(cutoffs.items()):
        bad = bad | ((stratum == name) & (rule_value(rule) > cutoff))
    return ~bad


def judge(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words, so it fails the base. A null or unknown language is of the stratum ``other``. Repeated
    rows each get their row, a null id stays null (and has no label), an empty table gives no rows; without labels
    nothing is certified and only the base rejects. Other columns are ignored.
    """
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    features = written(with_features(narrow).select("doc_id", "lang", FEATURES))
    cutoffs = fit_cutoffs(features, labels, **options)
    q = F.col(FEATURES)
    counts = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return features.select("doc_id", *counts, base_failed().alias("base_failed"), kept(cutoffs).alias("kept"))


def quality_filter(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``df``, with its columns, that ``judge`` keeps.

    Null, empty and short texts go, as they fail the base; repeated rows stay or go alike; a null id has no label and
    is judged like others; an empty table stays empty; without labels only the base rejects.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # so that no column clashes with those added here
    id_, text, lang = (names[df.columns.index(c)] for c in (id_col, text_col, lang_col))
    features = written(with_features(df.toDF(*names), text))
    cutoffs = fit_cutoffs(features, labels, id_col=id_, lang_col=lang, **options)
    return features.where(kept(cutoffs, lang)).select(*names).toDF(*df.columns)
