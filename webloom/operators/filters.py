"""The corpus filter recipe as expressions, and the audit of what each stage removes.

URL, language, repetition, quality, line clean-up (which edits the text that later stages see), then line statistics.
The thresholds are the published ones of those filter families, all parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.languages import LanguageModel, language
from webloom.session import ship

STAGES = ("english", "gopher_repetition", "gopher_quality", "c4", "fineweb_quality")
# Common words of which a text should have two, and marks that end a line.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
LINE_ENDS = (".", "!", "?", '"', "'")
# The largest share of a text's characters in its most frequent n-gram, and in repeated n-grams, by n.
TOP_GRAMS = {2: 0.2, 3: 0.18, 4: 0.16}
REPEATED_GRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.1}


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def duplicate_share(items: Column) -> Column:
    """Share of the items that repeat an earlier one."""
    return F.coalesce(F.try_divide(F.size(items) - F.size(F.array_distinct(items)), F.size(items)), F.lit(0.0))


def duplicate_chars(items: Column, text: Column) -> Column:
    """Share of the text's characters in items that repeat an earlier one."""
    chars = lambda a: _total(F.transform(a, lambda x: F.char_length(x)))
    return F.coalesce(F.try_divide(chars(items) - chars(F.array_distinct(items)), F.char_length(text)), F.lit(0.0))


def repeated_grams(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 2 to ``longest`` the places whose n-gram of codes stands elsewhere too, and the number of their n-gram, alike for equal ones.

    An n-gram is the pair of the two (n-1)-grams in it, and can only repeat where both do. So the numbers are exact,
    not hashes, and each n looks at what is left of the one before: of most texts next to nothing.
    """
    number = codes.astype(np.int64)
    places = np.arange(len(codes))
    for n in range(2, longest + 1):
        known = np.full(len(codes) + 1, -1)
        known[places] = number
        places = places[known[places + 1] >= 0]
        pairs = known[places] * (len(codes) + 1) + known[places + 1]
        _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        again = counts[which] > 1 if len(places) else np.zeros(0, bool)
        places, number = places[again], which[again]
        yield n, places, number


def top_share(places: np.ndarray, number: np.ndarray, so_far: np.ndarray, n: int, chars: int) -> float:
    """Share of the text's characters in its most frequent n-gram (the first of equals), spaces within it counted. ``places`` and ``number`` are of the repeated ones, ``so_far`` the words' sizes summed up."""
    if len(so_far) <= n:
        return 0.0
    counts = np.bincount(number) if len(number) else np.ones(1, np.int64)
    most = int(counts.max())
    at = int(places[counts[number] == most][0]) if len(number) else 0
    return float((so_far[at + n] - so_far[at] + n - 1) * most) / chars


def repeated_share(places: np.ndarray, number: np.ndarray, so_far: np.ndarray, n: int, chars: int) -> float:
    """Share of the text's characters in n-grams that stood there before; after one of them the search goes on behind it."""
    seen: set[int] = set()
    total = free = 0
    for at, kind in zip(places.tolist(), number.tolist(), strict=True):
        if at < free:
            continue
        if kind in seen:
            total, free = total + int(so_far[at + n] - so_far[at]), at + n
        seen.add(kind)
    return total / chars


def repeats(text: str, top: dict[int, float] = TOP_GRAMS, repeated: dict[int, float] = REPEATED_GRAMS) -> bool:
    """Whether any n-gram rule finds too much of the text in one n-gram, or in repeated ones."""
    found = text.split()
    numbers: dict[str, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)
    if len(numbers) == len(found) > 20 * max(top, default=1):
        return False  # no word comes twice, and one n-gram is too small a part
    so_far = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    for n, places, number in repeated_grams(codes, max([*top, *repeated], default=1)):
        if n in top and top_share(places, number, so_far, n, len(text)) > top[n]:
            return True
        if n in repeated and repeated_share(places, number, so_far, n, len(text)) > repeated[n]:
            return True
        if not len(places) and n >= max(top, default=0):
            return False  # what is longer repeats no more
    return False


def gram_repetition(text: Column) -> Column:
    """``repeats`` in Arrow batches; null for null. It counts as not deterministic, so that no filter is pushed below it and makes Spark split texts twice."""

    @F.pandas_udf("boolean")
    def tested(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repeats(t)).astype(object)

    return tested.asNondeterministic()(text)


def line_repetition_ok(text: Column, rows: Column, paragraphs: Column, most_lines: float = 0.3, most_paragraphs: float = 0.3, most_chars: float = 0.2) -> Column:
    return (duplicate_share(rows) <= most_lines) & (duplicate_share(paragraphs) <= most_paragraphs) & (duplicate_chars(rows, text) <= most_chars) & (duplicate_chars(paragraphs, text) <= most_chars)


def quality_ok(text: Column, w: Column, rows: Column, fewest: int = 50, most: int = 100_000, shortest: float = 3, longest: float = 10, symbols: float = 0.1, bullets: float = 0.9, ellipses: float = 0.3, letters: float = 0.8, stop_words: int = 2) -> Column:
    """By the text, its words and its lines."""
    n = F.size(w)
    mean = F.try_divide(_total(F.transform(w, lambda x: F.char_length(x))), n)
    share = lambda test: F.coalesce(F.try_divide(F.size(F.filter(rows, test)), F.size(rows)), F.lit(0.0))
    marks = F.regexp_count(text, F.lit(r"#|\.\.\.|…"))
    return (
        n.between(fewest, most) & mean.between(shortest, longest) & (F.coalesce(F.try_divide(marks, n), F.lit(0.0)) <= symbols) & (share(lambda x: x.rlike(r"^\s*[•*-]")) <= bullets)
        & (share(lambda x: x.rlike(r"(\.\.\.|…)\s*$")) <= ellipses) & (F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.rlike("[A-Za-z]"))), n), F.lit(0.0)) >= letters)
        & (F.size(F.array_intersect(F.transform(w, lambda x: F.lower(x)), F.array(*map(F.lit, STOP_WORDS)))) >= stop_words)
    )


def cleaned_lines(text: Column, fewest_words: int = 3) -> Column:
    """The text without lines of few words, of script notices or of policies."""
    keep = lambda x: (F.regexp_count(x, F.lit(r"\S+")) >= fewest_words) & ~F.lower(x).rlike("javascript|terms of use|privacy policy|cookie policy|uses cookies|use of cookies|use cookies")
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def cleaned_ok(original: Column, cleaned: Column, sentences: int = 5) -> Column:
    return ~F.lower(original).contains("lorem ipsum") & ~original.contains("{") & (F.regexp_count(cleaned, F.lit(r"[.!?](\s|$)")) >= sentences)


def line_statistics_ok(text: Column, rows: Column, punctuated: float = 0.12, short: float = 0.67, short_chars: int = 30, duplicated: float = 0.1) -> Column:
    """By the edited text and its lines."""
    n = F.size(rows)
    ends = F.size(F.filter(rows, lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*LINE_ENDS)))
    few = F.size(F.filter(rows, lambda x: F.char_length(x) < short_chars))
    return (n > 0) & (F.try_divide(ends, n) > punctuated) & (F.try_divide(few, n) < short) & (duplicate_chars(rows, F.replace(text, F.lit("\n"), F.lit(""))) <= duplicated)


def audit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", url_col: str | None = None, blocklist: DataFrame | None = None, model: LanguageModel | None = None, least_score: float = 0.65) -> DataFrame:
    """``df``, a cumulative flag for each stage, removed_at (first stage that fails, that of ``english`` being called language, else null) and the edited text. Null texts fail at the first stage.

    The language is that of ``lang_col``, or with a ``model`` the one it finds in the text with a score of
    ``least_score`` or more. With ``url_col`` and a ``blocklist`` of hosts (column host) a stage ``url_filter`` comes first. Words, lines and
    paragraphs are columns of their own, each made once; n-gram rules are asked only of texts that pass the cheaper
    tests before them.
    """
    stages = STAGES if blocklist is None else ("url_filter", *STAGES)
    keep, text = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{text_col}`")
    if blocklist is not None:
        hosts = blocklist.select(F.lower("host").alias("__host")).distinct().withColumn("__blocked", F.lit(True))
        df = df.withColumn("__host", F.lower(F.try_parse_url(F.col(f"`{url_col}`"), F.lit("HOST")))).join(hosts, "__host", "left")
        passes = F.col("__blocked").isNull().alias("__url")
    else:
        passes = F.lit(True).alias("__url")
    if model is not None:
        found = df.select("*", passes, language(text, model).alias("__language"))
        df, passes = found, F.col("__url")
        english = (F.col("__language.lang") == "en") & (F.col("__language.score") >= least_score)
    else:
        english = F.col(f"`{lang_col}`") == "en"
    split = df.select(*keep, passes, english.alias("__english"), words(text).alias("__words"), lines(text).alias("__lines"), F.filter(F.split(text, r"\n{2,}"), lambda x: F.trim(x) != "").alias("__paragraphs"), cleaned_lines(text).alias("edited"))
    split = split.select(*keep, "edited", "__url", "__english", "__words", "__lines", "__paragraphs", lines(F.col("edited")).alias("__edited_lines"))
    w, rows = F.col("__words"), F.col("__lines")
    tests = {"english": F.col("__english"), "repetition": line_repetition_ok(text, rows, F.col("__paragraphs")), "gopher_quality": quality_ok(text, w, rows), "c4": cleaned_ok(text, F.col("edited")), "fineweb_quality": line_statistics_ok(F.col("edited"), F.col("__edited_lines"))}
    ok = lambda test: F.coalesce(test, F.lit(False)) & text.isNotNull()
    tested = split.select(*keep, "edited", F.struct(F.col("__url").alias("url_filter"), *[ok(t).alias(s) for s, t in tests.items()]).alias("__ok"))
    asked = F.col("__ok.url_filter") & F.col("__ok.english") & F.col("__ok.repetition")
    ship(df.sparkSession)
    known = tested.select(*keep, "edited", "__ok", gram_repetition(F.when(asked, text)).alias("__repeats"))
    passed = {s: F.col(f"__ok.{s}") for s in stages if s != "gopher_repetition"} | {"gopher_repetition": F.col("__ok.repetition") & ~F.coalesce("__repeats", F.lit(False))}
    alive, flags = F.lit(True), []
    for s in stages:
        alive = alive & passed[s]
        flags.append(alive.alias(s))
    removed = F.coalesce(*[F.when(~passed[s], F.lit("language" if s == "english" else s)) for s in stages])
    return known.select(*keep, *flags, removed.alias("removed_at"), "edited")


def apply_filters(df: DataFrame, **columns) -> DataFrame:
    """The documents that pass every stage, with the edited text."""
    kept = audit(df, **columns).where("removed_at is null")
    return kept.withColumn(columns.get("text_col", "text"), F.col("edited")).drop("edited", "removed_at", "url_filter", *STAGES)
