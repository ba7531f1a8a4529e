"""Column functions over texts, paths, months and token arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings of chatbot preambles, and phrases counted as typical of generated text, in their order.
PREAMBLES = ("Sure", "Here", "Abstract", "Title", "I'm happy to help", "Certainly")
PHRASES = (
    "delve", "tapestry", "testament to", "it's important to note", "it is important to note", "in conclusion",
    "moreover", "furthermore", "vibrant", "crucial role", "landscape of", "realm of", "underscores", "showcasing",
    "boasts", "in today's", "navigate the", "unleash", "elevate", "foster", "seamless", "comprehensive guide",
    "game-changer", "ever-evolving", "a beacon of", "not just",
)
WORD_PATTERN = "[A-Za-z]+(?:['’-][A-Za-z]+)?"
PHRASE_PATTERN = "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in PHRASES)


def white_words(text: Column) -> Column:
    """Words between white space, the stand-in for a tokenizer's count."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def letter_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def phrase_hits(text: Column) -> Column:
    """Non-overlapping typical phrases, whatever their case."""
    return F.regexp_count(F.lower(text), F.lit(PHRASE_PATTERN)).cast("long")


def crawl_path(path: Column) -> Column:
    """From the first ``crawl-data/`` on; a path without it stays."""
    at = F.instr(path, "crawl-data/")
    return F.when(at > 0, F.substr(path, at)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def month_of(date: Column) -> Column:
    return F.substring(date, 1, 7)


def month_seed(seed: int, month: Column) -> Column:
    return F.lit(seed) + F.replace(month, F.lit("-"), F.lit("")).cast("long")


def month_index(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("long") * 12 + F.substring(month, 6, 2).cast("long") - 1


def month_label(index: Column) -> Column:
    return F.concat(F.lpad(F.floor(index / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((index % 12 + 1).cast("string"), 2, "0"))


def quarter_of(month: Column) -> Column:
    return F.concat(F.substring(month, 1, 4), F.lit("Q"), F.ceil(F.substring(month, 6, 2).cast("int") / 3).cast("string"))


def crawl_year(dump: Column) -> Column:
    return F.get(F.split(dump, "-"), 2)


def billable_units(text: Column, words_per_unit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(white_words(text) / words_per_unit)).cast("long")


#: What is taken for an emoji: pictographs beyond the basic plane, dingbats and symbols, with their variation mark.
EMOJI = "[\U0001F1E6-\U0001FAFF\u2600-\u27BF\u2B50\u2B55\u231A\u231B\u23E9-\u23F3]\ufe0f?"


def emoji_named(value: str) -> str:
    """Each emoji as its Unicode name between colons, in lower case with underscores."""
    return re.sub(EMOJI, lambda m: f":{unicodedata.name(m[0][0], 'emoji').lower().replace(' ', '_').replace('-', '_')}:", value)


def emoji_to_text(text: Column) -> Column:
    """``emoji_named`` in Arrow batches, only of texts that hold an emoji."""

    @F.pandas_udf("string")
    def named(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else emoji_named(t))

    has = text.rlike(r"[\x{1F1E6}-\x{1FAFF}\u2600-\u27BF\u2B50\u2B55\u231A\u231B\u23E9-\u23F3]")
    return F.when(has, named(F.when(has, text))).otherwise(text)


def without_preamble(text: Column) -> Column:
    """The text without its first line that isn't blank, if there are others and it opens like a chatbot's reply; blank lines go with it."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    first = F.regexp_replace(F.regexp_replace(F.get(lines, 0), r"^[^a-zA-Z0-9]*", ""), r"[\x{1F1E6}-\x{1FAFF}\u2600-\u27BF]", "")
    opens = first.rlike("^(?:" + "|".join(PREAMBLES) + ")")
    return F.when((F.size(lines) >= 2) & opens, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")).otherwise(text)


def cleaned_text(text: Column) -> Column:
    """The input of a label model: emoji named, what follows a reasoning block, no preamble, lower case, single spaces."""
    text = emoji_to_text(text)
    parts = F.split(text, "</think>")
    after = F.when(F.size(parts) > 1, F.trim(F.get(parts, 1))).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(without_preamble(after)), r"\s+", " "))


def picked_windows(tokens: Column, size: int, k: int) -> Column:
    """At most ``k`` evenly spaced ones of the non-overlapping windows of ``size`` tokens, rounding half to even."""

    def pick(t: Column) -> Column:
        n = F.greatest(F.ceil(F.size(t) / size), F.lit(1)).cast("int")
        window = lambda i: F.slice(t, i * size + 1, F.lit(size))
        every = F.sequence(F.lit(0), n - 1)
        some = F.array(F.lit(0)) if k == 1 else F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int")))
        return F.transform(F.when(n <= k, every).otherwise(some), window)

    return bound(tokens, pick)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` has it inside a lambda: there Spark would work out an expression again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def scored_windows(tokens: Column, length: int) -> Column:
    """Windows of ``length`` + 1 tokens at a stride of ``length``, each of two tokens or more."""

    def cut(t: Column) -> Column:
        starts = F.when(F.size(t) >= 2, F.sequence(F.lit(0), F.size(t) - 2, F.lit(length))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(t, s + 1, F.lit(length + 1)))

    return bound(tokens, cut)


def classifier_input(url: Column, text: Column) -> Column:
    return F.concat(url, F.lit("\n\n"), text)
