"""Anonymising e-mail addresses and public IPv4 addresses.

Placeholders rotate by occurrence and start anew in each document, which no regular-expression replacement of Spark
can do; so this runs in Arrow batches, and only on texts that hold an ``@`` or a digit with a dot.
"""

from __future__ import annotations

import ipaddress
import re
from itertools import cycle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import white_words
from webloom.session import ship

# The patterns and placeholders of the published corpus filter.
EMAIL = re.compile(
    r"\b[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?|\[(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?|[a-z0-9-]*[a-z0-9]:)])"
)
IPV4 = re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)")
EMAIL_PLACEHOLDERS = ("email@example.com", "firstname.lastname@example.org")
IP_PLACEHOLDERS = ("22.214.171.124", "126.96.36.199", "188.8.131.52", "184.108.40.206", "220.127.116.11", "18.104.22.168")


def public(address: str) -> bool:
    """Whether an IPv4 address is routable world-wide; what isn't an address (leading zeros) isn't."""
    try:
        return ipaddress.ip_address(address).is_global
    except ValueError:
        return False


def anonymise(text: str) -> tuple[str, int, int]:
    """The text, and how many e-mail addresses and public IP addresses were replaced."""
    emails, ips = cycle(EMAIL_PLACEHOLDERS), cycle(IP_PLACEHOLDERS)
    text, n_emails = EMAIL.subn(lambda _: next(emails), text)
    n_ips = sum(public(m[0]) for m in IPV4.finditer(text))
    if n_ips:
        text = IPV4.sub(lambda m: next(ips) if public(m[0]) else m[0], text)
    return text, n_emails, n_ips


def anonymised(text: Column) -> Column:
    """struct<text, emails, ips> of a text column; null stays null."""

    @F.pandas_udf("text string, emails long, ips long")
    def replaced(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if t is None else anonymise(t) for t in texts]
        return pd.DataFrame(rows, columns=["text", "emails", "ips"])

    return replaced(text)


def anonymise_rows(df: DataFrame, needed: Column, *, text_col: str = "text", count_col: str = "token_count") -> DataFrame:
    """Anonymise the rows where ``needed`` holds, recount tokens of those that changed and set ``pii_anonymized``."""
    ship(df.sparkSession)
    suspect = needed & F.col(text_col).rlike(r"@|[0-9]\.[0-9]")
    done = df.withColumn("__pii", anonymised(F.when(suspect, F.col(text_col))))
    changed = F.coalesce(F.col("__pii.emails") + F.col("__pii.ips") > 0, F.lit(False))
    count = F.col(count_col) if count_col in df.columns else F.lit(None).cast("long")
    return done.withColumns(
        {count_col: F.when(changed, white_words(F.col("__pii.text"))).otherwise(count), text_col: F.when(changed, F.col("__pii.text")).otherwise(F.col(text_col)), "pii_anonymized": F.lit(True)}
    ).drop("__pii")
