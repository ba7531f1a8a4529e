"""Keyed hashes that rank documents independently of read order and machine.

Two hashers, never mixed in one ranking: ``rank_hash`` stays in generated code and has a twin in any SQL engine;
``keyed_hash`` is the published BLAKE2b form. Both give hex text, which sorts as the unsigned number does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.session import ship


def seeded_key(name: str, seed: int) -> str:
    return f"{name}:{seed}"


def rank_hash(key: str, id_col: str | Column) -> Column:
    """SHA-256 hex of ``key:id``; null for a null id."""
    return F.sha2(F.concat(F.lit(f"{key}:"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")), 256)


def blake_hash(value: str, key: str) -> int:
    """The first 8 bytes, big-endian, of 128-bit BLAKE2b keyed with ``key``."""
    return int.from_bytes(hashlib.blake2b(value.encode(), key=key.encode(), digest_size=16).digest()[:8], "big")


def keyed_hash(key: str, id_col: str, spark=None) -> Column:
    """``blake_hash`` as 16 hex digits, in Arrow batches."""
    if spark is not None:
        ship(spark)

    @F.pandas_udf("string")
    def hashed(ids: pd.Series) -> pd.Series:
        secret = key.encode()
        return ids.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), key=secret, digest_size=16).hexdigest()[:16])

    return hashed(F.col(id_col).cast("string"))


def unsigned(hex16: Column) -> Column:
    """16 hex digits as decimal(20,0), the only Spark type that holds every unsigned 64-bit number."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 mixer, wrapping around at 64 bits."""
    # The increment and multipliers of splitmix64.
    step, first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + step
        for shift, factor in ((30, first), (27, second)):
            z = (z ^ z >> np.uint64(shift)) * factor
        return z ^ z >> np.uint64(31)


def training_order(hex16_col: str, seed: int, epoch: Column | int = 0, spark=None) -> Column:
    """Hex order key of a document in a pass over the data: its hash mixed with seed and epoch."""
    if spark is not None:
        ship(spark)

    @F.pandas_udf("string")
    def mixed(keys: pd.Series, epochs: pd.Series) -> pd.Series:
        salt = splitmix(splitmix(np.array([seed], np.uint64)) ^ epochs.to_numpy(np.uint64))
        return pd.Series([f"{v:016x}" for v in splitmix(np.array([int(k, 16) for k in keys], np.uint64) ^ salt).tolist()])

    return mixed(F.col(hex16_col), (epoch if isinstance(epoch, Column) else F.lit(epoch)).cast("long"))
