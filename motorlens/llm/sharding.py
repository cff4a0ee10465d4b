"""Shuffled shards by a Feistel permutation of global row numbers.

Every row gets a number, a keyed permutation of ``0 .. n-1`` turns it into a place, and
the place gives shard and slot.  Nothing is sorted by a random key, and the place of a
row number (or the row number of a place) is computed without reading any data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value
from motorlens.llm.numbering import global_row_numbers

by_value(__name__)

ROUNDS = 6
ROW_OVERHEAD = 16


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix of whole numbers."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed * 0x9E3779B97F4A7C15 % 2**64)]


def _rounds(x: np.ndarray, side: int, keys: list[int], inverse: bool) -> np.ndarray:
    """One pass of the network over the square of ``side``."""
    left, right = x // side, x % side
    for key in reversed(keys) if inverse else keys:
        if inverse:
            step = (_mixed(left, key) % np.uint64(side)).astype(np.int64)
            left, right = (right - step) % side, left
        else:
            step = (_mixed(right, key) % np.uint64(side)).astype(np.int64)
            left, right = right, (left + step) % side
    return left * side + right


def permute(numbers: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The places of row numbers in a seeded permutation of ``0 .. n-1`` (or, inverse, the other way).

    The network permutes the smallest square that holds ``n`` numbers; results outside
    ``0 .. n-1`` are put through again until they are inside (cycle walking).
    """
    numbers = np.asarray(numbers, dtype=np.int64)
    if len(numbers) and not (0 <= numbers.min() and numbers.max() < n):
        raise ValueError("row numbers must lie in 0 .. n-1")
    side, keys = max(1, math.isqrt(max(n - 1, 0)) + 1), _keys(seed)
    out = _rounds(numbers, side, keys, inverse)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _rounds(out[outside], side, keys, inverse)
        outside = outside[out[outside] >= n]
    return out


def place_of(row_number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permute(np.array([row_number]), n, seed)[0])
    return place % shards, place // shards


def row_number_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that stands in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number)`` of every document.

    The law is ``rows``: shard sizes differ by one row at most, slots have no gaps.  Copies
    of a text are separate rows and are spread like any others, so a large group of
    copies cannot fill a shard.  A null text counts as empty (size 16, checksum 0); null
    ids and repeated rows each get a place of their own; other columns are not used; an
    empty table gives no rows.  The result depends only on the rows, ``shards`` and ``seed``.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    numbered, n = global_row_numbers(rows, "row_number")

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return numbered.withColumn("_place", place("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
