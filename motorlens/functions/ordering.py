"""Positions and running totals inside a key without sorting a whole key in one task.

A plain ``row_number() over (partition by key order by ts)`` puts every row of a
key into one task.  Here a key is cut into time slots first: rows are ranked
inside ``(key, slot)`` and the slot totals, one small row per slot, carry the
running offset.  The result is the same numbers with slots as the parallel unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions.clock import floor_to

SLOT = "_slot"


def _with_slot(df: DataFrame, ts: str, slot: str) -> DataFrame:
    return df.withColumn(SLOT, floor_to(slot, ts))


def _offsets(slotted: DataFrame, keys: list[str], total: Column) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    return (
        slotted.groupBy(*keys, SLOT)
        .agg(total.alias("_total"))
        .select(*keys, SLOT, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )


def position_within(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], into: str, slot: str = "minute"
) -> DataFrame:
    """Add the zero-based position of each row inside its key, in ``(ts, tie)`` order."""
    slotted = _with_slot(df, ts, slot)
    local = Window.partitionBy(*keys, SLOT).orderBy(ts, *tie)
    offsets = _offsets(slotted, keys, F.count(F.lit(1)))
    return (
        slotted.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys + [SLOT])
        .withColumn(into, (F.col("_before") + F.col("_local") - 1).cast("bigint"))
        .drop(SLOT, "_local", "_before")
    )


def running_total(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], value: str, into: str, slot: str = "minute"
) -> DataFrame:
    """Add the running sum of ``value`` inside each key, in ``(ts, tie)`` order."""
    slotted = _with_slot(df, ts, slot)
    local = (
        Window.partitionBy(*keys, SLOT).orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = _offsets(slotted, keys, F.sum(value))
    return (
        slotted.withColumn("_local", F.sum(value).over(local))
        .join(offsets, keys + [SLOT])
        .withColumn(into, F.col("_before") + F.col("_local"))
        .drop(SLOT, "_local", "_before")
    )


def dense_positions(
    df: DataFrame, keys: list[str], position: str, into: str, slot: int = 10_000, parts: int | None = None
) -> DataFrame:
    """Add the zero-based rank of each row inside its key by a whole-number position that may have gaps.

    Slots are ranked in ``parts`` tasks, by default as many as the session's shuffles have.
    """
    slotted = df.withColumn(SLOT, F.floor(F.col(position) / slot))
    local = Window.partitionBy(*keys, SLOT).orderBy(position)
    offsets = _offsets(slotted, keys, F.count(F.lit(1)))
    if parts:
        slotted = slotted.repartition(parts, *keys, SLOT)
    return (
        slotted.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys + [SLOT])
        .withColumn(into, (F.col("_before") + F.col("_local") - 1).cast("bigint"))
        .drop(SLOT, "_local", "_before")
    )
