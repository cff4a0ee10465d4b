"""Row numbers and ranks that no single task has to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.session import materialise

# rows that one bucket of a numbering and one slice of a key hold on average, and buckets summed together on the first level
BUCKET_ROWS = 4096
SLICE_ROWS = 256
BUCKETS_TOGETHER = 1024
# equal rows expanded from one array
EXPANDED = 4096


def buckets_for(rows: Column, size: int = BUCKET_ROWS) -> Column:
    """How many buckets of ``size`` rows so many rows are dealt over."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("bigint")


def offsets(counts: DataFrame, bucket: str, total: str, into: str) -> DataFrame:
    """``(bucket, into)``: what the buckets before each one hold together.

    Sums on two levels, so that the table ordered in one task has a row for every
    ``BUCKETS_TOGETHER`` buckets.
    """
    placed = counts.withColumn("_high", F.floor(F.col(bucket) / BUCKETS_TOGETHER))
    within = Window.partitionBy("_high").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
    high = placed.groupBy("_high").agg(F.sum(total).alias("_sum"))
    high = high.select("_high", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"))
    inner = placed.select(bucket, "_high", F.coalesce(F.sum(total).over(within), F.lit(0)).alias("_inner"))
    return inner.join(high, "_high").select(bucket, (F.col("_start") + F.col("_inner")).cast("bigint").alias(into))


def global_row_numbers(rows: DataFrame, into: str) -> tuple[DataFrame, int]:
    """The rows with their number from 0 in the order of (hash bucket, columns), and how many there are.

    The number depends only on the rows themselves, not on files or partitions.  Equal
    rows are counted before they are dealt out and take consecutive numbers.
    """
    columns = rows.columns
    counted = materialise(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")))
    total = counted.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    bucketed = counted.withColumn("_bucket", F.pmod(F.xxhash64(*columns), buckets_for(F.lit(total))))
    starts = offsets(bucketed.groupBy("_bucket").agg(F.sum("_copies").alias("_n")), "_bucket", "_n", "_start")
    earlier = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("_before", F.coalesce(F.sum("_copies").over(earlier), F.lit(0)))
    numbered = ranked.join(starts, "_bucket").withColumn("_first", F.col("_start") + F.col("_before"))
    # expanded in two steps, so that no array grows with the number of equal rows
    parts = numbered.withColumn("_part", F.explode(F.expr(f"sequence(0L, _copies - 1, {EXPANDED}L)")))
    each = parts.withColumn("_i", F.explode(F.expr(f"sequence(_part, least(_part + {EXPANDED - 1}L, _copies - 1))")))
    return each.select(*columns, (F.col("_first") + F.col("_i")).cast("bigint").alias(into)), int(total)


def first_of_each(rows: DataFrame, keys: list[str], order: Column, count: str, wanted: str, into: str) -> DataFrame:
    """Mark the first ``wanted`` rows of every key in the order of a hash, with ``count`` rows in the key.

    A key is cut by the hash into buckets of about ``SLICE_ROWS`` rows.  Buckets wholly
    before or after the cut are known from their counts, only rows of one bucket meet.
    """
    width = F.lit(2.0**32) / buckets_for(F.col(count), SLICE_ROWS)
    hashed = rows.withColumn("_order", order)
    bucketed = hashed.withColumn("_bucket", F.floor(F.shiftrightunsigned("_order", 32) / width))
    per_key = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(per_key), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy("_order", *[c for c in rows.columns if c not in keys])
    return (
        bucketed.join(before.hint("merge"), [*keys, "_bucket"])
        .withColumn(into, F.col("_before") + F.row_number().over(local) <= F.col(wanted))
        .drop("_order", "_bucket", "_before")
    )
