"""Stored tables that are changed and read in small parts: rollups from changes, pruned upserts, pages by seek.

Layouts follow the questions asked.  Rollups keep mergeable partial aggregates by bucket of
machines, so a batch touches the buckets of its own machines only.  Features lie by day, so
an upsert reads the days of its new rows.  Sorted tables carry a small index of their
parts, so a page reads the parts it lies in, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions.clock import Moment, moment
from motorlens.operators.ingest import WINDOW_KEYS
from motorlens.session import _path, materialise

# folders of a rollup, over which machines are dealt by a hash
BUCKETS = 64
# days that are named one by one in a filter; more are named by their range
MOST_DAYS = 1000


def _exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


# ---- rollups


def partial_sums(readings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, day, equipment_id, hour, n, total, squares, low, high)`` of ``(equipment_id, ts, value)``; empty values count nothing."""
    known = readings.where(F.col("value").isNotNull())
    return known.groupBy("equipment_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).withColumns({
        "bucket": F.pmod(F.xxhash64("equipment_id"), F.lit(buckets)).cast("int"), "day": F.to_date("hour")})


def merged(partials: DataFrame) -> DataFrame:
    """One row per machine from its partial aggregates: readings, mean, deviation, extremes, first and last hour."""
    n, mean = F.sum("n"), F.sum("total") / F.sum("n")
    return partials.groupBy("bucket", "equipment_id").agg(
        n.alias("readings"), mean.alias("mean_rms"),
        F.sqrt(F.greatest(F.sum("squares") / n - mean * mean, F.lit(0.0))).alias("std_rms"),
        F.min("low").alias("min_rms"), F.max("high").alias("max_rms"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


def stored_partials(spark: SparkSession, store: str, schema: str, since: Moment | None = None) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{store}/partials")
    return rows if since is None else rows.where((F.col("day") >= moment(since).cast("date")) & (F.col("hour") >= moment(since)))


def refresh_changed(
    spark: SparkSession, store: str, readings: DataFrame, batch: int, keep_from: Moment | None = None, kept_before: Moment | None = None,
    buckets: int = BUCKETS,
) -> list[int]:
    """Take new readings into a stored rollup and renew only what they change; returns the buckets that were renewed.

    The batch's partial aggregates are appended in a folder of their own, which a repeated
    batch overwrites.  With ``keep_from`` hours before it are retracted: they no longer
    count, and machines that had some since ``kept_before`` are renewed too.  The summary
    of a renewed bucket is merged from its partials alone; other buckets are neither read
    nor written.  Late rows need nothing special, as partials of one hour add up.
    """
    fresh = partial_sums(readings, buckets)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields) + ", batch bigint"
    fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket", "day").parquet(f"{store}/partials/batch={batch}")
    own = stored_partials(spark, store, schema).where(F.col("batch") == batch).select("bucket")
    touched = own
    if keep_from is not None:
        gone = stored_partials(spark, store, schema, kept_before).where(
            (F.col("day") <= moment(keep_from).cast("date")) & (F.col("hour") < moment(keep_from))).select("bucket")
        touched = touched.unionByName(gone)
    # at most as many as there are buckets
    numbers = sorted(r["bucket"] for r in touched.distinct().collect())
    if numbers:
        rows = stored_partials(spark, store, schema, keep_from).where(F.col("bucket").isin(numbers))
        summary = materialise(merged(rows))
        # a bucket of which nothing is left goes as well
        for number in set(numbers) - {r["bucket"] for r in summary.select("bucket").distinct().collect()}:
            path, files = _path(spark, f"{store}/summary/bucket={number}")
            files.delete(path, True)
        summary.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{store}/summary")
    return numbers


def stored_summary(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/summary")


# ---- upserts


def upsert_stored(new: DataFrame, path: str, per: str = "day") -> DataFrame:
    """Append to features stored by day (or month) those new windows that are valid and not there yet; returns them.

    Only the folders of the new windows are read, and of them only the columns that tell
    windows apart.  Of equal new windows the one with the smallest id is kept.
    """
    spark = new.sparkSession
    others = [c for c in new.columns if c not in WINDOW_KEYS]
    day = F.to_date(F.date_trunc(per, "window_start"))
    valid = new.where(F.col("window_end") > F.col("window_start"))
    fresh = valid.groupBy(*WINDOW_KEYS).agg(F.min_by(F.struct(*others), "id").alias("_row")).select(*WINDOW_KEYS, "_row.*")
    before: set[str] = set()
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        before = set(stored.inputFiles())
        # the stored keys go to the new windows, whose rows lie by their keys already
        fresh = fresh.join(stored_windows(stored, valid.select(day.alias("date"))), WINDOW_KEYS, "left_anti")
    written = fresh.withColumn("date", day)
    written.repartition("date").write.mode("append").partitionBy("date").parquet(path)
    # read back from its own files, a few for each day, so that it is neither stored twice nor computed again
    files = sorted(set(spark.read.schema(written.schema).parquet(path).inputFiles()) - before)
    if not files:
        return spark.createDataFrame([], fresh.schema)
    return spark.read.schema(written.schema).option("basePath", path).parquet(*files).drop("date").select(*fresh.columns)


def stored_windows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The keys of stored windows on the days of the new ones."""
    span = new.agg(F.min("date").alias("low"), F.max("date").alias("high")).first()
    days = [r["date"] for r in new.select("date").distinct().limit(MOST_DAYS + 1).collect()]
    near = F.col("date").isin(days) if len(days) <= MOST_DAYS else F.col("date").between(F.lit(span["low"]), F.lit(span["high"]))
    return stored.where(near).select(*WINDOW_KEYS)


# ---- pages


def _order(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]


def store_sorted(rows: DataFrame, keys: list[tuple[str, bool]], path: str, parts: int) -> None:
    """Rows in parts that follow each other by ``keys`` (column and whether it falls), and an index of the parts.

    The keys together must be unique and never null.
    """
    split = rows.repartitionByRange(parts, *_order(keys)).withColumn("part", F.spark_partition_id())
    split.sortWithinPartitions(*_order(keys)).write.partitionBy("part").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    record = F.struct(*[c for c, _ in keys])
    up = F.struct(*[_rank(c, down, rows) for c, down in keys])
    index = stored.groupBy("part").agg(F.max_by(record, up).alias("last"), F.count(F.lit(1)).alias("n"))
    index.coalesce(1).write.parquet(f"{path}/index")


def _rank(column: str, down: bool, rows: DataFrame) -> Column:
    """A number or text that rises in the order of a key."""
    if not down:
        return F.col(column)
    kind = rows.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return -F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "string":
        raise ValueError("a text can only rise in a stored order")
    return -F.col(column)


def _beyond(keys: list[tuple[str, bool]], after: dict, of: str = "") -> Column:
    """Whether a row follows another one."""
    found, equal = F.lit(False), F.lit(True)
    for column, down in keys:
        value, own = F.lit(after[column]), F.col(of + column)
        found = found | (equal & (own < value if down else own > value))
        equal = equal & (own == value)
    return found


def parts_after(spark: SparkSession, path: str, keys: list[tuple[str, bool]], after: dict | None, size: int) -> list[int]:
    """The parts in which the page behind a row lies.

    Every part holds a row, so the index gives at most ``size + 1`` of them.
    """
    index = spark.read.parquet(f"{path}/index")
    if after is not None:
        index = index.where(_beyond(keys, after, "last."))
    wanted, seen, first = [], 0, True
    for row in index.orderBy("part").limit(size + 1).select("part", "n").collect():
        wanted.append(row["part"])
        # rows of the first part may lie before the page
        seen += 0 if first and after is not None else row["n"]
        first = False
        if seen >= size:
            break
    return wanted


def page_after(spark: SparkSession, path: str, keys: list[tuple[str, bool]], after: dict | None, size: int) -> DataFrame:
    """The page behind the row ``after`` (the first page without one), read from its own parts alone.

    Nothing before the page is read or sorted, however deep it is.
    """
    wanted = parts_after(spark, path, keys, after, size)
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.where(F.col("part").isin(wanted)) if wanted else rows.limit(0)
    if after is not None:
        rows = rows.where(_beyond(keys, after))
    return rows.drop("part").orderBy(*_order(keys)).limit(size)
