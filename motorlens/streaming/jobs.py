"""Streams over the batch operators.

Every job names its checkpoint folder; micro-batch writers overwrite the folder
of their own batch, so a repeated batch after a failure changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motorlens.functions.shipping import by_value
from motorlens.operators import ingest as I
from motorlens.operators.alerts import SILENT_AFTER_SECONDS
from motorlens.operators.features import extract_features
from motorlens.operators.windows import OVERLAP
from motorlens.functions.ordering import dense_positions
from motorlens.sources.recordings import line_hashes, read_recordings

by_value(__name__)

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LINE_SCHEMA = "file string, line_no bigint, line string"
SEEN_SCHEMA = "file string, length bigint, modified_at timestamp, file_hash string, batch bigint"
# bytes of text whose windows one task holds; a byte takes about 170 bytes of its memory where windows overlap by half
BYTES_OF_PART = 512 * 1024


def watch_files(spark: SparkSession, path: str, glob: str = "*.csv", per_batch: int = 1000) -> DataFrame:
    """New files under a folder as a stream of their names; at most ``per_batch`` in a batch, none is read here."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_batch)
        .load(path)
        .select("path", F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified_at"))
    )


def lines_of(files: DataFrame) -> DataFrame:
    """The lines of the files of one micro-batch, of which there are ``per_batch`` at most."""
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", row["path"]) for row in files.select("path").collect()]
    spark = files.sparkSession
    return read_recordings(spark, paths, "*") if paths else spark.createDataFrame([], LINE_SCHEMA)


def _seen(spark: SparkSession, store: str, batch: int) -> DataFrame:
    """Fingerprints of earlier batches; the folder of the running batch does not count."""
    try:
        stored = spark.read.schema(SEEN_SCHEMA).parquet(store)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SEEN_SCHEMA)
    return stored.where(F.col("batch") < batch)


def new_recordings(files: DataFrame, store: str, batch: int) -> DataFrame:
    """Files of one micro-batch whose content was never loaded; remembers them."""
    spark = files.sparkSession
    hashed = files.select("file", "length", "modified_at").join(line_hashes(lines_of(files)), "file")
    fresh = I.dedup_by_fingerprint(hashed, _seen(spark, store, batch))
    target = f"{store.rstrip('/')}/batch={batch}"
    fresh.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def stream_recordings(files: DataFrame, store: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep one row per distinct file content, exact over all time."""

    def remember(batch: DataFrame, number: int) -> None:
        new_recordings(batch, store, number)

    return _start(files, remember, checkpoint, trigger)


def recording_samples(files: DataFrame, lines: DataFrame, sample_rate: int, parts: int | None = None) -> DataFrame:
    """Recordings as long samples that carry rate and time; one file is one signal.

    ``lines`` are the lines of the files; no row holds more than one of them.  They are
    numbered in ``parts`` tasks.
    """
    data, _ = I.check_header(lines.join(files.select("file"), "file", "left_semi"))
    # numbered again, because blank lines are gone
    numbered = dense_positions(I.parse_rows(data), ["file"], "line_no", "sample_idx", parts=parts)
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("value")) for p in ("a", "b", "c")])
    counts = numbered.groupBy("file").agg(
        F.count(F.lit(1)).alias("samples_count"), *[F.count(p).alias(f"_n{p}") for p in ("a", "b", "c")]
    )
    times = files.select("file", F.col("modified_at").cast("timestamp_ntz").alias("recorded_at"))
    long = numbered.join(counts, "file").join(times, "file").select(
        F.col("file").alias("signal_id"), "recorded_at", F.lit(sample_rate).alias("sample_rate_hz"), "samples_count",
        "_na", "_nb", "_nc", "sample_idx", F.inline(phases),
    )
    present = F.when(F.col("phase") == "a", F.col("_na")).when(F.col("phase") == "b", F.col("_nb")).otherwise(F.col("_nc"))
    return long.where(present > 0).drop("_na", "_nb", "_nc")


def stream_features(
    files: DataFrame, store: str, target: str, checkpoint: str, sample_rate: int, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Features of every new recording.  Windows never span files, so the stream keeps no state.

    The bytes of a batch's new files say how many tasks share its samples, so a task holds
    no more of them when files are larger or more.
    """
    size, hop = options.get("size"), options.get("hop")
    copies = size / hop if size and hop else 1 / (1 - options.get("overlap", OVERLAP))

    def process(batch: DataFrame, number: int) -> None:
        fresh = new_recordings(batch, store, number)
        length = fresh.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        parts = 1 + int(length * copies / 2) // BYTES_OF_PART
        samples = recording_samples(fresh, lines_of(batch), sample_rate, parts)
        extract_features(samples, parts=parts, **options).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return _start(files, process, checkpoint, trigger)


def _start(
    stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(action)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_hourly_rms(readings: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Hourly mean, minimum and maximum per machine and phase; rows later than the delay are dropped."""
    return (
        readings.where(F.col("value").isNotNull())
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy("equipment_id", "phase", F.window("ts", window).alias("span"))
        .agg(
            F.avg("value").alias("mean_rms"), F.min("value").alias("min_rms"), F.max("value").alias("max_rms"),
            F.count(F.lit(1)).alias("readings"),
        )
        .select(
            "equipment_id", "phase", F.col("span.start").alias("window_start"), "mean_rms", "min_rms", "max_rms", "readings"
        )
    )


def stream_suspicious(
    audit: DataFrame, delay: str = "10 minutes", window: str = "1 hour", slide: str = "5 minutes", attempts: int = 5
) -> DataFrame:
    """Users and addresses with enough failed logins or denials in any sliding window."""
    return (
        audit.where(F.col("action_type").isin("failed_login", "permission_denied"))
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy("user_id", "username", "request_ip", F.window("ts", window, slide).alias("span"))
        .agg(F.count(F.lit(1)).alias("failed_attempts"))
        .where(F.col("failed_attempts") >= attempts)
        .select("user_id", "username", "request_ip", F.col("span.start").alias("window_start"), "failed_attempts")
    )


def stream_silent_machines(
    events: DataFrame, delay: str = "10 minutes", after: int = SILENT_AFTER_SECONDS
) -> DataFrame:
    """A row for every machine whose newest event is ``after`` seconds behind the watermark.

    Each task first reduces its rows to the newest event per machine, so a machine
    that sends most of the data does not send it all to one state task.
    """
    timed = events.select("equipment_id", F.col("ts").cast("timestamp").alias("ts"))

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("equipment_id", as_index=False)["ts"].max()

    def watch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"equipment_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        for batch in rows:
            top = batch["ts"].max().value // 1000
            last = top if last is None else max(last, top)
        if last is None:
            return
        state.update((last,))
        # never set a timer in the past: a row that is already silent fires at the next watermark
        due = max(last // 1000 + after * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(due)

    kind = events.schema["equipment_id"].dataType.simpleString()
    reduced = timed.mapInPandas(newest, f"equipment_id {kind}, ts timestamp").withWatermark("ts", delay)
    return reduced.groupBy("equipment_id").applyInPandasWithState(
        watch, f"equipment_id {kind}, last_seen timestamp", "last_us bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that is available now into a Parquet table and return the table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
