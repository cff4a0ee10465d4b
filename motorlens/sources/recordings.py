"""Reading three-phase recordings: text files, fingerprints and stored blobs."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value
from motorlens.session import materialise

by_value(__name__)

# lines that are hashed together for a fingerprint
BLOCK_LINES = 1_000


def read_recordings(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """``(file, line_no, line)`` with the true zero-based line number inside each file.

    Files are read as splittable text.  Spark hands out increasing ids inside a
    split, so a line's number is its distance from the first id of its split plus
    the lines of the file's earlier splits; one small row per split carries that,
    and neither a file nor its lines are sorted.  These rows are stored first, so that
    their size is known and they are broadcast to the lines unless they are many.
    """
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_id"),
            F.col("value").alias("line"),
        )
    )
    splits = lines.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(splits.select(
        "file", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    ))
    return lines.join(starts, ["file", "_split"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "line"
    )


def line_hashes(lines: DataFrame) -> DataFrame:
    """``(file, file_hash)`` of ``(file, line_no, line)``: SHA-256 over the hashes of its blocks of ``BLOCK_LINES`` lines.

    A block is the largest piece that one row holds; the hash does not depend on how files
    are split or how their lines end.
    """
    in_order = lambda place, value: F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(value).alias("value")))), lambda x: x["value"])
    blocks = lines.groupBy("file", F.floor(F.col("line_no") / BLOCK_LINES).alias("_block")).agg(
        F.sha2(F.array_join(in_order("line_no", "line"), "\n"), 256).alias("_hash"))
    return blocks.groupBy("file").agg(F.sha2(F.array_join(in_order("_block", "_hash"), ""), 256).alias("file_hash"))


def listed_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``(file, length, modified_at)`` of all files, without reading them; Spark does not list files of no bytes."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select(F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified_at"))
    )


def fingerprints(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``(file, length, modified_at, file_hash)`` of files of any size."""
    files = listed_files(spark, path, glob)
    return files.join(line_hashes(read_recordings(spark, path, glob)), "file", "left")


def encode_float32(values: np.ndarray) -> bytes:
    return gzip.compress(np.asarray(values, dtype="<f4").tobytes(), compresslevel=6)


def encode_signal_blobs(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Array columns as gzip float32 blobs, a missing value as NaN."""

    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: None if v is None else encode_float32(v))

    return chunks.select(
        *[pack(F.col(c).cast("array<double>")).alias(c) if c in columns else F.col(c) for c in chunks.columns]
    )


def decode_signal_blobs(blobs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Blob columns as ``(keys..., phase, sample_idx, value)`` rows; NaN becomes NULL.

    Blobs are decoded in Arrow batches and unfolded on the JVM side; a blob holds one stored chunk.
    """
    kept = blobs.select(*keys, *columns)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in keys])
    schema += ", " + ", ".join(f"{c} array<float>" for c in columns)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for column in columns:
                batch[column] = [
                    None if blob is None else np.frombuffer(gzip.decompress(blob), dtype="<f4") for blob in batch[column]
                ]
            yield batch

    arrays = kept.mapInPandas(unpack, schema)
    phases = F.array(
        *[F.struct(F.lit(c.removeprefix("phase_")).alias("phase"), F.col(c).alias("values")) for c in columns]
    )
    value = F.col("value").cast("double")
    return (
        arrays.select(*keys, F.inline(phases))
        .select(*keys, "phase", F.posexplode("values").alias("sample_idx", "value"))
        .select(*keys, "phase", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                F.when(~F.isnan(value), value).alias("value"))
    )
