"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_forecasts(
    forecasts: DataFrame, summary: DataFrame, path: str, buckets: int = 64, per_machine: bool = False, writers: int = 1
) -> None:
    """Forecasts as JSON lines, each naming its machine, and the fleet summary beside them.

    Machines are spread over a fixed number of folders, so that the number of files
    does not follow the size of the fleet; ``writers`` tasks share a folder, and
    ``per_machine`` gives each machine its own.
    """
    target = path.rstrip("/")
    if per_machine:
        by_machine = forecasts.repartition("equipment_id")
        by_machine.write.mode("overwrite").partitionBy("equipment_id").json(f"{target}/forecasts")
    else:
        bucket = F.pmod(F.xxhash64("equipment_id"), F.lit(buckets)).cast("int")
        writer = F.pmod(F.xxhash64("equipment_id", F.lit(1)), F.lit(writers)).cast("int")
        spread = forecasts.withColumn("bucket", bucket).repartition(F.col("bucket"), writer)
        spread.write.mode("overwrite").partitionBy("bucket").json(f"{target}/forecasts")
    summary.write.mode("overwrite").json(f"{target}/summary")


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Any result as CSV with a header, or as JSON lines; nested columns become JSON text in CSV."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    if kind != "csv":
        raise ValueError(f"unknown export format {kind!r}")
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
