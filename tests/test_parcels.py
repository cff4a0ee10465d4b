"""Joins of compressed parcels: the rows of plain joins, in a fraction of their shuffled bytes."""

from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motorlens.functions import parcels as P
from motorlens.operators import reports as R

START = datetime(2024, 1, 1)


@pytest.fixture
def frames(spark):
    """Keys that are null, twice there, or without a partner; a third of the predictions have one defect, a third one feature."""
    number = F.col("id")
    start = (F.lit(START).cast("timestamp_ntz") + F.make_interval(hours=number % 50)).cast("timestamp_ntz")
    features = spark.range(2_000).select(
        F.when(number % 97 != 0, F.concat(F.lit("f-"), (number % 1_900).cast("string"))).alias("id"),
        F.when(number % 89 != 0, number % 300).alias("raw_id"), start.alias("window_start"), start.alias("window_end"))
    predictions = spark.range(6_000).select(
        F.concat(F.lit("p-"), number.cast("string")).alias("id"),
        F.when(number % 3 == 1, "f-7").when(number % 83 != 0, F.concat(F.lit("f-"), (number % 2_100).cast("string"))).alias("feature_id"),
        F.when(number % 3 == 0, F.lit(5)).when(number % 79 != 0, number % 400).cast("bigint").alias("defect_type_id"),
        (number % 10 / 10).alias("probability"), F.when(number % 2 == 0, "low").otherwise("").alias("predicted_severity"),
        F.when(number % 7 != 0, number / 3).alias("confidence"), F.lit("m").alias("model_name"), F.lit(None).cast("string").alias("model_version"),
        start.alias("created_at"))
    signals = spark.range(320).select((number % 290).alias("id"), F.when(number % 31 != 0, number % 40).alias("equipment_id"))
    equipment = spark.range(45).select(
        (number % 38).alias("id"), F.concat(F.lit("c"), number.cast("string")).alias("equipment_code"), F.lit("é ü").alias("name"))
    defects = spark.range(330).select(
        F.when(number % 53 != 0, number % 310).alias("id"), F.lit("d").alias("code"), number.cast("string").alias("name"), F.lit(None).cast("string").alias("category"))
    return predictions, features, signals, equipment, defects


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("per_slot", [400, 1_000_000])
def test_packed_joins_equal_plain_joins(spark, frames, monkeypatch, per_slot):
    monkeypatch.setattr(P, "PER_SLOT", per_slot)
    plain, packed = R.predictions_detailed(*frames), R.predictions_detailed(*frames, packed_from=0)
    assert "SortMergeJoin" not in packed._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert packed.dtypes == plain.dtypes
    found = rows(packed)
    assert found == rows(plain) and sum(found.values()) > 5_000
    if per_slot == 400:
        return
    empty = [frames[0], frames[1], frames[2], frames[3], frames[4].where("id < 0")]
    assert rows(R.predictions_detailed(*empty, packed_from=0)) == rows(R.predictions_detailed(*empty))
    assert R.predictions_detailed(frames[0], frames[1].where("id = ''"), *frames[2:], packed_from=0).count() == 0


def test_a_hot_key_is_shared_by_slots(frames):
    predictions = frames[0]
    slots = P.slots_by(predictions, 6_000, "defect_type_id", "id", per_slot=100)
    dealt = predictions.where("defect_type_id = 5").groupBy(slots.one.alias("s")).count().collect()
    assert slots.n > 60 and len(dealt) > 10 and max(r["count"] for r in dealt) < 300
    assert {x for r in predictions.where("defect_type_id = 5").limit(1).select(slots.every.alias("s")).collect() for x in r["s"]} == {r["s"] for r in dealt}


def test_predictions_shuffle_less_than_half(spark):
    """The ids alone, in a plain shuffle, take more than what wide rows take in parcels."""
    ids = spark.range(200_000).select(F.concat_ws("-", "id", F.abs(F.xxhash64("id")), F.abs(F.xxhash64("id", F.lit(1)))).alias("id")).toArrow()
    table = pa.table({"id": ids.column("id"), "feature_id": ids.column("id"), "at": pa.array([10**9 * 3_600 * (i % 24) for i in range(200_000)], pa.timestamp("ns")).cast(pa.timestamp("us"))})
    size = sum(len(P._closed(table.slice(at, 1_000))[1]) for at in range(0, 200_000, 1_000))
    assert size < 0.45 * table.nbytes


@pytest.mark.parametrize("values", [[0], [5, 5], [-(2**63), 2**63 - 1], [3, -9, 12], [7 * 10**15, 9 * 10**15]])
def test_parcels_give_back_their_rows(values):
    n = len(values)
    table = pa.table({
        "a": pa.array(values, pa.int64()), "t": pa.array(values, pa.timestamp("us")), "n": pa.array([None] * n, pa.int64()), "b": pa.array([True] * n),
        "s": pa.array(["", "é"][:n] + ["x" * 300] * (n - 2), pa.string()), "x": pa.array([None] + [0.5] * (n - 1), pa.float64()), "z": pa.array([""] * n)})
    for some in (table, table.slice(n - 1)):
        found = P._opened(*P._closed(some))
        found.validate(full=True)
        assert found.equals(some)
