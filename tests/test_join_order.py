"""Wide rows meet the other tables once, short series and stored windows drop out early."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS
from motorlens.operators import forecast as P
from motorlens.operators import matrix as M
from motorlens.operators import reports as R
from motorlens.operators import stores as W

START = datetime(2024, 1, 1)


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def optimised(df):
    return list(nodes(df._jdf.queryExecution().optimizedPlan()))


def joins_with(df, column):
    return sum(n.nodeName() == "Join" and f"{column}#" in n.output().toString() for n in optimised(df))


def semi_joins_below(df, kind):
    return max(sum("LeftSemi" in m.toString().split("\n")[0] for m in nodes(n)) for n in optimised(df) if n.nodeName() == kind)


@pytest.fixture
def frames(spark):
    signals = spark.createDataFrame([(i, i % 3, START) for i in range(6)], "id bigint, equipment_id bigint, recorded_at timestamp_ntz")
    equipment = spark.createDataFrame([(i, f"c{i}", f"n{i}") for i in range(3)], "id bigint, equipment_code string, name string")
    start = (F.lit(START).cast("timestamp_ntz") + F.make_interval(hours=F.col("id"))).cast("timestamp_ntz")
    features = spark.range(60).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 6).alias("raw_id"), start.alias("window_start"), start.alias("window_end"),
        start.alias("created_at"), *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(FEATURE_COLUMNS)])
    return features, signals, equipment


def test_features_meet_other_tables_once(frames):
    features, signals, equipment = frames
    found = R.features_analysis(features, signals, equipment)
    assert found.count() == 60 and joins_with(found, "rms_a") == 1
    rows = M.training_frame(features, signals, equipment, min_rows=1)
    assert rows.count() == 60 and joins_with(rows, "rms_a") == 1
    assert rows.columns == ["equipment_id", "raw_id", *[c for c in features.columns if c != "raw_id"], "equipment_name"]
    with pytest.raises(ValueError):
        M.training_frame(features, signals, equipment, limit=5, min_rows=6)


def test_predictions_meet_other_tables_twice(spark, frames):
    features, signals, equipment = frames
    predictions = features.select(
        F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("feature_id"), F.lit(1).alias("defect_type_id"), F.lit(0.5).alias("probability"),
        F.lit("low").alias("predicted_severity"), F.col("rms_a").alias("confidence"), F.lit("m").alias("model_name"), F.lit("v").alias("model_version"),
        (F.col("rms_a") > 30).alias("anomaly_detected"), "created_at")
    defects = spark.createDataFrame([(1, "d", "e", "f")], "id int, code string, name string, category string")
    found = R.predictions_detailed(predictions, features, signals, equipment, defects)
    assert found.count() == 60 and joins_with(found, "confidence") == 2
    report = R.diagnostic_report_rows(equipment, signals, features, R.locate_predictions(predictions, features, signals))
    assert {r["equipment_id"]: (r["raw_id"], r["rms_a"]) for r in report.collect()} == {0: (3, 57.0), 1: (4, 58.0), 2: (5, 59.0)}
    # features are reduced to one row a recording before they meet anything
    assert joins_with(report, "rms_a") == 2


@pytest.mark.parametrize("limit", [None, 12])
def test_short_series_drop_out_first(frames, limit):
    features, signals, _ = frames
    few = features.where("raw_id <> 3 OR id < 4")
    readings = P.rms_readings(R.locate_features(few, signals, ["id", "window_start", "rms_a", "rms_b", "rms_c"]))
    series = P.rms_series(readings, limit=limit, min_points=12)
    n = 20 if limit is None else limit
    assert {tuple(r) for r in series.groupBy("equipment_id", "phase").count().collect()} == {(m, p, n) for m in (1, 2) for p in "abc"}
    assert semi_joins_below(series, "Generate") >= 1
    if limit is not None:
        assert semi_joins_below(series, "Window") >= 2
        assert P.rms_series(readings, limit=11, min_points=12).count() == 0


def test_new_windows_are_stored_once(spark, frames, monkeypatch, tmp_path):
    features, _, _ = frames
    rows = features.select("id", "raw_id", "window_start", (F.col("window_start") + F.expr("interval 1 hour")).alias("window_end"), "rms_a")
    monkeypatch.setattr(W, "materialise", lambda df: pytest.fail("stored twice"))
    path = str(tmp_path / "features")
    first = W.upsert_stored(rows.where("rms_a < 40"), path)
    second = W.upsert_stored(rows, path)
    third = W.upsert_stored(rows, path)
    assert (first.count(), second.count(), third.count()) == (40, 20, 0) and spark.read.parquet(path).count() == 60
    assert {r["rms_a"] for r in second.collect()} == set(map(float, range(40, 60))) and set(second.columns) == set(rows.columns)
