"""Series preparation, thresholds and forecasts on series with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorlens.functions.expressions import normal_cdf
from motorlens.operators import forecast as P

START = "2024-01-01 00:00:00"


def hourly(spark, values, phase="a", machine=1):
    rows = [(machine, phase, i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "equipment_id int, phase string, i int, y double")
    start = F.lit(START).cast("timestamp_ntz")
    return df.withColumn("hour", F.timestamp_add("HOUR", F.col("i"), start).cast("timestamp_ntz")).drop("i")


def readings(spark, values):
    return hourly(spark, values).select("equipment_id", "phase", F.col("hour").alias("ts"), F.col("y").alias("value"),
                                        F.monotonically_increasing_id().alias("id"))


def test_too_short_series_is_refused(spark):
    assert P.regularise(readings(spark, range(10))).count() == 0
    _, status = P.forecast_phases(readings(spark, range(10)))
    assert status.first()["status"] == "insufficient data"


def test_empty_hours_are_filled(spark):
    values = [float(i) for i in range(100)]
    holed = readings(spark, values).where("hour(ts) != 7")
    grid = P.regularise(holed).orderBy("hour").collect()
    assert [r["y"] for r in grid] == values


@pytest.mark.parametrize("method,multiplier", [("iqr", 1.5), ("iqr", 3.0), ("zscore", 2.0), ("zscore", 3.0)])
def test_outlier_is_replaced(spark, method, multiplier):
    rng = np.random.default_rng(1)
    values = rng.normal(10, 2, 100)
    values[50] = 1000
    rows = P.replace_outliers(hourly(spark, values), method, multiplier).orderBy("hour").collect()
    assert rows[50]["was_outlier"] and rows[50]["y"] < 100


def test_outlier_edges(spark):
    values = [1000.0] + [10.0 + i % 3 for i in range(60)] + [-1000.0]
    rows = P.replace_outliers(hourly(spark, values)).orderBy("hour").collect()
    assert rows[0]["y"] is None
    assert rows[-1]["y"] == rows[-2]["y"]


def test_random_walk_needs_one_difference(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=400)
    grid = hourly(spark, noise).union(hourly(spark, noise.cumsum(), "b")).union(hourly(spark, noise.cumsum().cumsum(), "c"))
    found = {r["phase"]: r["d"] for r in P.stationarity(grid).collect()}
    assert found == {"a": 0, "b": 1, "c": 2}


def test_autoregression_recovers_its_coefficients(spark):
    rng = np.random.default_rng(3)
    y = np.zeros(3000)
    for t in range(2, 3000):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    fit = P.ar_fit(hourly(spark, y + 20)).first()
    assert fit["d"] == 0 and fit["p"] == 2
    assert abs(fit["phi1"] - 0.6) < 0.05 and abs(fit["phi2"] + 0.3) < 0.05 and abs(fit["sigma"] - 1) < 0.05


def test_constant_series_is_forecast_as_constant(spark):
    rows = P.ar_fleet(hourly(spark, [5.0] * 60), 12).collect()
    assert len(rows) == 12 and all(abs(r["forecast"] - 5) < 1e-9 for r in rows)


@pytest.mark.parametrize("steps", [1, 12, 24, 48])
def test_horizons(spark, steps):
    values = 10 + np.sin(np.arange(100) / 24 * 2 * np.pi)
    for rows in (P.ar_fleet(hourly(spark, values), steps).collect(), P.seasonal_trend_fleet(hourly(spark, values), steps).collect()):
        assert len(rows) == steps
        assert all(r["lower"] <= r["forecast"] <= r["upper"] for r in rows)


@pytest.mark.parametrize("weekly", [False, True])
def test_seasonal_forecast_continues_the_pattern(spark, weekly):
    t = np.arange(24 * 28)
    values = 5 + 0.01 * t + 3 * np.sin(2 * np.pi * t / 24)
    rows = P.seasonal_trend_fleet(hourly(spark, values), 24, weekly).orderBy("step").collect()
    ahead = np.arange(24 * 28, 24 * 29)
    expected = 5 + 0.01 * ahead + 3 * np.sin(2 * np.pi * ahead / 24)
    assert np.allclose([r["forecast"] for r in rows], expected, atol=0.2)


def test_normal_distribution_function(spark):
    points = [-4.0, -1.96, -0.5, 0.0, 0.3, 1.0, 2.5]
    rows = spark.createDataFrame([(z,) for z in points], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 2e-7


def test_legacy_band_rule(spark):
    forecast = hourly(spark, [5, 6, 8, 12, 15]).withColumnRenamed("y", "forecast").withColumn("upper", F.col("forecast") + 1)
    stats = spark.createDataFrame([(1, "a", 5.0, 1.0)], "equipment_id int, phase string, mean double, std double")
    row = P.band_exceedance(forecast, stats).first()
    assert abs(row["max_probability"] - 1.0) < 1e-9 and row["any_exceedance"]


def test_zero_width_band(spark):
    forecast = hourly(spark, [1.0, 3.0]).select("equipment_id", "phase", F.col("y").alias("forecast"), F.col("y").alias("lower"), F.col("y").alias("upper"))
    thresholds = spark.createDataFrame([(1, "a", 2.0)], "equipment_id int, phase string, threshold double")
    row = P.exceedance_probability(forecast, thresholds).first()
    assert row["max_probability"] == 1.0 and row["mean_probability"] == 0.5


@pytest.mark.parametrize("p,advice,status", [(0.9, "critical", "critical"), (0.75, "high", "high risk"), (0.55, "medium", "medium risk"),
                                             (0.3, "low", "medium risk"), (0.1, "normal", "low risk"), (0.05, "normal", "normal")])
def test_bands(spark, p, advice, status):
    row = spark.range(1).select(P.recommendation(F.lit(p)).alias("a"), P.quick_status(F.lit(p)).alias("s")).first()
    assert (row["a"], row["s"]) == (advice, status)


def test_simple_forecast_over_150_hours(spark):
    rng = np.random.default_rng(6)
    values = 10 + 0.01 * np.arange(150) + rng.normal(0, 0.05, 150)
    features = hourly(spark, values).select(
        "equipment_id", F.col("hour").alias("window_start"), F.col("y").alias("rms_a"),
        F.lit(None).cast("double").alias("rms_b"), F.lit(None).cast("double").alias("rms_c"),
    )
    series = P.hourly_rms(features)
    assert series.count() == 150
    rows = P.moving_average_forecast(series, ["equipment_id"]).orderBy("step").collect()
    tail = values[-12:]
    assert np.allclose([r["forecast"] for r in rows], tail.mean() + (tail[-1] - tail[0]) / 11 * np.arange(1, 25))
