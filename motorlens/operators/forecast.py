"""Load-trend forecasts for the whole fleet.

A series is one ``(equipment_id, phase)``.  Raw readings are only ever aggregated
(map-side first); ordered logic starts after the hourly grid, where a series has
one row per hour however many readings there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions.clock import Moment, floor_to, moment, seconds_between
from motorlens.functions.expressions import PHASES, banded, mean_of_present, normal_cdf
from motorlens.functions.ordering import position_within
from motorlens.operators.windows import fill_linear
from motorlens.session import materialise

# fixed values of the forecasting
MIN_OBSERVATIONS = 50
HORIZON = 24
THRESHOLD_SIGMA = 1.5
SIMPLE_SIGMA = 2.0
MOVING_WINDOW = 12
OUTLIER_MULTIPLIER = 1.5
Z95 = 1.96
UNIT_ROOT_5_PERCENT = -2.86
CRITICAL_PROBABILITY = 0.7
ADVICE_BANDS = [(0.85, "critical"), (0.7, "high"), (0.5, "medium"), (0.25, "low")]
QUICK_BANDS = [(0.8, "critical"), (0.6, "high risk"), (0.3, "medium risk"), (0.1, "low risk")]
RISK_BANDS = [(0.6, "high"), (0.3, "medium")]

SERIES = ["equipment_id", "phase"]


def _hours_later(start: Column | str, hours: Column) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    return F.timestamp_add("HOUR", hours, start).cast("timestamp_ntz")


def _plus_minus(forecast: Column, sigma: Column) -> list[Column]:
    return [(forecast - Z95 * sigma).alias("lower"), (forecast + Z95 * sigma).alias("upper")]


def rms_readings(located_features: DataFrame) -> DataFrame:
    """Wide feature rows as long readings ``(equipment_id, phase, ts, value, id)`` without gaps."""
    entries = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"rms_{p}").alias("value")) for p in PHASES])
    return located_features.select("equipment_id", F.col("window_start").alias("ts"), "id", F.inline(entries)).where(
        F.col("value").isNotNull()
    )


def rms_series(
    readings: DataFrame, start: Moment | None = None, end: Moment | None = None, limit: int | None = None,
    min_points: int = MIN_OBSERVATIONS,
) -> DataFrame:
    """Readings of every series that has enough of them; with ``limit`` the earliest ones."""
    chosen = readings.where(F.col("value").isNotNull())
    if start is not None:
        chosen = chosen.where(F.col("ts") >= moment(start))
    if end is not None:
        chosen = chosen.where(F.col("ts") <= moment(end))
    if limit is not None:
        # a row without a time has no place among the earliest
        chosen = chosen.where(F.col("ts").isNotNull())
    # the earliest rows are enough of them where all rows are, unless fewer are asked for
    needed = F.col("_n") >= min_points if limit is None or limit >= min_points else F.lit(False)
    enough = chosen.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).where(needed)
    # stored, so that its size is known and a hot series can be split in the join; machines drop out before their rows are made long
    enough = materialise(enough.select(*SERIES))
    chosen = chosen.join(enough.select(SERIES[0]).distinct(), SERIES[0], "left_semi").join(enough, SERIES, "left_semi")
    if limit is None:
        return chosen
    # a series has no bound here, so its rows are numbered slot by slot
    placed = position_within(chosen, SERIES, "ts", ["id"], "_n", slot="hour")
    return placed.where(F.col("_n") < limit).drop("_n")


def hourly_rms(located_features: DataFrame, min_points: int = MIN_OBSERVATIONS) -> DataFrame:
    """Mean over present phases per window, then per hour, for machines with enough windows."""
    rms = mean_of_present([F.col(f"rms_{p}") for p in PHASES])
    hourly = (
        located_features.select("equipment_id", floor_to("hour", "window_start").alias("hour"), rms.alias("y"))
        .groupBy("equipment_id", "hour")
        .agg(F.avg("y").alias("y"), F.count("y").alias("_valid"))
    )
    # valid windows are a subset of all windows, so their gate implies the other one
    machine = Window.partitionBy("equipment_id")
    return (
        hourly.withColumn("_total", F.sum("_valid").over(machine))
        .where((F.col("_total") >= min_points) & (F.col("_valid") > 0))
        .drop("_valid", "_total")
    )


def sigma_threshold(series: DataFrame, keys: list[str], value: str, k: float = SIMPLE_SIGMA) -> DataFrame:
    sigma = F.stddev_pop(value)
    return series.groupBy(*keys).agg(
        F.avg(value).alias("mu"),
        F.when(sigma == 0, F.lit(1e-6)).otherwise(sigma).alias("sigma"),
        F.count(value).alias("history_points"),
    ).withColumn("threshold", F.col("mu") + k * F.col("sigma"))


def moving_average_forecast(
    hourly: DataFrame, keys: list[str], time: str = "hour", value: str = "y", steps: int = HORIZON
) -> DataFrame:
    """Mean of the last hours plus their slope, for the hours after the last one."""
    newest = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    tail = hourly.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= MOVING_WINDOW)
    fit = tail.groupBy(*keys).agg(
        F.avg(value).alias("_level"), F.max_by(value, time).alias("_last"), F.min_by(value, time).alias("_first"),
        F.count(F.lit(1)).alias("_w"), F.max(time).alias("_end"),
    )
    slope = (F.col("_last") - F.col("_first")) / F.greatest(F.col("_w") - 1, F.lit(1))
    return fit.select(*keys, "_level", "_end", slope.alias("_slope"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select(
        *keys, "step", _hours_later("_end", F.col("step")).alias("ts"),
        (F.col("_level") + F.col("_slope") * F.col("step")).alias("forecast"),
    )


def threshold_exceedance(forecast: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Flag per step and the share of steps above the threshold."""
    flagged = forecast.join(thresholds.select(*keys, "threshold"), keys).withColumn(
        "over_threshold", F.col("forecast") > F.col("threshold")
    )
    share = F.avg(F.col("over_threshold").cast("double")).over(Window.partitionBy(*keys))
    return flagged.withColumn("probability_over_threshold", share)


def regularise(readings: DataFrame, min_points: int = MIN_OBSERVATIONS) -> DataFrame:
    """Hourly grid ``(equipment_id, phase, hour, y)``: first of equal times, hourly mean, straight lines over empty hours."""
    single = (
        readings.where(F.col("value").isNotNull())
        .groupBy(*SERIES, "ts")
        .agg(F.min_by("value", "id").alias("value"), F.count(F.lit(1)).alias("_n"))
    )
    hourly = single.groupBy(*SERIES, floor_to("hour", "ts").alias("hour")).agg(
        F.avg("value").alias("y"), F.sum("_n").alias("_n")
    )
    series = Window.partitionBy(*SERIES)
    order = series.orderBy("hour")
    gated = hourly.withColumn("_total", F.sum("_n").over(series)).where(F.col("_total") >= min_points)
    ahead = gated.withColumn("_hour2", F.lead("hour").over(order)).withColumn("_y2", F.lead("y").over(order))
    gap = F.coalesce((seconds_between("hour", "_hour2") / 3600).cast("int"), F.lit(1))
    # each known hour also yields the empty hours up to the next known one
    return (
        ahead.withColumn("_gap", gap)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
        .select(
            *SERIES, _hours_later("hour", F.col("_k")).alias("hour"),
            F.when(F.col("_k") == 0, F.col("y"))
            .otherwise(F.col("y") + (F.col("_y2") - F.col("y")) * F.col("_k") / F.col("_gap"))
            .alias("y"),
        )
    )


def _hour_number(column: str = "hour") -> Column:
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 3600).cast("bigint")


def outlier_bounds(grid: DataFrame, method: str = "iqr", multiplier: float = OUTLIER_MULTIPLIER) -> Column:
    """Condition that marks an outlier of its own series."""
    series = Window.partitionBy(*SERIES)
    y = F.col("y")
    if method == "iqr":
        quartiles = F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).over(series)
        q1, q3 = quartiles[0], quartiles[1]
        return (y < q1 - multiplier * (q3 - q1)) | (y > q3 + multiplier * (q3 - q1))
    if method == "zscore":
        z = F.try_divide(F.abs(y - F.avg("y").over(series)), F.nullif(F.stddev_samp("y").over(series), F.lit(0.0)))
        return F.coalesce(z > multiplier, F.lit(False))
    raise ValueError(f"unknown outlier method {method!r}")


def replace_outliers(grid: DataFrame, method: str = "iqr", multiplier: float = OUTLIER_MULTIPLIER) -> DataFrame:
    """Outliers become the straight line between their neighbours; a leading one stays NULL, a trailing one repeats."""
    marked = grid.withColumn("_out", outlier_bounds(grid, method, multiplier))
    opened = marked.withColumn("y", F.when(~F.col("_out"), F.col("y"))).withColumn("_h", _hour_number())
    filled = fill_linear(opened, SERIES, "_h", "y")
    up = Window.partitionBy(*SERIES).orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filled.withColumn("y", F.coalesce("y", F.last("y", ignorenulls=True).over(up))).withColumnRenamed(
        "_out", "was_outlier"
    ).drop("_h")


def adaptive_threshold(grid: DataFrame, method: str = "statistical", multiplier: float = THRESHOLD_SIGMA) -> DataFrame:
    if method == "statistical":
        threshold = F.avg("y") + multiplier * F.stddev_pop("y")
    elif method == "quantile":
        threshold = F.percentile("y", F.lit(min(0.99, 0.5 + multiplier * 0.3)))
    else:
        raise ValueError(f"unknown threshold method {method!r}")
    return grid.groupBy(*SERIES).agg(threshold.alias("threshold"))


def history_stats(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*SERIES).agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"),
        F.count("y").alias("count"),
    )


def difference(grid: DataFrame, d: int = 1) -> DataFrame:
    """``d`` times the step to the previous hour; the first ``d`` rows of a series go."""
    order = Window.partitionBy(*SERIES).orderBy("hour")
    out = grid
    for _ in range(d):
        out = out.withColumn("y", F.col("y") - F.lag("y").over(order)).where(F.col("y").isNotNull())
    return out


def _with_differences(grid: DataFrame) -> DataFrame:
    order = Window.partitionBy(*SERIES).orderBy("hour")
    known = grid.where(F.col("y").isNotNull())
    step = lambda column: F.col(column) - F.lag(column).over(order)
    return known.withColumn("d0", F.col("y")).withColumn("d1", step("d0")).withColumn("d2", step("d1"))


def _unit_root_statistic(change: Column, level: Column) -> Column:
    slope = F.regr_slope(change, level)
    sxx = F.regr_sxx(change, level)
    residual = F.regr_syy(change, level) - slope * slope * sxx
    n = F.regr_count(change, level)
    error = F.sqrt(F.greatest(residual, F.lit(0.0)) / F.nullif(n - 2, F.lit(0)) / F.nullif(sxx, F.lit(0.0)))
    return F.try_divide(slope, F.nullif(error, F.lit(0.0)))


def stationarity(grid: DataFrame) -> DataFrame:
    """Unit-root statistic of each series and of its first two differences, and the order that makes it stationary."""
    order = Window.partitionBy(*SERIES).orderBy("hour")
    diffs = _with_differences(grid)
    for i in range(3):
        diffs = diffs.withColumn(f"l{i}", F.lag(f"d{i}").over(order))
    tests = diffs.groupBy(*SERIES).agg(
        *[_unit_root_statistic(F.col(f"d{i}") - F.col(f"l{i}"), F.col(f"l{i}")).alias(f"statistic_{i}") for i in range(3)]
    )
    chosen = F.when(F.col("statistic_0") < UNIT_ROOT_5_PERCENT, 0).when(F.col("statistic_1") < UNIT_ROOT_5_PERCENT, 1)
    return tests.withColumn("is_stationary", F.coalesce(F.col("statistic_0") < UNIT_ROOT_5_PERCENT, F.lit(False))).withColumn(
        "d", chosen.otherwise(2)
    )


def ar_fit(grid: DataFrame, order: tuple[int, int] | None = None) -> DataFrame:
    """Autoregression of order 0..2 on the differenced series, chosen by AIC, for every series in one aggregation.

    Coefficients solve the two-lag normal equations in closed form.  ``order=(p, d)`` fixes the model.
    """
    by = Window.partitionBy(*SERIES).orderBy("hour")
    known = _with_differences(grid)
    if order is None:
        known = known.join(stationarity(grid).select(*SERIES, "d"), SERIES)
    else:
        known = known.withColumn("d", F.lit(order[1]))
    z = F.when(F.col("d") == 0, F.col("d0")).when(F.col("d") == 1, F.col("d1")).otherwise(F.col("d2"))
    series = known.withColumn("z", z).where(F.col("z").isNotNull())
    centre = F.when(F.col("d") == 0, F.avg("z").over(Window.partitionBy(*SERIES))).otherwise(F.lit(0.0))
    centred = (
        series.withColumn("mu", centre)
        .withColumn("x0", F.col("z") - F.col("mu"))
        .withColumn("x1", F.lag("x0", 1).over(by))
        .withColumn("x2", F.lag("x0", 2).over(by))
    )
    both = F.col("x2").isNotNull()

    def product(i: int, j: int) -> Column:
        return F.sum(F.when(both, F.col(f"x{i}") * F.col(f"x{j}"))).alias(f"s{i}{j}")

    sums = centred.groupBy(*SERIES, "d", "mu").agg(
        *[product(i, j) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))],
        F.count(F.when(both, 1)).alias("n"),
        F.max("hour").alias("end"),
        F.count(F.lit(1)).alias("points"),
    )
    s = {name: F.col(name) for name in ("s00", "s01", "s02", "s11", "s12", "s22")}
    det = F.nullif(s["s11"] * s["s22"] - s["s12"] * s["s12"], F.lit(0.0))
    one = F.try_divide(s["s01"], F.nullif(s["s11"], F.lit(0.0)))
    two_1 = F.try_divide(s["s01"] * s["s22"] - s["s02"] * s["s12"], det)
    two_2 = F.try_divide(s["s02"] * s["s11"] - s["s01"] * s["s12"], det)
    zero = F.lit(0.0)
    models = [
        (0, zero, zero, s["s00"]),
        (1, one, zero, s["s00"] - one * s["s01"]),
        (2, two_1, two_2, s["s00"] - two_1 * s["s01"] - two_2 * s["s02"]),
    ]

    def entry(p: int, phi1: Column, phi2: Column, rss: Column) -> Column:
        aic = F.when(rss > 0, F.col("n") * F.log(rss / F.col("n")) + 2 * (p + 1))
        return F.struct(
            F.coalesce(aic, F.lit(float("inf")) if p else F.lit(1e300)).alias("aic"), F.lit(p).alias("p"),
            F.coalesce(phi1, zero).alias("phi1"), F.coalesce(phi2, zero).alias("phi2"),
            F.greatest(F.coalesce(rss, zero), zero).alias("rss"),
        )

    entries = [entry(*m) for m in models]
    chosen = F.array_min(F.array(*entries)) if order is None else entries[order[0]]
    return sums.withColumn("_m", chosen).select(
        *SERIES, "d", "mu", "n", "points", "end", F.col("_m.p").alias("p"), F.col("_m.phi1").alias("phi1"),
        F.col("_m.phi2").alias("phi2"), F.col("_m.aic").alias("aic"),
        F.sqrt(F.col("_m.rss") / F.nullif(F.col("n"), F.lit(0))).alias("sigma"),
    )


def ar_forecast(grid: DataFrame, fit: DataFrame, steps: int = HORIZON) -> DataFrame:
    """Recursion of the fitted model over the horizon with a 95% band.

    Differencing is folded into up to four lag coefficients on the levels, so the
    same recursion serves every order and its impulse weights give the variance.
    """
    newest = Window.partitionBy(*SERIES).orderBy(F.col("hour").desc())
    tail = grid.where(F.col("y").isNotNull()).withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= 4)
    last = tail.groupBy(*SERIES).agg(
        *[F.max(F.when(F.col("_back") == k, F.col("y"))).alias(f"y{k}") for k in range(1, 5)]
    )
    a, b, d = F.col("phi1"), F.col("phi2"), F.col("d")
    zero = F.lit(0.0)

    def by_d(*values: Column) -> Column:
        return F.when(d == 0, values[0]).when(d == 1, values[1]).otherwise(values[2])

    ready = last.join(fit, SERIES).select(
        *SERIES, "p", "d", "sigma", "end", *[F.coalesce(f"y{k}", zero).alias(f"y{k}") for k in range(1, 5)],
        by_d(a, 1 + a, 2 + a).alias("c1"),
        by_d(b, b - a, b - 2 * a - 1).alias("c2"),
        by_d(zero, -b, a - 2 * b).alias("c3"),
        by_d(zero, zero, b).alias("c4"),
        F.when(d == 0, F.col("mu") * (1 - a - b)).otherwise(zero).alias("const"),
    )
    start = F.struct(
        *[F.col(f"y{k}").alias(f"y{k}") for k in range(1, 5)],
        F.lit(1.0).alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), zero.alias("spread"),
        F.array().cast("array<struct<forecast:double,spread:double>>").alias("out"),
    )

    def advance(s, _):
        y = F.col("const")
        w = zero
        for k in range(1, 5):
            y = y + F.col(f"c{k}") * s[f"y{k}"]
            w = w + F.col(f"c{k}") * s[f"w{k}"]
        spread = s["spread"] + s["w1"] * s["w1"]
        row = F.struct(y.alias("forecast"), spread.alias("spread"))
        return F.struct(
            y.alias("y1"), s["y1"].alias("y2"), s["y2"].alias("y3"), s["y3"].alias("y4"),
            w.alias("w1"), s["w1"].alias("w2"), s["w2"].alias("w3"), s["w3"].alias("w4"),
            spread.alias("spread"), F.concat(s["out"], F.array(row)).alias("out"),
        )

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance)["out"]
    rows = ready.select(*SERIES, "p", "d", "sigma", "end", F.posexplode(path).alias("_i", "_r"))
    forecast = F.col("_r.forecast")
    return rows.select(
        *SERIES, "p", "d", (F.col("_i") + 1).alias("step"), _hours_later("end", F.col("_i") + 1).alias("ts"),
        forecast.alias("forecast"), *_plus_minus(forecast, F.col("sigma") * F.sqrt("_r.spread")),
    )


def ar_fleet(grid: DataFrame, steps: int = HORIZON, order: tuple[int, int] | None = None) -> DataFrame:
    return ar_forecast(grid, ar_fit(grid, order), steps)


def _hour_of_day(column: Column) -> Column:
    return F.pmod(column, F.lit(24))


def _day_of_week(column: Column) -> Column:
    return F.pmod(F.floor(column / 24).cast("bigint"), F.lit(7))


def seasonal_trend_fleet(grid: DataFrame, steps: int = HORIZON, weekly: bool = False) -> DataFrame:
    """Straight trend plus mean daily (and weekly) pattern with a 95% band, for every series."""
    series = Window.partitionBy(*SERIES)
    t = _hour_number()
    known = grid.where(F.col("y").isNotNull()).withColumn("t", t)
    origin = F.min("t").over(series)
    placed = known.withColumn("_t0", origin).withColumn("_x", (F.col("t") - F.col("_t0")).cast("double"))
    trend = placed.withColumn("_slope", F.coalesce(F.regr_slope("y", "_x").over(series), F.lit(0.0))).withColumn(
        "_icept", F.avg("y").over(series) - F.col("_slope") * F.avg("_x").over(series)
    )
    detrended = trend.withColumn("_r", F.col("y") - F.col("_icept") - F.col("_slope") * F.col("_x"))
    daily = Window.partitionBy(*SERIES, "_hod")
    seasonal = detrended.withColumn("_hod", _hour_of_day(F.col("t"))).withColumn("_daily", F.avg("_r").over(daily))
    seasonal = seasonal.withColumn("_e", F.col("_r") - F.col("_daily"))
    if weekly:
        week = Window.partitionBy(*SERIES, "_dow")
        seasonal = seasonal.withColumn("_dow", _day_of_week(F.col("t"))).withColumn("_weekly", F.avg("_e").over(week))
        seasonal = seasonal.withColumn("_e", F.col("_e") - F.col("_weekly"))
    fit = seasonal.groupBy(*SERIES).agg(
        F.max("t").alias("_last"), F.max("_t0").alias("_t0"), F.max("_slope").alias("_slope"),
        F.max("_icept").alias("_icept"), F.stddev_pop("_e").alias("_sigma"), F.max("hour").alias("_end"),
    )
    future = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(
        "t", F.col("_last") + F.col("step")
    )
    pattern = seasonal.groupBy(*SERIES, "_hod").agg(F.max("_daily").alias("_daily"))
    out = future.withColumn("_hod", _hour_of_day(F.col("t"))).join(pattern, [*SERIES, "_hod"], "left")
    seasonal_part = F.coalesce("_daily", F.lit(0.0))
    if weekly:
        weeks = seasonal.groupBy(*SERIES, "_dow").agg(F.max("_weekly").alias("_weekly"))
        out = out.withColumn("_dow", _day_of_week(F.col("t"))).join(weeks, [*SERIES, "_dow"], "left")
        seasonal_part = seasonal_part + F.coalesce("_weekly", F.lit(0.0))
    line = F.col("_icept") + F.col("_slope") * (F.col("t") - F.col("_t0"))
    return out.select(
        *SERIES, "step", _hours_later("_end", F.col("step")).alias("ts"), (line + seasonal_part).alias("forecast"),
        *_plus_minus(line + seasonal_part, F.col("_sigma")), line.alias("trend"), seasonal_part.alias("seasonal"),
    )


def choose_forecast(seasonal: DataFrame, ar: DataFrame) -> DataFrame:
    """The seasonal forecast where a series has one, otherwise the autoregression."""
    columns = [*SERIES, "step", "ts", "forecast", "lower", "upper"]
    usable = F.col("forecast").isNotNull() & F.col("lower").isNotNull()
    both = seasonal.where(usable).select(*columns, F.lit(1).alias("_rank"), F.lit("seasonal").alias("model")).unionByName(
        ar.where(usable).select(*columns, F.lit(2).alias("_rank"), F.lit("ar").alias("model"))
    )
    best = F.min("_rank").over(Window.partitionBy(*SERIES))
    return both.withColumn("_best", best).where(F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def exceedance_steps(forecast: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Probability per step that the value lies above the threshold, from the 95% band."""
    joined = forecast.join(thresholds.select(*SERIES, "threshold"), SERIES)
    sigma = (F.col("upper") - F.col("lower")) / (2 * Z95)
    z = F.try_divide(F.col("threshold") - F.col("forecast"), F.nullif(sigma, F.lit(0.0)))
    exceeds = F.col("forecast") > F.col("threshold")
    probability = F.when(sigma > 0, 1 - normal_cdf(z)).otherwise(exceeds.cast("double"))
    return joined.withColumn("exceeds", exceeds).withColumn("probability", probability)


def exceedance_probability(forecast: DataFrame, thresholds: DataFrame) -> DataFrame:
    return exceedance_steps(forecast, thresholds).groupBy(*SERIES).agg(
        F.max("probability").alias("max_probability"), F.avg("probability").alias("mean_probability"),
        F.bool_or("exceeds").alias("any_exceedance"), F.max("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("forecast_horizon"),
    )


def band_exceedance(forecast: DataFrame, stats: DataFrame) -> DataFrame:
    """Older rule: how far the upper band passes mean + 1.5 sigma, relative to that threshold."""
    sigma = F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, F.lit(1e-6)).otherwise(F.col("std"))
    threshold = F.col("mean") + THRESHOLD_SIGMA * sigma
    share = (F.col("upper") - threshold) / (F.abs(threshold) + 1e-6)
    probability = F.when(F.col("upper") > threshold, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)
    steps = forecast.join(stats.select(*SERIES, "mean", "std"), SERIES).withColumn("probability", probability)
    return steps.groupBy(*SERIES).agg(
        F.max("probability").alias("max_probability"), F.bool_or(F.col("probability") > 0).alias("any_exceedance")
    )


def forecast_phases(
    readings: DataFrame, steps: int = HORIZON, min_points: int = MIN_OBSERVATIONS, model: str = "auto",
    threshold_method: str = "statistical", multiplier: float = THRESHOLD_SIGMA,
) -> tuple[DataFrame, DataFrame]:
    """``(forecast steps, one status row per series)``; series that fail stay in the status with a reason."""
    # one row per hour and series, read by every model; the readings are scanned once for it
    grid = materialise(replace_outliers(regularise(readings, min_points)))
    thresholds = adaptive_threshold(grid, threshold_method, multiplier)
    if model == "seasonal":
        chosen = seasonal_trend_fleet(grid, steps).withColumn("model", F.lit("seasonal"))
    elif model == "ar":
        chosen = ar_fleet(grid, steps).withColumn("model", F.lit("ar"))
    else:
        chosen = choose_forecast(seasonal_trend_fleet(grid, steps), ar_fleet(grid, steps))
    stepwise = exceedance_steps(chosen, thresholds)
    summary = stepwise.groupBy(*SERIES).agg(
        F.max("probability").alias("max_probability"), F.avg("probability").alias("mean_probability"),
        F.bool_or("exceeds").alias("any_exceedance"), F.max("threshold").alias("threshold"), F.max("model").alias("model"),
    )
    seen = readings.groupBy(*SERIES).agg(F.count("value").alias("observations"))
    status = seen.join(summary, SERIES, "left").withColumn(
        "status",
        F.when(F.col("max_probability").isNotNull(), "ok")
        .when(F.col("observations") < min_points, "insufficient data")
        .otherwise("no model"),
    )
    return stepwise, status


def fleet_summary(status: DataFrame) -> DataFrame:
    """Per machine: forecast phases, failed phases, highest probability and the phases above 0.7."""
    ok = F.col("status") == "ok"
    risky = [
        F.max(F.when(ok & (F.col("phase") == p) & (F.col("max_probability") > CRITICAL_PROBABILITY), F.lit(label)))
        for p, label in zip(PHASES, ("R", "S", "T"))
    ]
    return status.groupBy("equipment_id").agg(
        F.count_if(ok).alias("successful_phases"),
        (F.lit(len(PHASES)) - F.count_if(ok)).alias("failed_phases"),
        F.coalesce(F.max(F.when(ok, F.col("max_probability"))), F.lit(0.0)).alias("max_anomaly_probability"),
        F.array_compact(F.array(*risky)).alias("critical_phases"),
    ).withColumn("recommendation", recommendation(F.col("max_anomaly_probability")))


def recommendation(probability: Column) -> Column:
    return banded(probability, ADVICE_BANDS, "normal")


def quick_status(probability: Column) -> Column:
    return banded(probability, QUICK_BANDS, "normal")


def fleet_risk_summary(summary: DataFrame) -> DataFrame:
    """How many machines were forecast, failed, and fall into each risk band."""
    done = F.col("successful_phases") > 0
    band = banded(F.col("max_anomaly_probability"), RISK_BANDS, "low")
    return summary.agg(
        F.count(F.lit(1)).alias("total_equipment"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"),
        *[F.count_if(done & (band == b)).alias(f"{b}_risk") for b in ("high", "medium", "low")],
    )
