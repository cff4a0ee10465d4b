"""Registered queries: series, thresholds and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.functions.expressions import ERF_A, ERF_P
from motorlens.operators import forecast as P
from motorlens.operators import reports as R
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.sources import star_tables as S

STEPS = 24
MIN_POINTS = 50

GRID = f"""
single AS (
    SELECT equipment_id, phase, ts, arg_min(value, id) AS value, count(*) AS n FROM readings
    WHERE value IS NOT NULL GROUP BY 1, 2, 3),
hourly AS (
    SELECT *, sum(n) OVER (PARTITION BY equipment_id, phase) AS total FROM (
        SELECT equipment_id, phase, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS y, sum(n) AS n
        FROM single GROUP BY 1, 2, 3)),
spans AS (
    SELECT equipment_id, phase, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly
    WHERE total >= {MIN_POINTS} GROUP BY 1, 2),
sparse AS (SELECT s.*, h.y, epoch(s.hour)::BIGINT // 3600 AS t FROM spans s LEFT JOIN hourly h USING (equipment_id, phase, hour)),
grid AS (
    SELECT equipment_id, phase, hour, t,
           coalesce(y, py + (ny - py) * (t - pt) / nullif(nt - pt, 0)) AS y
    FROM (SELECT *, last_value(y IGNORE NULLS) OVER up AS py, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER up AS pt,
                 first_value(y IGNORE NULLS) OVER ahead AS ny,
                 first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER ahead AS nt
          FROM sparse
          WINDOW up AS (PARTITION BY equipment_id, phase ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 ahead AS (PARTITION BY equipment_id, phase ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),"""


def cleaned(condition: str, name: str = "clean") -> str:
    """Outliers under ``condition`` replaced by the line between their neighbours."""
    return f"""
{name}_open AS (
    SELECT equipment_id, phase, hour, t, out AS was_outlier, CASE WHEN NOT out THEN y END AS y FROM (
        SELECT *, {condition} AS out FROM (
            SELECT *, quantile_cont(y, 0.25) OVER s AS q1, quantile_cont(y, 0.75) OVER s AS q3,
                   avg(y) OVER s AS m, stddev_samp(y) OVER s AS sd
            FROM grid WINDOW s AS (PARTITION BY equipment_id, phase)))),
{name} AS (
    SELECT equipment_id, phase, hour, t, was_outlier,
           coalesce(y, py + (ny - py) * (t - pt) / nullif(nt - pt, 0), py) AS y
    FROM (SELECT *, last_value(y IGNORE NULLS) OVER up AS py, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER up AS pt,
                 first_value(y IGNORE NULLS) OVER ahead AS ny,
                 first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER ahead AS nt
          FROM {name}_open
          WINDOW up AS (PARTITION BY equipment_id, phase ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 ahead AS (PARTITION BY equipment_id, phase ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),"""


CLEAN = GRID + cleaned("y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)")
THRESHOLDS = CLEAN + """
thresholds AS (SELECT equipment_id, phase, avg(y) + 1.5 * stddev_pop(y) AS threshold FROM clean GROUP BY 1, 2),"""

SEASONAL = THRESHOLDS + f"""
placed AS (SELECT *, (t - min(t) OVER (PARTITION BY equipment_id, phase))::DOUBLE AS x FROM clean WHERE y IS NOT NULL),
trend AS (
    SELECT equipment_id, phase, coalesce(regr_slope(y, x), 0) AS slope, avg(y) - coalesce(regr_slope(y, x), 0) * avg(x) AS icept,
           max(t) AS last, min(t) AS first, max(hour) AS end_hour FROM placed GROUP BY 1, 2),
residual AS (SELECT p.*, y - icept - slope * x AS r, p.t % 24 AS hod FROM placed p JOIN trend USING (equipment_id, phase)),
pattern AS (SELECT equipment_id, phase, hod, avg(r) AS daily FROM residual GROUP BY 1, 2, 3),
noise AS (SELECT equipment_id, phase, stddev_pop(r - daily) AS sigma FROM residual JOIN pattern USING (equipment_id, phase, hod) GROUP BY 1, 2),
future AS (SELECT *, (last + step) % 24 AS hod FROM (SELECT *, unnest(range(1, {STEPS + 1})) AS step FROM trend)),
seasonal AS (
    SELECT equipment_id, phase, step, end_hour + step * INTERVAL 1 HOUR AS ts,
           icept + slope * (last + step - first) AS trend, coalesce(daily, 0) AS seasonal,
           icept + slope * (last + step - first) + coalesce(daily, 0) AS forecast, sigma
    FROM future LEFT JOIN pattern USING (equipment_id, phase, hod) JOIN noise USING (equipment_id, phase)),"""


def _located(spark, sf_dir):
    return R.locate_features(S.features(spark, sf_dir), S.signals(spark, sf_dir), ["id", "window_start", "rms_a", "rms_b", "rms_c"])


def _grid(spark, sf_dir):
    return P.regularise(S.readings(spark, sf_dir), MIN_POINTS)


def _clean(spark, sf_dir):
    return P.replace_outliers(_grid(spark, sf_dir))


@query(
    "rms_series",
    with_frames(
        "located_features",
        f"""SELECT equipment_id, phase, ts, {r6('value')} AS value, id FROM (
               SELECT *, count(*) OVER (PARTITION BY equipment_id, phase) AS total FROM (
                   SELECT *, row_number() OVER (PARTITION BY equipment_id, phase ORDER BY ts, id) AS rn FROM (
                       SELECT equipment_id, 'a' AS phase, window_start AS ts, id, rms_a AS value FROM located_features
                       UNION ALL SELECT equipment_id, 'b', window_start, id, rms_b FROM located_features
                       UNION ALL SELECT equipment_id, 'c', window_start, id, rms_c FROM located_features)
                   WHERE value IS NOT NULL AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2001-06-01')
               WHERE rn <= 55) WHERE total >= 50""",
    ),
)
def rms_series(spark, sf_dir):
    return P.rms_series(P.rms_readings(_located(spark, sf_dir)), "1996-01-01 00:00:00", "2001-06-01 00:00:00", limit=55)


@query(
    "rms_series_all",
    with_frames(
        "located_features",
        f"""SELECT equipment_id, phase, ts, {r6('value')} AS value, id FROM (
               SELECT *, count(*) OVER (PARTITION BY equipment_id, phase) AS total FROM (
                   SELECT equipment_id, 'a' AS phase, window_start AS ts, id, rms_a AS value FROM located_features
                   UNION ALL SELECT equipment_id, 'b', window_start, id, rms_b FROM located_features
                   UNION ALL SELECT equipment_id, 'c', window_start, id, rms_c FROM located_features)
               WHERE value IS NOT NULL) WHERE total >= 50""",
    ),
)
def rms_series_all(spark, sf_dir):
    """All readings of every series that has enough of them."""
    return P.rms_series(P.rms_readings(_located(spark, sf_dir)))


HOURLY = f"""
hourly AS (
    SELECT equipment_id, date_trunc('hour', window_start)::TIMESTAMP AS hour, avg(y) AS y FROM (
        SELECT *, count(y) OVER (PARTITION BY equipment_id) AS total FROM (
            SELECT equipment_id, window_start, (coalesce(rms_a, 0) + coalesce(rms_b, 0) + coalesce(rms_c, 0))
                   / nullif((rms_a IS NOT NULL)::INT + (rms_b IS NOT NULL)::INT + (rms_c IS NOT NULL)::INT, 0) AS y
            FROM located_features))
    WHERE total >= {MIN_POINTS} AND y IS NOT NULL GROUP BY 1, 2),
simple_thresholds AS (
    SELECT equipment_id, avg(y) AS mu, CASE WHEN stddev_pop(y) = 0 THEN 1e-6 ELSE stddev_pop(y) END AS sigma,
           count(y) AS history_points FROM hourly GROUP BY 1),
moving AS (
    SELECT equipment_id, step::INT AS step, end_hour + step * INTERVAL 1 HOUR AS ts,
           level + (last_y - first_y) / greatest(w - 1, 1) * step AS forecast
    FROM (SELECT *, unnest(range(1, {STEPS + 1})) AS step FROM (
              SELECT equipment_id, avg(y) AS level, arg_max(y, hour) AS last_y, arg_min(y, hour) AS first_y, count(*) AS w,
                     max(hour) AS end_hour
              FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY hour DESC) AS back FROM hourly)
              WHERE back <= 12 GROUP BY 1))),"""


def _hourly(spark, sf_dir):
    return P.hourly_rms(_located(spark, sf_dir), MIN_POINTS)


@query("hourly_rms", with_frames("located_features", f"SELECT equipment_id, hour, {r6('y')} AS y FROM hourly", HOURLY))
def hourly_rms(spark, sf_dir):
    return _hourly(spark, sf_dir)


@query(
    "sigma_threshold",
    with_frames(
        "located_features",
        f"""SELECT equipment_id, {r6('mu')} AS mu, {r6('sigma')} AS sigma, history_points,
                   {r6('mu + 2.0 * sigma')} AS threshold FROM simple_thresholds""",
        HOURLY,
    ),
)
def sigma_threshold(spark, sf_dir):
    return P.sigma_threshold(_hourly(spark, sf_dir), ["equipment_id"], "y")


@query(
    "moving_average_forecast",
    with_frames("located_features", f"SELECT equipment_id, step, ts, {r6('forecast')} AS forecast FROM moving", HOURLY),
)
def moving_average_forecast(spark, sf_dir):
    return P.moving_average_forecast(_hourly(spark, sf_dir), ["equipment_id"], steps=STEPS)


@query(
    "threshold_exceedance",
    with_frames(
        "located_features",
        f"""SELECT equipment_id, step, ts, {r6('forecast')} AS forecast, {r6('mu + 2.0 * sigma')} AS threshold,
                   forecast > mu + 2.0 * sigma AS over_threshold,
                   {r6('avg((forecast > mu + 2.0 * sigma)::INT) OVER (PARTITION BY equipment_id)')} AS probability_over_threshold
            FROM moving JOIN simple_thresholds USING (equipment_id)""",
        HOURLY,
    ),
)
def threshold_exceedance(spark, sf_dir):
    hourly = _hourly(spark, sf_dir)
    forecast = P.moving_average_forecast(hourly, ["equipment_id"], steps=STEPS)
    return P.threshold_exceedance(forecast, P.sigma_threshold(hourly, ["equipment_id"], "y"), ["equipment_id"])


@query("regularise", with_frames("readings", f"SELECT equipment_id, phase, hour, {r6('y')} AS y FROM grid", GRID))
def regularise(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(
    "replace_outliers",
    with_frames("readings", f"SELECT equipment_id, phase, hour, was_outlier, {r6('y')} AS y FROM clean", CLEAN),
)
def replace_outliers(spark, sf_dir):
    return _clean(spark, sf_dir)


@query(
    "replace_outliers_zscore",
    with_frames(
        "readings",
        f"SELECT equipment_id, phase, hour, was_outlier, {r6('y')} AS y FROM clean",
        GRID + cleaned("coalesce(abs(y - m) / nullif(sd, 0) > 2.0, false)"),
    ),
)
def replace_outliers_zscore(spark, sf_dir):
    return P.replace_outliers(_grid(spark, sf_dir), "zscore", 2.0)


@query(
    "adaptive_threshold",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, {r6('avg(y) + 1.5 * stddev_pop(y)')} AS threshold,
                   {r6('quantile_cont(y, 0.95)')} AS quantile_threshold FROM clean GROUP BY 1, 2""",
        CLEAN,
    ),
)
def adaptive_threshold(spark, sf_dir):
    grid = _clean(spark, sf_dir)
    quantile = P.adaptive_threshold(grid, "quantile").withColumnRenamed("threshold", "quantile_threshold")
    return P.adaptive_threshold(grid).join(quantile, P.SERIES)


@query(
    "history_stats",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, {r6('avg(y)')} AS mean, {r6('stddev_samp(y)')} AS std, {r6('min(y)')} AS "min",
                   {r6('max(y)')} AS "max", count(y) AS count FROM clean GROUP BY 1, 2""",
        CLEAN,
    ),
)
def history_stats(spark, sf_dir):
    return P.history_stats(_clean(spark, sf_dir))


@query(
    "difference",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, hour, {r6('y - 2 * y1 + y2')} AS y FROM (
               SELECT *, lag(y, 1) OVER s AS y1, lag(y, 2) OVER s AS y2 FROM grid
               WINDOW s AS (PARTITION BY equipment_id, phase ORDER BY t)) WHERE y2 IS NOT NULL""",
        GRID,
    ),
)
def difference(spark, sf_dir):
    return P.difference(_grid(spark, sf_dir), 2)


def _t_statistic(i: int) -> str:
    slope, sxx = f"regr_slope(d{i} - l{i}, l{i})", f"regr_sxx(d{i} - l{i}, l{i})"
    residual = f"(regr_syy(d{i} - l{i}, l{i}) - {slope} ** 2 * {sxx})"
    return f"{slope} / sqrt(greatest({residual}, 0) / (regr_count(d{i} - l{i}, l{i}) - 2) / {sxx})"


STATIONARY = CLEAN + f"""
d_1 AS (SELECT *, y AS d0, y - lag(y) OVER (PARTITION BY equipment_id, phase ORDER BY t) AS d1 FROM clean WHERE y IS NOT NULL),
d_2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY equipment_id, phase ORDER BY t) AS d2 FROM d_1),
lags AS (SELECT *, lag(d0) OVER s AS l0, lag(d1) OVER s AS l1, lag(d2) OVER s AS l2 FROM d_2
         WINDOW s AS (PARTITION BY equipment_id, phase ORDER BY t)),
tests AS (SELECT equipment_id, phase, {', '.join(f'{_t_statistic(i)} AS statistic_{i}' for i in range(3))} FROM lags GROUP BY 1, 2),
orders_found AS (
    SELECT *, coalesce(statistic_0 < -2.86, false) AS is_stationary,
           CASE WHEN statistic_0 < -2.86 THEN 0 WHEN statistic_1 < -2.86 THEN 1 ELSE 2 END AS d FROM tests),"""


@query(
    "stationarity",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, {', '.join(f'{r6(f"statistic_{i}")} AS statistic_{i}' for i in range(3))}, is_stationary, d
            FROM orders_found""",
        STATIONARY,
    ),
)
def stationarity(spark, sf_dir):
    return P.stationarity(_clean(spark, sf_dir))


def ar_sql(fixed: tuple[int, int] | None = None) -> str:
    """Fit and recursion; the recursion runs on the differenced values and is summed back, unlike the Spark side."""
    source = "d" if fixed is None else f"{fixed[1]} AS d"
    pick = "arg_min(p, aic)" if fixed is None else f"arg_min(p, abs(p - {fixed[0]}))"
    choose = f"""
chosen AS (
    SELECT m.* FROM models m JOIN (SELECT equipment_id, phase, {pick} AS best FROM models GROUP BY 1, 2) b
    ON m.equipment_id = b.equipment_id AND m.phase = b.phase AND m.p = b.best),"""
    return STATIONARY + f"""
z_rows AS (
    SELECT l.*, CASE o.d WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS z, o.d
    FROM lags l JOIN (SELECT equipment_id, phase, {source} FROM orders_found) o USING (equipment_id, phase)
    WHERE CASE o.d WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END IS NOT NULL),
x_rows AS (SELECT *, z - mu AS x0, lag(z - mu, 1) OVER s AS x1, lag(z - mu, 2) OVER s AS x2 FROM (
               SELECT *, CASE WHEN d = 0 THEN avg(z) OVER (PARTITION BY equipment_id, phase) ELSE 0 END AS mu FROM z_rows)
           WINDOW s AS (PARTITION BY equipment_id, phase ORDER BY t)),
sums AS (SELECT equipment_id, phase, d, mu, sum(x0*x0) AS s00, sum(x0*x1) AS s01, sum(x0*x2) AS s02, sum(x1*x1) AS s11,
                sum(x1*x2) AS s12, sum(x2*x2) AS s22, count(*) AS n FROM x_rows WHERE x2 IS NOT NULL GROUP BY 1, 2, 3, 4),
models AS (
    SELECT *, n * ln(rss / n) + 2 * (p + 1) AS aic FROM (
        SELECT equipment_id, phase, d, mu, n, 0 AS p, 0.0::DOUBLE AS phi1, 0.0::DOUBLE AS phi2, s00 AS rss FROM sums
        UNION ALL SELECT equipment_id, phase, d, mu, n, 1, s01 / s11, 0.0, s00 - s01 * s01 / s11 FROM sums
        UNION ALL SELECT equipment_id, phase, d, mu, n, 2, a, b, s00 - a * s01 - b * s02 FROM (
            SELECT *, (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12) AS a,
                   (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12) AS b FROM sums))),
{choose.strip()}
ends AS (SELECT equipment_id, phase, max(hour) AS end_hour, arg_max(x0, t) AS x1, arg_max(x1, t) AS x2, arg_max(d0, t) AS y1,
                arg_max(d1, t) AS g1 FROM x_rows GROUP BY 1, 2),
walk AS (
    SELECT c.equipment_id, c.phase, c.d, c.p, c.phi1, c.phi2, c.mu, sqrt(c.rss / c.n) AS sigma, e.end_hour, 0 AS step, e.x1, e.x2, e.y1, e.g1,
           1.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS cw, 0.0::DOUBLE AS ccw, 0.0::DOUBLE AS spread
    FROM chosen c JOIN ends e USING (equipment_id, phase)
    UNION ALL
    SELECT equipment_id, phase, d, p, phi1, phi2, mu, sigma, end_hour, step + 1, x, x1,
           CASE d WHEN 0 THEN x + mu WHEN 1 THEN y1 + x ELSE y1 + g1 + x END, CASE d WHEN 2 THEN g1 + x ELSE 0 END,
           phi1 * w1 + phi2 * w2, w1, cw + w1, ccw + cw + w1,
           spread + (CASE d WHEN 0 THEN w1 WHEN 1 THEN cw + w1 ELSE ccw + cw + w1 END) ** 2
    FROM (SELECT *, phi1 * x1 + phi2 * x2 AS x FROM walk) WHERE step < {STEPS}),
ar AS (SELECT equipment_id, phase, p, d, step, end_hour + step * INTERVAL 1 HOUR AS ts, y1 AS forecast,
              sigma * sqrt(spread) AS se FROM walk WHERE step > 0),"""


AR_COLUMNS = f"""SELECT equipment_id, phase, p, d, step, ts, {r6('forecast')} AS forecast, {r6('forecast - 1.96 * se')} AS lower,
                        {r6('forecast + 1.96 * se')} AS upper FROM ar"""


@query("ar_fleet", with_frames("readings", AR_COLUMNS, ar_sql(), recursive=True))
def ar_fleet(spark, sf_dir):
    return P.ar_fleet(_clean(spark, sf_dir), STEPS)


@query("ar_fixed_order", with_frames("readings", AR_COLUMNS, ar_sql((2, 1)), recursive=True))
def ar_fixed_order(spark, sf_dir):
    return P.ar_fleet(_clean(spark, sf_dir), STEPS, order=(2, 1))


BAND = f"{r6('forecast - 1.96 * sigma')} AS lower, {r6('forecast + 1.96 * sigma')} AS upper"


@query(
    "seasonal_trend_fleet",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, step::INT AS step, ts, {r6('forecast')} AS forecast, {BAND}, {r6('trend')} AS trend,
                   {r6('seasonal')} AS seasonal FROM seasonal""",
        SEASONAL,
    ),
)
def seasonal_trend_fleet(spark, sf_dir):
    return P.seasonal_trend_fleet(_clean(spark, sf_dir), STEPS)


@query(
    "choose_forecast",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, step::INT AS step, ts, {r6('forecast')} AS forecast, {BAND}, 'seasonal' AS model
            FROM seasonal WHERE phase <> 'c'
            UNION ALL
            SELECT equipment_id, phase, step, ts, {r6('forecast')}, {r6('forecast - 1.96 * se')}, {r6('forecast + 1.96 * se')}, 'ar'
            FROM ar WHERE phase = 'c'""",
        SEASONAL + ar_sql().replace(CLEAN, ""),
        recursive=True,
    ),
)
def choose_forecast(spark, sf_dir):
    """Phase c is kept from the seasonal model, so both branches of the choice are used."""
    grid = _clean(spark, sf_dir)
    seasonal = P.seasonal_trend_fleet(grid, STEPS).where(F.col("phase") != "c")
    return P.choose_forecast(seasonal, P.ar_fleet(grid, STEPS))


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs({z}) / sqrt(2.0)))"
    poly = " + ".join(f"({a}) * {t} ** {i}" for i, a in enumerate(ERF_A, start=1))
    erf = f"(1 - ({poly}) * exp(-({z}) * ({z}) / 2))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


STEPWISE = SEASONAL + f"""
stepwise AS (
    SELECT *, forecast > threshold AS exceeds,
           CASE WHEN sigma > 0 THEN 1 - {cdf_sql('((threshold - forecast) / sigma)')} ELSE (forecast > threshold)::INT::DOUBLE END AS probability
    FROM seasonal JOIN thresholds USING (equipment_id, phase)),"""


@query(
    "exceedance_probability",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, {r6('max(probability)')} AS max_probability, {r6('avg(probability)')} AS mean_probability,
                   bool_or(exceeds) AS any_exceedance, {r6('max(threshold)')} AS threshold, count(*) AS forecast_horizon
            FROM stepwise GROUP BY 1, 2""",
        STEPWISE,
    ),
)
def exceedance_probability(spark, sf_dir):
    grid = _clean(spark, sf_dir)
    return P.exceedance_probability(P.seasonal_trend_fleet(grid, STEPS), P.adaptive_threshold(grid))


@query(
    "band_exceedance",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, {r6('max(prob)')} AS max_probability, bool_or(prob > 0) AS any_exceedance FROM (
               SELECT *, CASE WHEN upper > thr THEN greatest(0.0, least(1.0, (upper - thr) / (abs(thr) + 1e-6))) ELSE 0.0 END AS prob
               FROM (SELECT s.*, forecast + 1.96 * sigma AS upper, h.thr FROM seasonal s
                     JOIN (SELECT equipment_id, phase, avg(y) + 1.5 * stddev_samp(y) AS thr FROM clean GROUP BY 1, 2) h
                     USING (equipment_id, phase))) GROUP BY 1, 2""",
        SEASONAL,
    ),
)
def band_exceedance(spark, sf_dir):
    grid = _clean(spark, sf_dir)
    return P.band_exceedance(P.seasonal_trend_fleet(grid, STEPS), P.history_stats(grid))


STATUS = STEPWISE + """
status AS (
    SELECT r.equipment_id, r.phase, r.observations, p.max_probability,
           CASE WHEN p.max_probability IS NOT NULL THEN 'ok' WHEN r.observations < 50 THEN 'insufficient data' ELSE 'no model' END AS status
    FROM (SELECT equipment_id, phase, count(value) AS observations FROM readings GROUP BY 1, 2) r
    LEFT JOIN (SELECT equipment_id, phase, max(probability) AS max_probability FROM stepwise GROUP BY 1, 2) p
        USING (equipment_id, phase)),
fleet AS (
    SELECT equipment_id, count(*) FILTER (status = 'ok') AS successful_phases, 3 - count(*) FILTER (status = 'ok') AS failed_phases,
           coalesce(max(max_probability) FILTER (status = 'ok'), 0) AS max_anomaly_probability,
           concat_ws(',', max('R') FILTER (phase = 'a' AND max_probability > 0.7), max('S') FILTER (phase = 'b' AND max_probability > 0.7),
                     max('T') FILTER (phase = 'c' AND max_probability > 0.7)) AS critical_phases
    FROM status GROUP BY 1),"""

ADVICE = """CASE WHEN max_anomaly_probability >= 0.85 THEN 'critical' WHEN max_anomaly_probability >= 0.7 THEN 'high'
            WHEN max_anomaly_probability >= 0.5 THEN 'medium' WHEN max_anomaly_probability >= 0.25 THEN 'low' ELSE 'normal' END"""


def _status(spark, sf_dir):
    return P.forecast_phases(S.readings(spark, sf_dir), STEPS, MIN_POINTS, model="seasonal")[1]


@query(
    "forecast_fleet",
    with_frames(
        "readings",
        f"""SELECT equipment_id, successful_phases, failed_phases, {r6('max_anomaly_probability')} AS max_anomaly_probability,
                   critical_phases, {ADVICE} AS recommendation FROM fleet""",
        STATUS,
    ),
)
def forecast_fleet(spark, sf_dir):
    readings = S.readings(spark, sf_dir)
    status = P.forecast_phases(readings, STEPS, MIN_POINTS)[1]
    return P.fleet_summary(status).withColumn("critical_phases", F.array_join("critical_phases", ","))


@query(
    "recommendation",
    with_frames(
        "forecasts",
        f"""SELECT id, {ADVICE} AS recommendation,
                   CASE WHEN max_anomaly_probability >= 0.8 THEN 'critical' WHEN max_anomaly_probability >= 0.6 THEN 'high risk'
                        WHEN max_anomaly_probability >= 0.3 THEN 'medium risk' WHEN max_anomaly_probability >= 0.1 THEN 'low risk'
                        ELSE 'normal' END AS quick_status
            FROM (SELECT id, max_probability AS max_anomaly_probability FROM forecasts)""",
    ),
)
def recommendation(spark, sf_dir):
    probability = F.col("max_probability")
    return S.forecasts(spark, sf_dir).select(
        "id", P.recommendation(probability).alias("recommendation"), P.quick_status(probability).alias("quick_status")
    )


@query(
    "fleet_risk_summary",
    with_frames(
        "readings",
        """SELECT count(*) AS total_equipment, count(*) FILTER (successful_phases > 0) AS successful,
                  count(*) FILTER (successful_phases = 0) AS failed,
                  count(*) FILTER (successful_phases > 0 AND max_anomaly_probability >= 0.6) AS high_risk,
                  count(*) FILTER (successful_phases > 0 AND max_anomaly_probability >= 0.3 AND max_anomaly_probability < 0.6) AS medium_risk,
                  count(*) FILTER (successful_phases > 0 AND max_anomaly_probability < 0.3) AS low_risk FROM fleet""",
        STATUS,
    ),
)
def fleet_risk_summary(spark, sf_dir):
    return P.fleet_risk_summary(P.fleet_summary(_status(spark, sf_dir)))
