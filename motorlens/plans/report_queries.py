"""Registered queries: relational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.functions.expressions import PHASES
from motorlens.operators import reports as R
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.session import table_folder
from motorlens.sources import star_tables as S

AS_OF = "2001-08-01 00:00:00"
NOW = "TIMESTAMP '2001-08-01'"
START, END = "2001-07-02 00:00:00", AS_OF
PERIOD = f"created_at BETWEEN TIMESTAMP '2001-07-02' AND {NOW}"


def last(column: str, amount: str) -> str:
    return f"({column} > {NOW} - INTERVAL {amount} AND {column} <= {NOW})"


def _located_features(spark, sf_dir):
    return R.locate_features(S.features(spark, sf_dir), S.signals(spark, sf_dir))


def _located(spark, sf_dir, columns=None):
    return R.locate_predictions(
        S.predictions(spark, sf_dir), S.features(spark, sf_dir), S.signals(spark, sf_dir), columns
    )


@query(
    "signals_with_equipment",
    with_frames(
        "signals equipment",
        """SELECT s.id, s.equipment_id, e.equipment_code, e.name AS equipment_name, e.type AS equipment_type,
                  e.status AS equipment_status, e.location, s.recorded_at, s.sample_rate_hz, s.samples_count,
                  floor(s.samples_count * 1000 / nullif(s.sample_rate_hz, 0))::BIGINT AS duration_ms,
                  s.has_a AS has_phase_a, s.has_b AS has_phase_b, s.has_c AS has_phase_c, s.file_name, s.processed, s.created_at
           FROM signals s JOIN equipment e ON s.equipment_id = e.id""",
    ),
)
def signals_with_equipment(spark, sf_dir):
    return R.signals_with_equipment(S.signals(spark, sf_dir), S.equipment(spark, sf_dir))


_ANALYSIS_COLUMNS = ", ".join(
    f"{r6('f.' + c)} AS {c}"
    for c in [f"{stat}_{p}" for stat in ("rms", "crest", "kurt", "skew", "mean", "std") for p in PHASES]
)


@query(
    "features_analysis",
    with_frames(
        "located_features equipment",
        f"""SELECT f.id, f.raw_id, f.equipment_id, e.equipment_code, e.name AS equipment_name, f.window_start, f.window_end,
               (epoch_ms(f.window_end) - epoch_ms(f.window_start))::BIGINT AS window_size_ms, {_ANALYSIS_COLUMNS},
               {r6('coalesce(rms_a, 0) + coalesce(rms_b, 0) + coalesce(rms_c, 0)')} AS rms_total,
               {r6('''(coalesce(rms_a, 0) + coalesce(rms_b, 0) + coalesce(rms_c, 0))
                   / nullif((rms_a IS NOT NULL)::INT + (rms_b IS NOT NULL)::INT + (rms_c IS NOT NULL)::INT, 0)''')} AS rms_avg,
               {r6('greatest(coalesce(crest_a, 0), coalesce(crest_b, 0), coalesce(crest_c, 0))')} AS crest_max,
               {r6('max_a - min_a')} AS range_a, {r6('max_b - min_b')} AS range_b, {r6('max_c - min_c')} AS range_c,
               f.created_at
        FROM located_features f JOIN equipment e ON f.equipment_id = e.id""",
    ),
)
def features_analysis(spark, sf_dir):
    return R.features_analysis(S.features(spark, sf_dir), S.signals(spark, sf_dir), S.equipment(spark, sf_dir))


@query(
    "predictions_detailed",
    with_frames(
        "located_predictions equipment defect_types",
        f"""SELECT p.id, p.feature_id, p.raw_id, p.equipment_id, e.equipment_code, e.name AS equipment_name, p.window_start,
               p.window_end, p.defect_type_id, d.code AS defect_code, d.name AS defect_name, d.category AS defect_category,
               {r6('p.probability')} AS probability, p.predicted_severity, {r6('p.confidence')} AS confidence,
               p.model_name, p.model_version, p.created_at
        FROM located_predictions p JOIN equipment e ON p.equipment_id = e.id
        LEFT JOIN defect_types d ON p.defect_type_id = d.id""",
    ),
)
def predictions_detailed(spark, sf_dir):
    return R.predictions_detailed(
        S.predictions(spark, sf_dir), S.features(spark, sf_dir), S.signals(spark, sf_dir), S.equipment(spark, sf_dir),
        S.defect_types(spark, sf_dir),
    )


def _summary(spark, sf_dir, fanout):
    return R.equipment_summary(
        S.equipment(spark, sf_dir), S.signals(spark, sf_dir), S.features(spark, sf_dir), S.predictions(spark, sf_dir),
        S.maintenance(spark, sf_dir), fanout,
    )


@query(
    "equipment_summary",
    with_frames(
        "equipment signals features predictions maintenance",
        """SELECT e.id, e.equipment_code, e.name, e.type, e.status, e.location,
              coalesce(s.n, 0) AS total_signals, s.first_at AS first_signal_at, s.last_at AS last_signal_at,
              coalesce(s.open, 0) AS unprocessed_signals, coalesce(f.n, 0) AS total_features,
              coalesce(p.n, 0) AS total_predictions, coalesce(p.risky, 0) AS high_risk_predictions,
              coalesce(p.critical, 0) AS critical_predictions, m.at AS last_maintenance_at
        FROM equipment e
        LEFT JOIN (SELECT equipment_id, count(*) AS n, min(recorded_at) AS first_at, max(recorded_at) AS last_at,
                          count(*) FILTER (NOT processed) AS open FROM signals GROUP BY 1) s ON s.equipment_id = e.id
        LEFT JOIN (SELECT s.equipment_id, count(*) AS n FROM features f JOIN signals s ON f.raw_id = s.id GROUP BY 1) f
            ON f.equipment_id = e.id
        LEFT JOIN (SELECT s.equipment_id, count(*) AS n, count(*) FILTER (p.probability > 0.7) AS risky,
                          count(*) FILTER (p.predicted_severity = 'critical') AS critical
                   FROM predictions p JOIN features f ON p.feature_id = f.id JOIN signals s ON f.raw_id = s.id GROUP BY 1) p
            ON p.equipment_id = e.id
        LEFT JOIN (SELECT equipment_id, max(completed_at) AS at FROM maintenance WHERE status = 'completed' GROUP BY 1) m
            ON m.equipment_id = e.id""",
    ),
)
def equipment_summary(spark, sf_dir):
    return _summary(spark, sf_dir, fanout=False)


@query(
    "equipment_summary_fanout",
    with_frames(
        "equipment signals features predictions maintenance",
        """SELECT e.id, e.equipment_code, e.name, e.type, e.status, e.location,
              count(s.id) AS total_signals, min(s.recorded_at) AS first_signal_at, max(s.recorded_at) AS last_signal_at,
              count(CASE WHEN s.processed = false THEN 1 END) AS unprocessed_signals, count(f.id) AS total_features,
              count(p.id) AS total_predictions, count(CASE WHEN p.probability > 0.7 THEN 1 END) AS high_risk_predictions,
              count(CASE WHEN p.predicted_severity = 'critical' THEN 1 END) AS critical_predictions,
              any_value(m.at) AS last_maintenance_at
        FROM equipment e LEFT JOIN signals s ON e.id = s.equipment_id LEFT JOIN features f ON s.id = f.raw_id
        LEFT JOIN predictions p ON f.id = p.feature_id
        LEFT JOIN (SELECT equipment_id, max(completed_at) AS at FROM maintenance WHERE status = 'completed' GROUP BY 1) m
            ON m.equipment_id = e.id
        GROUP BY e.id, e.equipment_code, e.name, e.type, e.status, e.location""",
    ),
)
def equipment_summary_fanout(spark, sf_dir):
    return _summary(spark, sf_dir, fanout=True)


_TREND = ", ".join(
    f"{r6(f'{f}(rms_{p})')} AS {alias}_rms_{p}"
    for f, alias in (("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev_samp", "std"))
    for p in PHASES
)


@query(
    "rms_trends",
    with_frames(
        "located_features equipment",
        f"""SELECT f.equipment_id, e.equipment_code, e.name AS equipment_name, date_trunc('day', window_start)::TIMESTAMP AS trend_date,
                   {_TREND}, count(*) AS measurements_count
            FROM located_features f JOIN equipment e ON f.equipment_id = e.id
            WHERE {last('window_start', '30 DAY')} GROUP BY 1, 2, 3, 4""",
    ),
)
def rms_trends(spark, sf_dir):
    return R.rms_trends(S.features(spark, sf_dir), S.signals(spark, sf_dir), S.equipment(spark, sf_dir), AS_OF)


@query(
    "anomaly_analysis",
    with_frames(
        "located_predictions equipment defect_types",
        f"""SELECT p.equipment_id, e.equipment_code, e.name AS equipment_name, d.category AS defect_category, predicted_severity,
               count(*) AS total_predictions,
               count(*) FILTER (created_at > {NOW} - INTERVAL 24 HOUR) AS last_24h,
               count(*) FILTER (created_at > {NOW} - INTERVAL 7 DAY) AS last_7d,
               count(*) FILTER (created_at > {NOW} - INTERVAL 30 DAY) AS last_30d,
               {r6('avg(probability)')} AS avg_probability, {r6('max(probability)')} AS max_probability,
               {r6('min(probability)')} AS min_probability, max(created_at) AS last_prediction_at
        FROM located_predictions p JOIN equipment e ON p.equipment_id = e.id
        LEFT JOIN defect_types d ON p.defect_type_id = d.id
        WHERE probability > 0.5 AND created_at <= {NOW} GROUP BY 1, 2, 3, 4, 5""",
    ),
)
def anomaly_analysis(spark, sf_dir):
    return R.anomaly_analysis(
        S.predictions(spark, sf_dir), S.features(spark, sf_dir), S.signals(spark, sf_dir), S.equipment(spark, sf_dir),
        S.defect_types(spark, sf_dir), AS_OF,
    )


@query(
    "system_health",
    with_frames(
        "signals features predictions equipment users maintenance",
        f"""SELECT (SELECT count(*) FROM signals) AS total_signals,
               (SELECT count(*) FROM signals WHERE processed = false) AS unprocessed_signals,
               (SELECT count(*) FROM features) AS total_features, (SELECT count(*) FROM predictions) AS total_predictions,
               (SELECT count(*) FROM equipment) AS total_equipment,
               (SELECT count(*) FROM equipment WHERE status = 'active') AS active_equipment,
               (SELECT count(*) FROM equipment WHERE status = 'fault') AS faulty_equipment,
               (SELECT max(recorded_at) FROM signals) AS last_signal_at,
               (SELECT max(created_at) FROM features) AS last_feature_at,
               (SELECT max(created_at) FROM predictions) AS last_prediction_at,
               (SELECT count(*) FROM predictions WHERE predicted_severity = 'critical' AND {last('created_at', '24 HOUR')})
                   AS critical_alerts_24h,
               (SELECT count(*) FROM users WHERE is_active) AS active_users,
               (SELECT count(*) FROM maintenance WHERE status = 'scheduled'
                AND scheduled_date BETWEEN {NOW} AND {NOW} + INTERVAL 7 DAY) AS scheduled_maintenance_7d""",
    ),
)
def system_health(spark, sf_dir):
    return R.system_health(
        S.signals(spark, sf_dir), S.features(spark, sf_dir), S.predictions(spark, sf_dir), S.equipment(spark, sf_dir),
        S.users(spark, sf_dir), S.maintenance(spark, sf_dir), AS_OF,
    )


@query(
    "performance_metrics",
    with_frames(
        "signals features predictions",
        f"""SELECT date_trunc('day', created_at)::TIMESTAMP AS metric_date, 'signals' AS metric_type, count(*) AS count,
                   {r6('avg(samples_count)')} AS avg_samples,
                   sum(has_a::INT + has_b::INT + has_c::INT)::BIGINT AS total_phases
            FROM signals WHERE {last('created_at', '30 DAY')} GROUP BY 1
            UNION ALL
            SELECT date_trunc('day', created_at)::TIMESTAMP, 'features', count(*),
                   {r6('avg(epoch_ms(window_end) - epoch_ms(window_start))')}, NULL
            FROM features WHERE {last('created_at', '30 DAY')} GROUP BY 1
            UNION ALL
            SELECT date_trunc('day', created_at)::TIMESTAMP, 'predictions', count(*), {r6('avg(probability)')}, NULL
            FROM predictions WHERE {last('created_at', '30 DAY')} GROUP BY 1""",
    ),
)
def performance_metrics(spark, sf_dir):
    return R.performance_metrics(
        S.signals(spark, sf_dir), S.features(spark, sf_dir), S.predictions(spark, sf_dir), AS_OF
    )


_RECENT = f"""
recorded AS (SELECT equipment_id, max(recorded_at) AS last_signal_at, count(*) AS total_signals FROM signals GROUP BY 1),
measured AS (
    SELECT equipment_id, avg(rms_a) AS a, avg(rms_b) AS b, avg(rms_c) AS c,
           avg((coalesce(rms_a, 0) + coalesce(rms_b, 0) + coalesce(rms_c, 0))
               / nullif((rms_a IS NOT NULL)::INT + (rms_b IS NOT NULL)::INT + (rms_c IS NOT NULL)::INT, 0)) AS m
    FROM located_features WHERE {last('window_start', '24 HOUR')} GROUP BY 1),
risk AS (
    SELECT equipment_id, max(probability) AS max_risk_24h, count(*) FILTER (predicted_severity = 'critical') AS n
    FROM located_predictions WHERE {last('created_at', '24 HOUR')} GROUP BY 1),
coming AS (
    SELECT equipment_id, min(scheduled_date) AS next_maintenance_at FROM maintenance
    WHERE status = 'scheduled' AND scheduled_date > {NOW} GROUP BY 1),"""
_RECENT_JOINS = """FROM equipment e LEFT JOIN recorded r ON r.equipment_id = e.id LEFT JOIN measured f ON f.equipment_id = e.id
        LEFT JOIN risk p ON p.equipment_id = e.id LEFT JOIN coming m ON m.equipment_id = e.id
        WHERE e.status <> 'inactive'"""
_DASHBOARD_SQL = with_frames(
    "equipment located_features located_predictions maintenance",
    f"""SELECT e.id AS equipment_id, e.equipment_code, e.name AS equipment_name, e.type AS equipment_type,
           e.status AS equipment_status, e.location, r.last_signal_at, {r6('f.a')} AS avg_rms_a_24h,
           {r6('f.b')} AS avg_rms_b_24h, {r6('f.c')} AS avg_rms_c_24h, {r6('p.max_risk_24h')} AS max_risk_24h,
           coalesce(p.n, 0) AS critical_alerts_24h, m.next_maintenance_at, {NOW} AS last_updated
        {_RECENT_JOINS}""",
    _RECENT,
)


def _dashboard(spark, sf_dir):
    return R.dashboard_summary(
        S.equipment(spark, sf_dir), S.signals(spark, sf_dir), S.features(spark, sf_dir), S.predictions(spark, sf_dir),
        S.maintenance(spark, sf_dir), AS_OF,
    )


@query("dashboard_summary", _DASHBOARD_SQL)
def dashboard_summary(spark, sf_dir):
    return _dashboard(spark, sf_dir)


@query(
    "equipment_health",
    with_frames(
        "equipment located_features located_predictions maintenance",
        f"""SELECT e.id AS equipment_id, e.equipment_code, e.name AS equipment_name, e.status, r.last_signal_at,
               coalesce(r.total_signals, 0) AS total_signals, {r6('f.m')} AS avg_rms_24h,
               {r6('p.max_risk_24h')} AS max_risk_24h, coalesce(p.n, 0) AS critical_alerts_24h, m.next_maintenance_at,
               {r6('greatest(0.0, least(100.0, 100.0 - coalesce(p.max_risk_24h * 100, 0) - coalesce(p.n, 0) * 10))')}
                   AS health_score
        {_RECENT_JOINS}""",
        _RECENT,
    ),
)
def equipment_health(spark, sf_dir):
    return R.equipment_health(
        S.equipment(spark, sf_dir), S.signals(spark, sf_dir), S.features(spark, sf_dir), S.predictions(spark, sf_dir),
        S.maintenance(spark, sf_dir), AS_OF,
    )


@query(
    "health_index",
    with_frames(
        "equipment located_features located_predictions",
        f"""SELECT e.id AS equipment_id, coalesce(a.n, 0) AS recent_anomalies,
               CASE WHEN f.equipment_id IS NULL THEN 50.0::DOUBLE
                    ELSE greatest(0.0, least(100.0, 100.0 - penalty - coalesce(a.n, 0) * 15))::DOUBLE END AS health_index
        FROM equipment e
        LEFT JOIN (SELECT equipment_id, {' + '.join(
            f'''CASE WHEN coalesce(rms_{p}, 0) > 50 THEN 10 WHEN coalesce(rms_{p}, 0) > 40 THEN 5 ELSE 0 END
                + CASE WHEN crest_{p} > 2.0 OR crest_{p} < 1.0 THEN 8 ELSE 0 END''' for p in PHASES)} AS penalty
                   FROM located_features
                   QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY window_start DESC, id DESC) = 1) f
            ON f.equipment_id = e.id
        LEFT JOIN (SELECT equipment_id, count(*) AS n FROM located_predictions
                   WHERE anomaly_detected AND {last('created_at', '24 HOUR')} GROUP BY 1) a ON a.equipment_id = e.id""",
    ),
)
def health_index(spark, sf_dir):
    newest = R.newest_per(
        _located_features(spark, sf_dir).select(
            "equipment_id", "window_start", "id", *[f"rms_{p}" for p in PHASES], *[f"crest_{p}" for p in PHASES]
        ),
        ["equipment_id"], "window_start", "id",
    )
    anomalies = _located(spark, sf_dir).where("anomaly_detected")
    return R.health_index(newest, anomalies, S.equipment(spark, sf_dir), AS_OF)


@query(
    "list_signals",
    with_frames(
        "signals",
        """SELECT id, equipment_id, recorded_at, sample_rate_hz, samples_count, file_name, status,
                  concat_ws(',', CASE WHEN has_a THEN 'A' END, CASE WHEN has_b THEN 'B' END, CASE WHEN has_c THEN 'C' END) AS phases
           FROM signals WHERE status IN ('pending', 'failed') ORDER BY recorded_at DESC, id LIMIT 25 OFFSET 50""",
    ),
)
def list_signals(spark, sf_dir):
    page = R.list_signals(S.signals(spark, sf_dir), states=["pending", "failed"], page=3, page_size=25)
    return page.withColumn("phases", F.array_join("phases", ","))


@query(
    "list_equipment",
    with_frames(
        "equipment",
        "SELECT id, equipment_code, name, type, location FROM equipment WHERE status = 'active' ORDER BY name, id",
    ),
)
def list_equipment(spark, sf_dir):
    return R.list_equipment(S.equipment(spark, sf_dir))


@query(
    "list_anomalies",
    with_frames(
        "located_predictions",
        f"""SELECT id, feature_id, equipment_id, 'statistical_deviation' AS anomaly_type, {r6('conf')} AS confidence,
               CASE WHEN conf >= 0.8 THEN 'critical' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.4 THEN 'medium'
                    ELSE 'low' END AS severity,
               created_at AS detected_at, window_start, window_end,
               concat_ws(',', CASE WHEN rms_a IS NOT NULL THEN 'A' END, CASE WHEN rms_b IS NOT NULL THEN 'B' END,
                         CASE WHEN rms_c IS NOT NULL THEN 'C' END) AS affected_phases, model_name, model_version
        FROM (SELECT *, coalesce(confidence, probability) AS conf FROM located_predictions)
        WHERE (anomaly_detected OR probability > 0.5) AND {PERIOD} AND conf >= 0.3
        ORDER BY created_at DESC, id LIMIT 50 OFFSET 50""",
    ),
)
def list_anomalies(spark, sf_dir):
    located = _located(spark, sf_dir, ["window_start", "window_end", *[f"rms_{p}" for p in PHASES]])
    page = R.list_anomalies(located, START, END, min_confidence=0.3, page=2, page_size=50)
    return page.withColumn("affected_phases", F.array_join("affected_phases", ","))


@query(
    "anomaly_period_summary",
    with_frames(
        "located_predictions",
        f"""SELECT equipment_id, count(*) AS total_anomalies, {r6('avg(coalesce(confidence, probability))')} AS average_confidence,
               {r6('max(coalesce(confidence, probability))')} AS max_confidence, {r6('count(*) / 30')} AS anomalies_per_day,
               30 AS period_days
        FROM located_predictions WHERE (anomaly_detected OR probability > 0.5) AND {PERIOD} GROUP BY 1""",
    ),
)
def anomaly_period_summary(spark, sf_dir):
    return R.anomaly_period_summary(_located(spark, sf_dir), START, END, 30)


@query(
    "anomaly_daily_distribution",
    with_frames(
        "located_predictions",
        f"""SELECT equipment_id, created_at::DATE AS date, count(*) AS count FROM located_predictions
            WHERE (anomaly_detected OR probability > 0.5) AND {PERIOD} GROUP BY 1, 2""",
    ),
)
def anomaly_daily_distribution(spark, sf_dir):
    return R.anomaly_daily_distribution(_located(spark, sf_dir), START, END)


@query(
    "latest_forecast",
    with_frames(
        "forecasts",
        f"""SELECT equipment_id, id, {r6('max_probability')} AS max_probability, created_at FROM forecasts
            QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY created_at DESC, id DESC) = 1""",
    ),
)
def latest_forecast(spark, sf_dir):
    return R.latest_forecast(S.forecasts(spark, sf_dir))


_REPORT = f"""
report AS (
    SELECT e.id AS equipment_id, e.name AS equipment_name, coalesce(a.n, 0) AS anomalies_24h,
           f.created_at AS forecast_at, f.max_probability,
           CASE WHEN coalesce(a.n, 0) > 10 THEN 'critical' WHEN coalesce(a.n, 0) > 5 THEN 'warning'
                WHEN coalesce(a.n, 0) > 0 THEN 'attention' ELSE 'normal' END AS status
    FROM equipment e
    LEFT JOIN (SELECT equipment_id, count(*) AS n FROM located_predictions
               WHERE anomaly_detected AND {last('created_at', '24 HOUR')} GROUP BY 1) a ON a.equipment_id = e.id
    LEFT JOIN (SELECT * FROM forecasts WHERE created_at <= {NOW}
               QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY created_at DESC, id DESC) = 1) f
        ON f.equipment_id = e.id
    WHERE e.status = 'active'),"""


def _daily(spark, sf_dir):
    return R.daily_report(S.equipment(spark, sf_dir), _located(spark, sf_dir), S.forecasts(spark, sf_dir), AS_OF)


@query(
    "daily_report",
    with_frames(
        "equipment located_predictions forecasts",
        f"""SELECT equipment_id, equipment_name, anomalies_24h, forecast_at, {r6('max_probability')} AS max_probability, status
            FROM report""",
        _REPORT,
    ),
)
def daily_report(spark, sf_dir):
    return _daily(spark, sf_dir)


@query(
    "daily_totals",
    with_frames(
        "equipment located_predictions forecasts",
        """SELECT count(*) AS total_equipment, count(*) FILTER (status = 'critical') AS critical_equipment,
               count(*) FILTER (status = 'warning') AS warning_equipment,
               count(*) FILTER (status NOT IN ('critical', 'warning')) AS normal_equipment,
               coalesce(sum(anomalies_24h), 0)::BIGINT AS total_anomalies_24h FROM report""",
        _REPORT,
    ),
)
def daily_totals(spark, sf_dir):
    return R.daily_totals(_daily(spark, sf_dir))


@query(
    "daily_recommendations",
    with_frames(
        "equipment located_predictions forecasts",
        """SELECT 'check immediately' AS advice, equipment_name, equipment_id FROM report WHERE status = 'critical'
           UNION ALL SELECT 'schedule a check', equipment_name, equipment_id FROM report WHERE status = 'warning'
           UNION ALL SELECT 'raised anomaly activity', equipment_name, equipment_id FROM report WHERE anomalies_24h > 20
           UNION ALL SELECT 'all equipment works normally', NULL, NULL
           WHERE (SELECT count(*) FROM report WHERE status IN ('critical', 'warning')) = 0""",
        _REPORT,
    ),
)
def daily_recommendations(spark, sf_dir):
    return R.daily_recommendations(_daily(spark, sf_dir))


_HEALTH = f"""
recent AS (SELECT * FROM located_predictions WHERE {last('created_at', '24 HOUR')}),
health AS (
    SELECT *, anomalies_24h / greatest(1, predictions_24h) AS anomaly_rate,
           equipment_with_anomalies / greatest(1, active_equipment) AS anomaly_equipment_rate
    FROM (SELECT (SELECT count(*) FROM signals) AS signals_total,
                 (SELECT count(*) FROM signals WHERE status = 'pending') AS signals_pending,
                 (SELECT count(*) FROM signals WHERE status = 'processing') AS signals_processing,
                 (SELECT count(*) FROM signals WHERE status = 'completed') AS signals_completed,
                 (SELECT count(*) FROM signals WHERE status = 'failed') AS signals_failed,
                 (SELECT count(*) FROM features) AS features_total,
                 (SELECT count(*) FROM recent) AS predictions_24h,
                 (SELECT count(*) FROM recent WHERE anomaly_detected) AS anomalies_24h,
                 (SELECT count(DISTINCT equipment_id) FROM recent WHERE anomaly_detected) AS equipment_with_anomalies,
                 (SELECT count(*) FROM equipment WHERE status = 'active') AS active_equipment)),"""


def _processing(spark, sf_dir):
    return R.processing_health(
        S.signals(spark, sf_dir), S.features(spark, sf_dir), _located(spark, sf_dir), S.equipment(spark, sf_dir), AS_OF
    )


@query(
    "processing_health",
    with_frames(
        "equipment located_predictions",
        f"SELECT * REPLACE ({r6('anomaly_rate')} AS anomaly_rate, {r6('anomaly_equipment_rate')} AS anomaly_equipment_rate) FROM health",
        _HEALTH,
    ),
)
def processing_health(spark, sf_dir):
    return _processing(spark, sf_dir)


@query(
    "processing_alerts",
    with_frames(
        "equipment located_predictions",
        f"""SELECT level, type, {r6('value')} AS value, "limit"::DOUBLE AS "limit" FROM (
               SELECT 'warning' AS level, 'processing_failures' AS type, signals_failed / nullif(signals_total, 0) AS value,
                      0.1 AS "limit" FROM health
               UNION ALL SELECT 'warning', 'high_anomaly_count', anomalies_24h, 50 FROM health
               UNION ALL SELECT 'critical', 'widespread_anomalies',
                      equipment_with_anomalies / nullif(active_equipment, 0), 0.3 FROM health
               UNION ALL SELECT 'warning', 'processing_backlog', signals_processing, 100 FROM health)
            WHERE value > "limit" """,
        _HEALTH,
    ),
)
def processing_alerts(spark, sf_dir):
    return R.processing_alerts(_processing(spark, sf_dir))


@query(
    "files_overview",
    with_frames(
        "signals",
        f"""SELECT equipment_id, count(*) AS total_files, sum(samples_count)::BIGINT AS total_samples,
               {r6("avg(samples_count / nullif(sample_rate_hz, 0)) FILTER (samples_count <> 0)")} AS avg_duration_seconds,
               max(recorded_at) AS latest_recorded_at, arg_max(file_name, (recorded_at, id)) AS latest_file
        FROM signals GROUP BY 1""",
    ),
)
def files_overview(spark, sf_dir):
    return R.files_overview(S.signals(spark, sf_dir))


@query(
    "diagnosis_overview",
    with_frames(
        "located_predictions",
        f"""SELECT equipment_id, count(*) AS total_predictions, count(*) FILTER (anomaly_detected) AS anomalies,
               {r6('count(*) FILTER (anomaly_detected) / count(*) * 100')} AS anomaly_percent, max(created_at) AS last_check
        FROM located_predictions GROUP BY 1""",
    ),
)
def diagnosis_overview(spark, sf_dir):
    return R.diagnosis_overview(_located(spark, sf_dir))


@query(
    "anomaly_table",
    with_frames(
        "located_predictions defect_types",
        f"""SELECT p.id, equipment_id, created_at, coalesce(d.name, 'unknown') AS defect_type,
               {r6('probability')} AS probability, predicted_severity, model_name
        FROM located_predictions p LEFT JOIN defect_types d ON p.defect_type_id = d.id WHERE anomaly_detected""",
    ),
)
def anomaly_table(spark, sf_dir):
    return R.anomaly_table(_located(spark, sf_dir), S.defect_types(spark, sf_dir))


@query(
    "anomaly_timeline",
    with_frames(
        "located_predictions",
        f"""SELECT equipment_id, created_at::DATE AS date, CASE WHEN anomaly_detected THEN 'anomalous' ELSE 'normal' END AS series,
               count(*) AS points, {r6('avg(probability)')} AS mean_probability, {r6('max(probability)')} AS max_probability
        FROM located_predictions GROUP BY 1, 2, 3""",
    ),
)
def anomaly_timeline(spark, sf_dir):
    return R.anomaly_timeline(_located(spark, sf_dir))


USAGE_START, USAGE_END = "2000-06-01 00:00:00", "2024-01-20 00:00:00"
USAGE = f"BETWEEN TIMESTAMP '{USAGE_START}' AND TIMESTAMP '{USAGE_END}'"


@query(
    "usage_statistics",
    with_frames(
        "signals predictions audit",
        f"""SELECT (SELECT count(*) FROM audit WHERE ts {USAGE} AND action_type = 'file_upload') AS files_uploaded,
               (SELECT count(*) FROM audit WHERE ts {USAGE}) AS api_requests,
               (SELECT count(*) FROM signals WHERE created_at {USAGE} AND processed) AS signals_processed,
               (SELECT count(*) FROM predictions WHERE created_at {USAGE} AND anomaly_detected) AS anomalies_detected""",
    ),
)
def usage_statistics(spark, sf_dir):
    return R.usage_statistics(
        S.signals(spark, sf_dir), S.predictions(spark, sf_dir), S.audit(spark, sf_dir), USAGE_START, USAGE_END
    )


@query(
    "daily_activity",
    with_frames("audit", f"SELECT ts::DATE AS date, count(*) AS requests FROM audit WHERE ts {USAGE} GROUP BY 1"),
)
def daily_activity(spark, sf_dir):
    return R.daily_activity(S.audit(spark, sf_dir), USAGE_START, USAGE_END)


@query(
    "anomaly_types",
    with_frames(
        "predictions defect_types",
        f"""SELECT coalesce(d.category, 'unknown') AS category, count(*) AS anomalies
            FROM predictions p LEFT JOIN defect_types d ON p.defect_type_id = d.id
            WHERE anomaly_detected AND created_at {USAGE} GROUP BY 1""",
    ),
)
def anomaly_types(spark, sf_dir):
    return R.anomaly_types(S.predictions(spark, sf_dir), S.defect_types(spark, sf_dir), USAGE_START, USAGE_END)


_LOGS = ", logs AS (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders)"
_KEEP_DAYS = 1200
_CUTOFF = f"{NOW} - INTERVAL {_KEEP_DAYS} DAY"


def _logs(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")
    )


@query(
    "retention_counts",
    with_frames(
        "signals sessions",
        f"""SELECT 'raw_signals' AS table_name, count(*) FILTER (recorded_at < {_CUTOFF}) AS deleted_count FROM signals
            UNION ALL SELECT 'system_logs', count(*) FILTER (created_at < {_CUTOFF}) FROM logs
            UNION ALL SELECT 'user_sessions', count(*) FILTER (expires_at < {NOW}) FROM sessions""",
        _LOGS.lstrip(", "),
    ),
)
def retention_counts(spark, sf_dir):
    return R.retention_counts(
        S.signals(spark, sf_dir), _logs(spark, sf_dir), S.sessions(spark, sf_dir), AS_OF, _KEEP_DAYS
    )


@query(
    "apply_retention",
    with_frames(
        "signals features predictions sessions",
        f"""SELECT 'signals' AS table_name, count(*) AS kept FROM signals WHERE recorded_at >= {_CUTOFF}
            UNION ALL SELECT 'features', count(*) FROM kept_features
            UNION ALL SELECT 'predictions', count(*) FROM predictions
                WHERE feature_id NOT IN (SELECT f.id FROM features f JOIN signals s ON f.raw_id = s.id
                                         WHERE s.recorded_at < {_CUTOFF})
            UNION ALL SELECT 'logs', count(*) FROM logs WHERE created_at >= {_CUTOFF}
            UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE expires_at >= {NOW}""",
        f"""kept_features AS (SELECT * FROM features WHERE raw_id NOT IN (SELECT id FROM signals WHERE recorded_at < {_CUTOFF}))
            {_LOGS}""",
    ),
)
def apply_retention(spark, sf_dir):
    kept = R.apply_retention(
        S.signals(spark, sf_dir), S.features(spark, sf_dir), S.predictions(spark, sf_dir), _logs(spark, sf_dir),
        S.sessions(spark, sf_dir), AS_OF, _KEEP_DAYS,
    )
    return R.stack(
        [frame.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("kept")) for name, frame in kept.items()]
    )


@query(
    "cleanup_counts",
    with_frames(
        "signals predictions",
        f"""SELECT 'predictions' AS table_name, count(*) FILTER (created_at < {_CUTOFF}) AS deleted_count FROM predictions
            UNION ALL SELECT 'failed_signals', count(*) FILTER (created_at < {_CUTOFF} AND status = 'failed') FROM signals""",
    ),
)
def cleanup_counts(spark, sf_dir):
    return R.cleanup_counts(S.signals(spark, sf_dir), S.predictions(spark, sf_dir), AS_OF, _KEEP_DAYS)


@query(
    "rms_zscore_anomalies",
    with_frames(
        "located_features",
        f"""SELECT r.id AS feature_id, r.equipment_id, r.window_start, r.phase, {r6('rms_value')} AS rms_value,
               {r6('mean_value')} AS mean_value, {r6('std_value')} AS std_value,
               {r6('(rms_value - mean_value) / nullif(std_value, 0)')} AS z_score,
               abs((rms_value - mean_value) / nullif(std_value, 0)) > 1.5 AS is_anomaly
        FROM long r JOIN (SELECT equipment_id, phase, avg(rms_value) AS mean_value, stddev_samp(rms_value) AS std_value
                          FROM long GROUP BY 1, 2) b USING (equipment_id, phase)
        WHERE {last('window_start', '24 HOUR')}""",
        f"""long AS (
            SELECT id, equipment_id, window_start, phase, rms_value FROM (
                {' UNION ALL '.join(f"SELECT id, equipment_id, window_start, '{p.upper()}' AS phase, rms_{p} AS rms_value FROM located_features" for p in PHASES)})
            WHERE rms_value IS NOT NULL AND {last('window_start', '400 DAY')})""",
    ),
)
def rms_zscore_anomalies(spark, sf_dir):
    return R.rms_zscore_anomalies(
        S.features(spark, sf_dir), S.signals(spark, sf_dir), AS_OF, lookback_days=400, sigma=1.5
    )


_DIAG = [f"{stat}_{p}" for stat in ("rms", "crest", "kurt", "skew") for p in PHASES]


@query(
    "diagnostic_report_rows",
    with_frames(
        "equipment located_predictions",
        f"""SELECT e.id AS equipment_id, e.name AS equipment_name, s.recorded_at, s.id AS raw_id,
               {', '.join(f"{r6('f.' + c)} AS {c}" for c in _DIAG)}, coalesce(p.n, 0) AS anomaly_count,
               CASE WHEN coalesce(p.n, 0) > 0 THEN 'detailed diagnosis' ELSE 'continue monitoring' END AS advice
        FROM equipment e
        LEFT JOIN (SELECT * FROM signals
                   QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY recorded_at DESC, id DESC) = 1) s
            ON s.equipment_id = e.id
        LEFT JOIN (SELECT * FROM features
                   QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY window_start DESC, id DESC) = 1) f
            ON f.raw_id = s.id
        LEFT JOIN (SELECT equipment_id, count(*) FILTER (anomaly_detected) AS n FROM located_predictions GROUP BY 1) p
            ON p.equipment_id = e.id""",
    ),
)
def diagnostic_report_rows(spark, sf_dir):
    return R.diagnostic_report_rows(
        S.equipment(spark, sf_dir), S.signals(spark, sf_dir), S.features(spark, sf_dir), _located(spark, sf_dir)
    )


@query("refresh_dashboard", _DASHBOARD_SQL)
def refresh_dashboard(spark, sf_dir):
    """Writes the stored dashboard table and reads it back."""
    return R.refresh(spark, "dashboard_summary", _dashboard(spark, sf_dir), table_folder(spark))
