"""Registered queries: streams run to completion over the test tables, exports, display texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.functions import text as X
from motorlens.plans.ingest_queries import LINES, _lines
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.session import table_folder
from motorlens.sources import sinks
from motorlens.sources import star_tables as S
from motorlens.operators import alerts as L
from motorlens.plans.alert_queries import RATIOS, TASKS, _tasks
from motorlens.streaming import jobs as J
from motorlens.streaming import rules as U


def _event_stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = S.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


class _StreamReader:
    """Stands in for a session whose ``read`` is a stream, so that the table mappings serve both."""

    def __init__(self, stream):
        self.read = self
        self._stream = stream

    def parquet(self, _path):
        return self._stream


def _streamed(spark, sf_dir, mapping):
    return mapping(_StreamReader(_event_stream(spark, sf_dir)), sf_dir)


def _collected(spark, stream):
    folder = table_folder(spark)
    return J.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")


@query(
    "stream_hourly_rms",
    with_frames(
        "readings",
        f"""SELECT * FROM (
            SELECT equipment_id, phase, date_trunc('hour', ts)::TIMESTAMP AS window_start, {r6('avg(value)')} AS mean_rms,
                   {r6('min(value)')} AS min_rms, {r6('max(value)')} AS max_rms, count(*) AS readings
            FROM readings WHERE value IS NOT NULL GROUP BY 1, 2, 3)
        WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM readings WHERE value IS NOT NULL) - INTERVAL 10 MINUTE""",
    ),
)
def stream_hourly_rms(spark, sf_dir):
    """Windows that the watermark has closed."""
    table = _collected(spark, J.stream_hourly_rms(_streamed(spark, sf_dir, S.readings)))
    return table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_suspicious",
    with_frames(
        "audit",
        """SELECT user_id, username, request_ip, window_start, count(*) AS failed_attempts
           FROM (SELECT *, unnest(range(0, 4)) AS k FROM audit WHERE action_type IN ('failed_login', 'permission_denied')) a,
                LATERAL (SELECT time_bucket(INTERVAL 12 HOUR, a.ts) - a.k * INTERVAL 12 HOUR AS window_start) w
           WHERE window_start + INTERVAL 48 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM audit
                                                     WHERE action_type IN ('failed_login', 'permission_denied'))
           GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
    ),
)
def stream_suspicious(spark, sf_dir):
    stream = J.stream_suspicious(_streamed(spark, sf_dir, S.audit), window="48 hours", slide="12 hours", attempts=3)
    return _collected(spark, stream).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_silent_machines",
    """SELECT user_id AS equipment_id, max(ts) AS last_seen FROM events GROUP BY 1
       HAVING max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_silent_machines(spark, sf_dir):
    events = _event_stream(spark, sf_dir).withColumnRenamed("user_id", "equipment_id")
    table = _collected(spark, J.stream_silent_machines(events))
    return table.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def _recording_files(spark, sf_dir):
    """Recordings as text files, every content stored under two names."""
    folder = table_folder(spark)
    lines = _lines(spark, sf_dir)
    copies = lines.withColumn("copy", F.explode(F.array(F.lit("first"), F.lit("second"))))
    names = copies.select(F.concat("copy", F.lit("_"), "file").alias("name"), "line_no", "line")
    names.repartition("name").sortWithinPartitions("name", "line_no").select("name", "line").write.partitionBy("name").text(folder)
    return folder


@query(
    "stream_recordings",
    "WITH " + LINES.strip().rstrip(",") + """
    SELECT 'first_' || file AS file, sha256(string_agg(h, '' ORDER BY block)) AS file_hash
    FROM (SELECT file, line_no // 1000 AS block, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS h FROM lines GROUP BY 1, 2)
    GROUP BY file""",
)
def stream_recordings(spark, sf_dir):
    """Several small batches; each content is kept once, under its first name."""
    files = _recording_files(spark, sf_dir)
    folder = table_folder(spark)
    stream = J.watch_files(spark, files, "*.txt", per_batch=1000)
    J.stream_recordings(stream, f"{folder}/seen", f"{folder}/checkpoint").awaitTermination()
    seen = spark.read.parquet(f"{folder}/seen")
    return seen.select(F.regexp_extract("file", r"/name=([^/]*)/", 1).alias("file"), "file_hash")


@query("stream_features")
def stream_features(spark, sf_dir):
    """Feature rows of every distinct recording."""
    files = _recording_files(spark, sf_dir)
    folder = table_folder(spark)
    stream = J.watch_files(spark, files, "*.txt")
    J.stream_features(
        stream, f"{folder}/seen", f"{folder}/features", f"{folder}/checkpoint", 1000, size=32, hop=16, min_length=4,
        kernel=5, max_missing=0.9, spectrum_size=32,
    ).awaitTermination()
    rows = spark.read.parquet(f"{folder}/features")
    file = F.regexp_extract("signal_id", r"/name=([^/]*)/", 1)
    return rows.select(file.alias("file"), "window_no", "rms_a", "rms_b", "rms_c", "crest_a", "processed_phases")


@query(
    "write_forecasts",
    with_frames(
        "forecasts",
        f"""SELECT equipment_id, id, {r6('max_probability')} AS max_probability, created_at FROM forecasts
            QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY created_at DESC, id DESC) = 1""",
    ),
)
def write_forecasts(spark, sf_dir):
    """Newest forecasts written as JSON and read back."""
    from motorlens.operators.reports import latest_forecast

    newest = latest_forecast(S.forecasts(spark, sf_dir))
    folder = table_folder(spark)
    summary = newest.agg(F.count(F.lit(1)).alias("machines"), F.avg("max_probability").alias("mean_probability"))
    sinks.write_forecasts(newest, summary, folder)
    schema = "equipment_id bigint, id bigint, max_probability double, created_at timestamp_ntz"
    return spark.read.schema(schema).json(f"{folder}/forecasts").select("equipment_id", "id", "max_probability", "created_at")


@query(
    "export",
    with_frames("equipment", "SELECT id, equipment_code, name, type, status, location, specifications FROM equipment"),
)
def export(spark, sf_dir):
    """A table exported as CSV and read back."""
    folder = table_folder(spark)
    sinks.export(S.equipment(spark, sf_dir), folder, "csv")
    schema = "id bigint, equipment_code string, name string, type string, status string, location string, specifications string"
    return spark.read.schema(schema).option("header", "true").csv(folder)


def _fixed_sql(value: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', round({value}, {decimals}))"


@query(
    "display_texts",
    f"""SELECT o_orderkey AS id,
          CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN {_fixed_sql('b', 1)} || ' B'
               WHEN b < 1048576 THEN {_fixed_sql('b / 1024.0::DOUBLE', 1)} || ' KB' WHEN b < 1073741824 THEN {_fixed_sql('b / 1048576.0::DOUBLE', 1)} || ' MB'
               ELSE {_fixed_sql('b / 1073741824.0::DOUBLE', 1)} || ' GB' END AS size_text,
          CASE WHEN s < 60 THEN {_fixed_sql('s', 1)} || ' сек' WHEN s < 3600 THEN {_fixed_sql('s / 60', 1)} || ' мин'
               ELSE {_fixed_sql('s / 3600', 1)} || ' ч' END AS duration_text,
          strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') AS day_text,
          regexp_replace(o_orderpriority || '/' || o_orderkey::VARCHAR || ':x', '[<>:"/\\\\|?*]', '_', 'g') AS safe_name,
          sha256(o_orderpriority) AS hidden_text
        FROM (SELECT *, o_totalprice * o_custkey AS b, o_totalprice / 20 AS s FROM orders)""",
)
def display_texts(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    name = F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(":x"))
    return orders.select(
        F.col("o_orderkey").alias("id"), X.file_size(price * F.col("o_custkey")).alias("size_text"),
        X.duration(price / 20).alias("duration_text"), X.day_time(F.col("o_orderdate")).alias("day_text"),
        X.safe_file_name(name).alias("safe_name"), X.hidden(F.col("o_orderpriority")).alias("hidden_text"),
    )


@query(
    "stream_sustained",
    with_frames(
        "audit",
        """, islands AS (
            SELECT *, window_start - row_number() OVER (PARTITION BY user_role ORDER BY window_start) * INTERVAL 1 HOUR AS island
            FROM ratios, (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM audit)
            WHERE bad / total > 0.3 AND window_start + INTERVAL 1 HOUR <= mark),
        rows_held AS (
            SELECT *, row_number() OVER (PARTITION BY user_role, island ORDER BY window_start)::INT AS held FROM islands)
        SELECT user_role, window_start, held AS held_windows, 'firing' AS event FROM rows_held WHERE held >= 3
        UNION ALL
        SELECT user_role, max(window_start) + INTERVAL 1 HOUR, max(held), 'cleared' FROM rows_held GROUP BY user_role, island, mark
        HAVING max(held) >= 3 AND max(window_start) + INTERVAL 2 HOUR <= mark""",
        RATIOS,
    ),
)
def stream_sustained(spark, sf_dir):
    """Roles of which many requests fail for three hours in a row, and when that ends."""
    ratios = U.stream_window_ratios(_streamed(spark, sf_dir, S.audit), F.col("result") != "success", ["user_role"], "1 hour")
    with U.row_state(spark):
        table = _collected(spark, U.stream_sustained(ratios, F.col("ratio") > 0.3, ["user_role"], 3600, 3))
    return table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_p95",
    with_frames(
        "durations",
        f"""SELECT task_name, window_start, {r6('p95')} AS p95, events FROM (
            SELECT task_name, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(seconds) AS events,
                   list_sort(list(seconds))[ceil(0.95 * count(seconds))::INT] AS p95
            FROM durations WHERE seconds IS NOT NULL GROUP BY 1, 2)
        WHERE p95 > 120 AND window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM durations WHERE seconds IS NOT NULL)""",
    ),
)
def stream_p95(spark, sf_dir):
    """Slow kinds of tasks by sketches; exact here, as no window has more rows than a sketch keeps."""
    table = _collected(spark, U.stream_p95(_streamed(spark, sf_dir, S.durations), "seconds", ["task_name"], "6 hours", 120))
    return table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_task_runs",
    with_frames(
        "durations",
        f"""SELECT task_name, coalesce(state, 'running') AS status, count(*) AS tasks, {r6('avg(d)')} AS mean_seconds,
                   {r6('max(d)')} AS max_seconds, count(*) FILTER (d > 60) AS slow_tasks
            FROM (SELECT s.task_name, s.ts, f.state, (epoch_us(f.ts) - epoch_us(s.ts)) / 1e6 AS d
                  FROM (SELECT * FROM tasks WHERE kind = 'start') s
                  LEFT JOIN (SELECT * FROM tasks WHERE kind = 'finish') f USING (task_id)) r
            WHERE state IS NOT NULL OR date_trunc('milliseconds', ts) + INTERVAL 1 HOUR
                  < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM tasks)
            GROUP BY 1, 2""",
        TASKS,
    ),
)
def stream_task_runs(spark, sf_dir):
    """Durations by kind of task from paired events; tasks that never finish are reported by a timer."""
    folder = table_folder(spark)
    _tasks(spark, sf_dir).write.parquet(f"{folder}/in")
    events = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    return L.task_metrics(_collected(spark, U.stream_task_runs(events)))


@query(
    "stream_late_features",
    """WITH signals AS (SELECT o_orderkey AS signal_id, o_custkey AS equipment_id, o_orderdate::TIMESTAMP AS recorded_at FROM orders),
       made AS (SELECT l_orderkey AS signal_id, l_linenumber AS feature_id, l_shipdate::TIMESTAMP AS created_at FROM lineitem),
       marks AS (SELECT least((SELECT max(recorded_at) FROM signals), (SELECT max(created_at) FROM made)) - INTERVAL 10 MINUTE AS mark),
       met AS (SELECT s.*, m.feature_id, m.created_at FROM signals s LEFT JOIN made m ON m.signal_id = s.signal_id
               AND m.created_at BETWEEN s.recorded_at AND s.recorded_at + INTERVAL 20 DAY)
       SELECT signal_id, equipment_id, recorded_at, feature_id, created_at FROM met, marks
       WHERE feature_id IS NOT NULL OR recorded_at + INTERVAL 20 DAY < mark""",
)
def stream_late_features(spark, sf_dir):
    """Orders as recordings and their items as features made of them: those made within twenty days, and recordings without any."""
    def stream(name):
        schema = S.table(spark, sf_dir, name).schema
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)

    signals = stream("orders").select(
        F.col("o_orderkey").alias("signal_id"), F.col("o_custkey").alias("equipment_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"))
    features = stream("lineitem").select(
        F.col("l_orderkey").alias("signal_id"), F.col("l_linenumber").alias("feature_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    table = _collected(spark, U.stream_late_features(signals, features, 20 * 86400))
    return table.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("recorded_at", "created_at")})
