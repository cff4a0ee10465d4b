"""Registered queries: audit log and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.operators import audit as A
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import with_frames
from motorlens.session import table_folder
from motorlens.sources import star_tables as S

AS_OF = "2024-01-30 00:00:00"
NOW = "TIMESTAMP '2024-01-30'"
HOURS = 240
RECENT = f"ts >= {NOW} - INTERVAL {HOURS} HOUR AND ts <= {NOW}"
SESSION_AS_OF = "2001-08-01 00:00:00"
SESSION_NOW = "TIMESTAMP '2001-08-01'"
REACH = "count(*) AS action_count, count(DISTINCT user_id) AS unique_users, count(DISTINCT request_ip) AS unique_ips"


@query(
    "search_audit",
    with_frames(
        "audit",
        """SELECT id, user_id, username, user_role, action_type, result, endpoint, request_ip, ts FROM audit
           WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND action_type = 'signal_view'
             AND result = 'success' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100""",
    ),
)
def search_audit(spark, sf_dir):
    rows = A.search_audit(
        S.audit(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-25 00:00:00", action_type="signal_view", result="success"
    )
    return A.audit_page(rows, page=3).drop("integrity_hash")


@query(
    "audit_summary",
    with_frames(
        "audit",
        f"""SELECT action_type, result, user_role, {REACH}, min(ts) AS first_occurrence, max(ts) AS last_occurrence
            FROM audit WHERE {RECENT} GROUP BY 1, 2, 3""",
    ),
)
def audit_summary(spark, sf_dir):
    return A.audit_summary(S.audit(spark, sf_dir), AS_OF, HOURS)


@query(
    "audit_hourly",
    with_frames(
        "audit",
        f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, action_type, result, user_role, {REACH} FROM audit GROUP BY 1, 2, 3, 4",
    ),
)
def audit_hourly(spark, sf_dir):
    return A.audit_hourly(S.audit(spark, sf_dir))


@query(
    "top_users",
    with_frames(
        "audit",
        f"""SELECT username, user_role, count(*) AS action_count, count(DISTINCT action_type) AS unique_actions
            FROM audit WHERE {RECENT} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    ),
)
def top_users(spark, sf_dir):
    return A.top_users(S.audit(spark, sf_dir), AS_OF, HOURS)


@query(
    "security_events",
    with_frames(
        "audit",
        f"""SELECT action_type, count(*) AS count, count(DISTINCT request_ip) AS source_ip_count,
                   count(DISTINCT username) AS affected_user_count
            FROM audit WHERE {RECENT} AND result IN ('failure', 'denied') GROUP BY 1""",
    ),
)
def security_events(spark, sf_dir):
    return A.security_events(S.audit(spark, sf_dir), AS_OF, HOURS)


@query(
    "security_event_members",
    with_frames(
        "audit",
        f"""SELECT action_type, 'source_ip' AS kind, request_ip AS member, count(*) AS events
            FROM audit WHERE {RECENT} AND result IN ('failure', 'denied') GROUP BY 1, 3
            UNION ALL SELECT action_type, 'affected_user', username, count(*)
            FROM audit WHERE {RECENT} AND result IN ('failure', 'denied') GROUP BY 1, 3""",
    ),
)
def security_event_members(spark, sf_dir):
    return A.security_event_members(S.audit(spark, sf_dir), AS_OF, HOURS)


@query(
    "suspicious_activity",
    with_frames(
        "audit",
        f"""SELECT user_id, username, request_ip, count(*) AS failed_attempts, max(ts) AS last_attempt,
                   min(ts) AS first_attempt, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'medium' END AS risk_level
            FROM audit WHERE {RECENT} AND action_type IN ('failed_login', 'permission_denied')
            GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
    ),
)
def suspicious_activity(spark, sf_dir):
    return A.suspicious_activity(S.audit(spark, sf_dir), AS_OF, HOURS)


@query(
    "active_sessions",
    with_frames(
        "sessions users",
        f"""SELECT s.id AS session_id, s.user_id, u.username, u.role AS user_role, s.created_at, s.last_activity, s.expires_at,
                   s.ip_address
            FROM sessions s JOIN users u ON s.user_id = u.id
            WHERE s.is_active AND s.expires_at > {SESSION_NOW} AND s.created_at <= {SESSION_NOW}""",
    ),
)
def active_sessions(spark, sf_dir):
    return A.active_sessions(S.sessions(spark, sf_dir), S.users(spark, sf_dir), SESSION_AS_OF)


@query(
    "expire_sessions",
    with_frames(
        "sessions",
        f"""SELECT id, user_id, created_at, last_activity, expires_at, ip_address,
                   is_active AND NOT (expires_at < {SESSION_NOW}) AS is_active,
                   CASE WHEN is_active AND expires_at < {SESSION_NOW} THEN {SESSION_NOW} END AS revoked_at,
                   CASE WHEN is_active AND expires_at < {SESSION_NOW} THEN 'Session expired' END AS revoked_reason
            FROM sessions""",
    ),
)
def expire_sessions(spark, sf_dir):
    return A.expire_sessions(S.sessions(spark, sf_dir), SESSION_AS_OF)


@query(
    "security_metrics",
    with_frames(
        "audit sessions",
        f"""SELECT 'total_actions' AS metric_name, count(*) AS value FROM audit WHERE {RECENT}
            UNION ALL SELECT 'failed_logins', count(*) FROM audit WHERE {RECENT} AND action_type = 'failed_login'
            UNION ALL SELECT 'permission_denied', count(*) FROM audit WHERE {RECENT} AND action_type = 'permission_denied'
            UNION ALL SELECT 'unique_users', count(DISTINCT user_id) FROM audit WHERE {RECENT}
            UNION ALL SELECT 'unique_ips', count(DISTINCT request_ip) FROM audit WHERE {RECENT}
            UNION ALL SELECT 'active_sessions', count(*) FROM moved WHERE is_active AND expires_at > {NOW}""",
        "moved AS (SELECT is_active, expires_at + INTERVAL 8200 DAY AS expires_at FROM sessions)",
    ),
)
def security_metrics(spark, sf_dir):
    # sessions moved into the time of the audit log
    sessions = S.sessions(spark, sf_dir).withColumn("expires_at", F.col("expires_at") + F.expr("INTERVAL 8200 DAYS"))
    return A.security_metrics(S.audit(spark, sf_dir), sessions, AS_OF, HOURS)


@query(
    "verify_integrity",
    with_frames(
        "audit",
        "SELECT id, user_id, action_type, integrity_hash, digest AS expected_hash FROM audit WHERE integrity_hash <> digest",
    ),
)
def verify_integrity(spark, sf_dir):
    return A.verify_integrity(S.audit(spark, sf_dir)).select(
        "id", "user_id", "action_type", "integrity_hash", "expected_hash"
    )


@query(
    "archive_audit",
    with_frames(
        "audit",
        f"""SELECT CASE WHEN ts < {NOW} - INTERVAL 20 DAY THEN 'archived' ELSE 'kept' END AS side, action_type,
                   count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM audit GROUP BY 1, 2""",
    ),
)
def archive_audit(spark, sf_dir):
    archived, kept = A.archive_audit(S.audit(spark, sf_dir), AS_OF, 20)
    both = archived.withColumn("side", F.lit("archived")).unionByName(kept.withColumn("side", F.lit("kept")))
    return both.groupBy("side", "action_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "write_archive",
    with_frames(
        "audit",
        f"""SELECT strftime(ts, '%Y-%m') AS month, action_type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM audit
            WHERE ts < {NOW} - INTERVAL 20 DAY GROUP BY 1, 2""",
    ),
)
def write_archive(spark, sf_dir):
    """The archive written in two runs and read back by month."""
    archived, _ = A.archive_audit(S.audit(spark, sf_dir), AS_OF, 20)
    folder = table_folder(spark)
    A.write_archive(archived.where(F.col("id") % 2 == 0), folder)
    A.write_archive(archived.where(F.col("id") % 2 != 0), folder)
    stored = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in archived.schema)}, month string").parquet(folder)
    return stored.groupBy("month", "action_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


REQUESTS = """
requests AS (
    SELECT event_id AS id,
           CASE event_type WHEN 'click' THEN 'POST' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
           CASE event_type WHEN 'click' THEN '/auth/login' WHEN 'purchase' THEN '/api/v1/anomalies/' || user_id::VARCHAR
                WHEN 'error' THEN '/admin/users/' || user_id::VARCHAR WHEN 'view' THEN '/api/v1/signals'
                ELSE CASE WHEN user_id % 3 = 0 THEN '/health' ELSE '/api/v1/reports' END END AS path,
           CASE user_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 403 ELSE 204 END AS status,
           CASE WHEN user_id % 2 = 0 THEN '10.1.0.' || (user_id % 50)::VARCHAR || ', 10.9.9.9' ELSE '' END AS forwarded_for,
           CASE WHEN user_id % 5 = 0 THEN '10.2.0.1' ELSE '' END AS real_ip, '10.3.0.' || (user_id % 50)::VARCHAR AS client_ip
    FROM events)"""


@query(
    "classify_requests",
    "WITH " + REQUESTS + """
    SELECT id, method, path, status,
           CASE WHEN method = 'POST' AND path = '/auth/login' THEN 'login'
                WHEN method = 'GET' AND path = '/api/v1/signals' THEN 'signal_view'
                WHEN method = 'POST' AND contains(path, '/api/v1/anomalies') THEN 'forecast_request'
                WHEN method = 'DELETE' AND contains(path, '/admin') THEN 'admin_action' ELSE 'equipment_access' END AS action_type,
           CASE WHEN status BETWEEN 200 AND 299 THEN 'success' WHEN status IN (401, 403) THEN 'denied'
                WHEN status BETWEEN 400 AND 499 THEN 'failure' ELSE 'error' END AS result,
           CASE WHEN forwarded_for <> '' THEN trim(split_part(forwarded_for, ',', 1)) WHEN real_ip <> '' THEN real_ip
                ELSE client_ip END AS request_ip,
           'user=' || (id % 10)::VARCHAR || ';Token=[REDACTED]' AS params,
           starts_with(path, '/api/v1/') OR starts_with(path, '/admin/') AS requires_auth
    FROM requests WHERE NOT starts_with(path, '/health')""",
)
def classify_requests(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    text = user.cast("string")
    requests = S.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind.isin("click", "purchase"), "POST").when(kind == "error", "DELETE").otherwise("GET").alias("method"),
        F.when(kind == "click", "/auth/login")
        .when(kind == "purchase", F.concat(F.lit("/api/v1/anomalies/"), text))
        .when(kind == "error", F.concat(F.lit("/admin/users/"), text))
        .when(kind == "view", "/api/v1/signals")
        .when(user % 3 == 0, "/health")
        .otherwise("/api/v1/reports")
        .alias("path"),
        F.element_at(F.array(*[F.lit(s) for s in (200, 401, 404, 503, 403, 204)]), (user % 6 + 1).cast("int")).alias("status"),
        F.when(user % 2 == 0, F.concat(F.lit("10.1.0."), (user % 50).cast("string"), F.lit(", 10.9.9.9"))).otherwise("")
        .alias("forwarded_for"),
        F.when(user % 5 == 0, "10.2.0.1").otherwise("").alias("real_ip"),
        F.concat(F.lit("10.3.0."), (user % 50).cast("string")).alias("client_ip"),
        F.create_map(
            F.lit("user"), (F.col("event_id") % 10).cast("string"), F.lit("Token"), F.concat(F.lit("t"), text)
        ).alias("params"),
    )
    params = F.concat(F.lit("user="), F.col("params")["user"], F.lit(";Token="), F.col("params")["Token"])
    return A.classify_requests(requests).withColumn("params", params).drop("forwarded_for", "real_ip", "client_ip")
