"""Analytics over the audit log and user sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions.clock import Moment, before, floor_to, moment, within
from motorlens.operators.reports import paged, stack

# fixed values of the request classification
EXACT_AND_CONTAINED_ROUTES = [
    ("POST", "/api/v1/upload", "file_upload"),
    ("GET", "/api/v1/signals", "signal_view"),
    ("GET", "/api/v1/anomalies", "anomaly_request"),
    ("GET", "/api/v1/equipment", "equipment_access"),
    ("POST", "/api/v1/anomalies", "forecast_request"),
    ("POST", "/auth/login", "login"),
    ("POST", "/auth/logout", "logout"),
    ("POST", "/auth/refresh", "token_refresh"),
    ("POST", "/admin", "admin_action"),
    ("PUT", "/admin", "admin_action"),
    ("DELETE", "/admin", "admin_action"),
    ("PATCH", "/admin", "admin_action"),
]
UNLOGGED_PREFIXES = ["/docs", "/redoc", "/openapi.json", "/health", "/metrics"]
SENSITIVE_KEYS = [
    "password", "token", "authorization", "secret", "key", "refresh_token", "access_token", "api_key",
]
REDACTED = "[REDACTED]"


def search_audit(
    audit: DataFrame, start: Moment | None = None, end: Moment | None = None, user_id: int | str | None = None,
    action_type: str | None = None, result: str | None = None,
) -> DataFrame:
    """Rows that match every given filter; page them with :func:`audit_page`, count them with ``count()``."""
    rows = audit
    if start is not None:
        rows = rows.where(F.col("ts") >= moment(start))
    if end is not None:
        rows = rows.where(F.col("ts") <= moment(end))
    for name, value in (("user_id", user_id), ("action_type", action_type), ("result", result)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def audit_page(rows: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    return paged(rows, [F.col("ts").desc(), F.col("id").desc()], page, page_size)


def _recent(audit: DataFrame, as_of: Moment, hours: int) -> DataFrame:
    return audit.where((F.col("ts") >= before(as_of, hours, "HOUR")) & (F.col("ts") <= moment(as_of)))


def _reach() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("action_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("request_ip").alias("unique_ips"),
    ]


def audit_summary(audit: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    return _recent(audit, as_of, hours).groupBy("action_type", "result", "user_role").agg(
        *_reach(), F.min("ts").alias("first_occurrence"), F.max("ts").alias("last_occurrence")
    )


def audit_hourly(audit: DataFrame) -> DataFrame:
    return audit.groupBy(floor_to("hour", "ts").alias("hour"), "action_type", "result", "user_role").agg(*_reach())


def top_users(audit: DataFrame, as_of: Moment, hours: int = 24, n: int = 10) -> DataFrame:
    counted = _recent(audit, as_of, hours).groupBy("username", "user_role").agg(
        F.count(F.lit(1)).alias("action_count"), F.count_distinct("action_type").alias("unique_actions")
    )
    return counted.orderBy(F.col("action_count").desc(), "username", "user_role").limit(n)


def security_events(audit: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    """Failures and denials per action, with how many addresses and users they involve."""
    bad = _recent(audit, as_of, hours).where(F.col("result").isin("failure", "denied"))
    return bad.groupBy("action_type").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("request_ip").alias("source_ip_count"),
        F.count_distinct("username").alias("affected_user_count"),
    )


def security_event_members(audit: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    """The addresses and users behind :func:`security_events`, one row each.

    Rows instead of one array per action: the number of addresses and users has no bound.
    """
    bad = _recent(audit, as_of, hours).where(F.col("result").isin("failure", "denied"))
    members = F.array(
        F.struct(F.lit("source_ip").alias("kind"), F.col("request_ip").alias("member")),
        F.struct(F.lit("affected_user").alias("kind"), F.col("username").alias("member")),
    )
    return bad.select("action_type", F.inline(members)).groupBy("action_type", "kind", "member").agg(
        F.count(F.lit(1)).alias("events")
    )


def suspicious_activity(audit: DataFrame, as_of: Moment, hours: int = 1, attempts: int = 5, high: int = 10) -> DataFrame:
    """Users and addresses with repeated failed logins or denials."""
    bad = _recent(audit, as_of, hours).where(F.col("action_type").isin("failed_login", "permission_denied"))
    return (
        bad.groupBy("user_id", "username", "request_ip")
        .agg(
            F.count(F.lit(1)).alias("failed_attempts"), F.max("ts").alias("last_attempt"), F.min("ts").alias("first_attempt")
        )
        .where(F.col("failed_attempts") >= attempts)
        .withColumn("risk_level", F.when(F.col("failed_attempts") >= high, "high").otherwise("medium"))
    )


def active_sessions(sessions: DataFrame, users: DataFrame, as_of: Moment) -> DataFrame:
    owner = users.select(F.col("id").alias("user_id"), "username", F.col("role").alias("user_role"))
    opened = sessions.where(
        F.col("is_active") & (F.col("expires_at") > moment(as_of)) & (F.col("created_at") <= moment(as_of))
    )
    return opened.join(owner, "user_id").select(
        F.col("id").alias("session_id"), "user_id", "username", "user_role", "created_at", "last_activity", "expires_at",
        "ip_address",
    )


def expire_sessions(sessions: DataFrame, as_of: Moment) -> DataFrame:
    """Sessions with the expired ones closed and marked."""
    expired = F.col("is_active") & (F.col("expires_at") < moment(as_of))
    return sessions.select(
        *[c for c in sessions.columns if c != "is_active"],
        (F.col("is_active") & ~expired).alias("is_active"),
        F.when(expired, moment(as_of)).alias("revoked_at"),
        F.when(expired, F.lit("Session expired")).alias("revoked_reason"),
    )


def security_metrics(audit: DataFrame, sessions: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    """Six named counts."""
    counts = _recent(audit, as_of, hours).agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count_if(F.col("action_type") == "failed_login").alias("failed_logins"),
        F.count_if(F.col("action_type") == "permission_denied").alias("permission_denied"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("request_ip").alias("unique_ips"),
    )
    opened = sessions.agg(
        F.count_if(F.col("is_active") & (F.col("expires_at") > moment(as_of))).alias("active_sessions")
    )

    def named(frame: DataFrame) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("metric_name"), F.col(c).alias("value")) for c in frame.columns]
        return frame.select(F.inline(F.array(*entries)))

    return stack([named(counts), named(opened)])


def integrity_digest() -> Column:
    """SHA-256 over the key fields; a missing endpoint counts as empty text."""
    return F.sha2(
        F.concat(
            F.col("user_id").cast("string"), F.col("action_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.col("request_ip"), F.coalesce(F.col("endpoint"), F.lit("")),
        ),
        256,
    )


def verify_integrity(audit: DataFrame) -> DataFrame:
    """Rows whose stored hash does not match their content."""
    return audit.withColumn("expected_hash", integrity_digest()).where(
        ~F.col("integrity_hash").eqNullSafe(F.col("expected_hash"))
    )


def archive_audit(audit: DataFrame, as_of: Moment, days: int = 2555) -> tuple[DataFrame, DataFrame]:
    """``(archived, kept)``."""
    old = F.col("ts") < before(as_of, days, "DAY")
    return audit.where(old), audit.where(~old)


def write_archive(archived: DataFrame, path: str) -> None:
    """Append to the archive, one folder per month."""
    archived.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def classify_requests(requests: DataFrame) -> DataFrame:
    """Audit columns for a request log ``(method, path, status, forwarded_for, real_ip, client_ip, params)``.

    Service routes are left out; a route matches exactly first, then by containment.
    """
    method, path, status = F.col("method"), F.col("path"), F.col("status")
    service = F.lit(False)
    for prefix in UNLOGGED_PREFIXES:
        service = service | F.startswith(path, F.lit(prefix))
    exact = contained = None
    for verb, route, action in EXACT_AND_CONTAINED_ROUTES:
        same_verb = method == verb
        exact = (F.when if exact is None else exact.when)(same_verb & (path == route), F.lit(action))
        contained = (F.when if contained is None else contained.when)(same_verb & F.contains(path, F.lit(route)), F.lit(action))
    result = (
        F.when(status.between(200, 299), "success")
        .when(status.isin(401, 403), "denied")
        .when(status.between(400, 499), "failure")
        .otherwise("error")
    )
    forwarded = F.nullif(F.col("forwarded_for"), F.lit(""))
    address = F.coalesce(
        F.trim(F.split(forwarded, ",")[0]), F.nullif(F.col("real_ip"), F.lit("")), F.col("client_ip"), F.lit("unknown")
    )
    masked = F.transform_values(
        "params", lambda k, v: F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(v)
    )
    return (
        requests.where(~service)
        .withColumn("action_type", F.coalesce(exact, contained, F.lit("equipment_access")))
        .withColumn("result", result)
        .withColumn("request_ip", address)
        .withColumn("params", masked)
        .withColumn("requires_auth", F.startswith(path, F.lit("/api/v1/")) | F.startswith(path, F.lit("/admin/")))
    )
