"""SQL text of the domain frames, the twin of ``sources.star_tables`` for the comparison engine."""

from __future__ import annotations

_LINE_ID = (
    "concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, "
    "strftime(l_shipdate, '%Y%m%d'), (round(l_extendedprice * 100)::BIGINT)::VARCHAR)"
)

FRAMES: dict[str, str] = {
    "equipment": """
        SELECT c_custkey AS id, 'EQ-' || lpad(c_custkey::VARCHAR, 9, '0') AS equipment_code, c_name AS name,
               c_mktsegment AS type,
               CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_acctbal < 1000 THEN 'maintenance' ELSE 'active' END AS status,
               'hall-' || c_nationkey::VARCHAR AS location,
               '{"filename": "' || lower(c_mktsegment) || '_' || c_custkey::VARCHAR || '.csv"}' AS specifications
        FROM customer""",
    "signals": """
        SELECT o_orderkey AS id, o_custkey AS equipment_id, o_orderdate AS recorded_at,
               floor(o_totalprice)::BIGINT AS sample_rate_hz, o_custkey * 10 AS samples_count,
               o_orderpriority <> '1-URGENT' AS has_a, o_orderpriority <> '2-HIGH' AS has_b, o_orderstatus <> 'P' AS has_c,
               'motor_' || o_custkey::VARCHAR || '.csv' AS file_name,
               sha256(o_custkey::VARCHAR || '|' || o_orderpriority) AS file_hash,
               CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending'
                    WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'processing' END AS status,
               o_orderstatus = 'F' AS processed, o_orderdate + INTERVAL 1 HOUR AS created_at
        FROM orders""",
    "features": f"""
        SELECT {_LINE_ID} AS id, l_orderkey AS raw_id, l_shipdate AS window_start,
               l_shipdate + INTERVAL 1 SECOND AS window_end,
               l_quantity + 0.0 AS rms_a, d * 100 + 0.0 AS rms_b, CASE WHEN g THEN t * 100 + 0.0 END AS rms_c,
               1 + t * 10 AS crest_a, 1 + d * 10 AS crest_b, CASE WHEN g THEN 1 + t * 5 END AS crest_c,
               l_extendedprice / 10000 - 3 AS kurt_a, d * 20 - 1 AS kurt_b, CASE WHEN g THEN t * 20 - 1 END AS kurt_c,
               d * 10 - 0.5 AS skew_a, t * 10 - 0.4 AS skew_b, CASE WHEN g THEN d - t END AS skew_c,
               l_quantity / 2 AS mean_a, d * 10 AS mean_b, CASE WHEN g THEN t * 10 END AS mean_c,
               l_quantity * 0.5 AS std_a, d * 50 AS std_b, CASE WHEN g THEN t * 50 END AS std_c,
               -l_quantity AS min_a, -(d * 100) + 0.0 AS min_b, CASE WHEN g THEN -(t * 100) + 0.0 END AS min_c,
               l_quantity * 1.5 AS max_a, d * 150 AS max_b, CASE WHEN g THEN t * 150 END AS max_c,
               l_shipdate + INTERVAL 2 HOUR AS created_at
        FROM (SELECT *, l_discount + 0.0::DOUBLE AS d, l_tax + 0.0::DOUBLE AS t, l_linenumber <> 1 AS g FROM lineitem)""",
    "predictions": f"""
        SELECT 'p-' || {_LINE_ID} AS id, {_LINE_ID} AS feature_id, l_partkey AS defect_type_id, p AS probability,
               p > 0.8 AS anomaly_detected, CASE WHEN l_linenumber <> 3 THEN (l_tax + 0.0::DOUBLE) * 12.5 END AS confidence,
               CASE WHEN p > 0.9 THEN 'critical' WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END
                   AS predicted_severity,
               l_returnflag AS model_name, l_linestatus AS model_version, l_shipdate AS created_at
        FROM (SELECT *, (l_discount + 0.0::DOUBLE) * 10 AS p FROM lineitem)""",
    "defect_types": """
        SELECT p_partkey AS id, p_brand AS code, p_name AS name, p_type AS category FROM part WHERE p_size > 5""",
    "maintenance": """
        SELECT o_orderkey AS id, o_custkey AS equipment_id,
               CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'scheduled'
                    ELSE 'in_progress' END AS status,
               o_orderdate + INTERVAL 30 DAY AS scheduled_date,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY + INTERVAL 4 HOUR END AS completed_at
        FROM orders""",
    "forecasts": """
        SELECT o_orderkey AS id, o_custkey AS equipment_id, o_totalprice / 500000 AS max_probability,
               o_orderdate AS created_at
        FROM orders""",
    "users": """
        SELECT c_custkey AS id, c_name AS username, lower(c_mktsegment) AS role, c_acctbal > 0 AS is_active FROM customer""",
    "sessions": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
               o_orderdate + INTERVAL 1 DAY AS last_activity, o_orderdate + INTERVAL 30 DAY AS expires_at,
               '10.0.0.' || (o_custkey % 50)::VARCHAR AS ip_address, o_orderstatus <> 'F' AS is_active
        FROM orders""",
    "samples": """
        SELECT user_id % 5 AS signal_id, user_id % 5 AS equipment_id,
               CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS phase,
               row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) - 1 AS sample_idx,
               CASE WHEN event_id % 11 <> 0 THEN value END AS value
        FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "readings": """
        SELECT user_id % 5 AS equipment_id,
               CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS phase, ts,
               CASE WHEN event_id % 11 <> 0 THEN value END AS value, event_id AS id
        FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "audit_rows": """
        SELECT event_id AS id, user_id, 'user' || user_id::VARCHAR AS username,
               CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'engineer' WHEN 2 THEN 'operator' ELSE 'guest' END AS user_role,
               CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'permission_denied'
                    WHEN 'click' THEN 'login' WHEN 'view' THEN 'signal_view' ELSE 'file_upload' END AS action_type,
               CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'denied' ELSE 'success' END AS result,
               CASE event_type WHEN 'view' THEN '/api/v1/signals' WHEN 'purchase' THEN '/api/v1/upload' END AS endpoint,
               '10.0.0.' || (user_id % 50)::VARCHAR AS request_ip, ts, value
        FROM events""",
    "audit": """
        SELECT *, CASE WHEN value > 150 THEN sha256(digest) ELSE digest END AS integrity_hash
        FROM (SELECT *, sha256(user_id::VARCHAR || action_type || strftime(ts, '%Y-%m-%d %H:%M:%S') || request_ip
                               || coalesce(endpoint, '')) AS digest FROM audit_rows)""",
    "durations": """
        SELECT event_id AS id, event_type AS task_name, ts, value AS seconds, user_id % 5 AS equipment_id FROM events""",
    "matrix": """
        SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings""",
    "located_features": """
        SELECT f.*, s.equipment_id FROM features f JOIN signals s ON f.raw_id = s.id""",
    "located_predictions": """
        SELECT p.*, f.raw_id, f.window_start, f.window_end, f.rms_a, f.rms_b, f.rms_c, s.equipment_id
        FROM predictions p JOIN features f ON p.feature_id = f.id JOIN signals s ON f.raw_id = s.id""",
}

_NEEDS = {
    "located_features": ["features", "signals"],
    "located_predictions": ["predictions", "features", "signals"],
    "audit": ["audit_rows"],
}


def with_frames(names: str | list[str], body: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` preceded by the named frames as common table expressions."""
    names = names.split() if isinstance(names, str) else list(names)
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{name} AS ({FRAMES[name]})" for name in ordered]
    if extra.strip():
        parts.append(extra.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body


def r6(expression: str) -> str:
    """Six decimals and no negative zero, as the Spark side does before comparing.

    The small shift keeps exact decimal ties (means of two-decimal readings) from
    being decided by the last bit.
    """
    return f"round({expression} + 3e-10, 6) + 0.0"
