"""Domain frames derived from the star-schema tables (the mapping is in FIXTURES.md).

Every frame is a plain projection of a whole table, so a query on top of it does
work that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS
from motorlens.functions.ordering import position_within


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("EQ-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("equipment_code"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("type"),
        F.when(balance < 0, "inactive").when(balance < 1000, "maintenance").otherwise("active").alias("status"),
        F.concat(F.lit("hall-"), F.col("c_nationkey").cast("string")).alias("location"),
        F.concat(F.lit('{"filename": "'), F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string"),
                 F.lit('.csv"}')).alias("specifications"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("equipment_id"),
        F.col("o_orderdate").alias("recorded_at"),
        F.floor("o_totalprice").cast("bigint").alias("sample_rate_hz"),
        (F.col("o_custkey") * 10).alias("samples_count"),
        (F.col("o_orderpriority") != "1-URGENT").alias("has_a"),
        (F.col("o_orderpriority") != "2-HIGH").alias("has_b"),
        (state != "P").alias("has_c"),
        F.concat(F.lit("motor_"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_name"),
        F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("file_hash"),
        F.when(state == "F", "completed")
        .when(state == "O", "pending")
        .when(F.col("o_orderpriority") == "5-LOW", "failed")
        .otherwise("processing")
        .alias("status"),
        (state == "F").alias("processed"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    )


def _line_id() -> Column:
    parts = [
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.date_format("l_shipdate", "yyyyMMdd"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    ]
    return F.concat_ws("-", *parts)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    discount, tax = F.col("l_discount") + 0.0, F.col("l_tax") + 0.0

    def gap(column: Column) -> Column:
        return F.when(F.col("l_linenumber") != 1, column)

    computed = {
        "rms_a": quantity,
        "rms_b": discount * 100,
        "rms_c": gap(tax * 100),
        "crest_a": 1 + tax * 10,
        "crest_b": 1 + discount * 10,
        "crest_c": gap(1 + tax * 5),
        "kurt_a": price / 10000 - 3,
        "kurt_b": discount * 20 - 1,
        "kurt_c": gap(tax * 20 - 1),
        "skew_a": discount * 10 - 0.5,
        "skew_b": tax * 10 - 0.4,
        "skew_c": gap(discount - tax),
        "mean_a": quantity / 2,
        "mean_b": discount * 10,
        "mean_c": gap(tax * 10),
        "std_a": quantity * 0.5,
        "std_b": discount * 50,
        "std_c": gap(tax * 50),
        "min_a": -quantity,
        "min_b": -(discount * 100),
        "min_c": gap(-(tax * 100)),
        "max_a": quantity * 1.5,
        "max_b": discount * 150,
        "max_c": gap(tax * 150),
    }
    start = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("raw_id"),
        start.alias("window_start"),
        (start + F.expr("INTERVAL 1 SECOND")).alias("window_end"),
        *[(computed[name] + 0.0).alias(name) for name in FEATURE_COLUMNS],
        (start + F.expr("INTERVAL 2 HOURS")).alias("created_at"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    probability = (F.col("l_discount") + 0.0) * 10
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p-"), _line_id()).alias("id"),
        _line_id().alias("feature_id"),
        F.col("l_partkey").alias("defect_type_id"),
        probability.alias("probability"),
        (probability > 0.8).alias("anomaly_detected"),
        F.when(F.col("l_linenumber") != 3, (F.col("l_tax") + 0.0) * 12.5).alias("confidence"),
        F.when(probability > 0.9, "critical")
        .when(probability > 0.7, "high")
        .when(probability > 0.4, "medium")
        .otherwise("low")
        .alias("predicted_severity"),
        F.col("l_returnflag").alias("model_name"),
        F.col("l_linestatus").alias("model_version"),
        F.col("l_shipdate").alias("created_at"),
    )


def defect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second part type has no catalogue entry, so the left join to defects matters."""
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_size") > 5)
        .select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("code"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
        )
    )


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    scheduled = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("equipment_id"),
        F.when(state == "F", "completed").when(state == "O", "scheduled").otherwise("in_progress").alias("status"),
        scheduled.alias("scheduled_date"),
        F.when(state == "F", scheduled + F.expr("INTERVAL 4 HOURS")).alias("completed_at"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("equipment_id"),
        (F.col("o_totalprice") / 500000).alias("max_probability"),
        F.col("o_orderdate").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.lower("c_mktsegment").alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        opened.alias("created_at"),
        (opened + F.expr("INTERVAL 1 DAY")).alias("last_activity"),
        (opened + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 50).cast("string")).alias("ip_address"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long three-phase samples; a reading becomes a gap for every event id divisible by 11."""
    kind = F.col("event_type")
    phase = F.when(kind == "click", "a").when(kind == "view", "b").when(kind == "purchase", "c")
    readings = (
        table(spark, sf_dir, "events")
        .where(kind.isin("click", "view", "purchase"))
        .select(
            (F.col("user_id") % 5).alias("signal_id"),
            phase.alias("phase"),
            F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
            "ts",
            "event_id",
        )
    )
    ordered = position_within(readings, ["signal_id", "phase"], "ts", ["event_id"], "sample_idx")
    return ordered.select(
        "signal_id", F.col("signal_id").alias("equipment_id"), "phase", "sample_idx", "value",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS readings in time, long form, gaps as NULL."""
    kind = F.col("event_type")
    phase = F.when(kind == "click", "a").when(kind == "view", "b").when(kind == "purchase", "c")
    return (
        table(spark, sf_dir, "events")
        .where(kind.isin("click", "view", "purchase"))
        .select(
            (F.col("user_id") % 5).alias("equipment_id"),
            phase.alias("phase"),
            F.col("ts"),
            F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
            F.col("event_id").alias("id"),
        )
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    role = F.col("user_id") % 4
    address = F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string"))
    action = (
        F.when(kind == "error", "failed_login")
        .when(kind == "signup", "permission_denied")
        .when(kind == "click", "login")
        .when(kind == "view", "signal_view")
        .otherwise("file_upload")
    )
    endpoint = F.when(kind == "view", "/api/v1/signals").when(kind == "purchase", "/api/v1/upload")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    digest = F.sha2(
        F.concat(F.col("user_id").cast("string"), action, stamp, address, F.coalesce(endpoint, F.lit(""))), 256
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.when(role == 0, "admin").when(role == 1, "engineer").when(role == 2, "operator").otherwise("guest")
        .alias("user_role"),
        action.alias("action_type"),
        F.when(kind == "error", "failure").when(kind == "signup", "denied").otherwise("success").alias("result"),
        endpoint.alias("endpoint"),
        address.alias("request_ip"),
        "ts",
        # readings above 150 stand for tampered rows
        F.when(F.col("value") > 150, F.sha2(digest, 256)).otherwise(digest).alias("integrity_hash"),
    )


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("task_name"), "ts",
        F.col("value").alias("seconds"), (F.col("user_id") % 5).alias("equipment_id"),
    )


def matrix(spark: SparkSession, sf_dir: str, outlier_every: int | None = None) -> DataFrame:
    """``(id, x ARRAY<DOUBLE>)`` from the embeddings; optionally every n-th row moved away by 3 per element."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    if outlier_every:
        moved = F.transform("embedding", lambda v: v.cast("double") + 3.0)
        x = F.when(F.col("vec_id") % outlier_every == 0, moved).otherwise(x)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"))
