"""Relational reports over equipment, signals, features, predictions and maintenance.

Dimension joins carry no broadcast hint: Catalyst broadcasts a side only when its
size statistics, or the sizes AQE measured, are under the session's threshold,
and sorts and merges otherwise.  Reports that gather several fact tables per
machine stack the facts and aggregate once instead of joining one frame per
subquery.  Result order is left to the caller except where it is the feature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from motorlens.functions import parcels as P
from motorlens.functions.clock import Moment, after, before, floor_to, moment, seconds_between, within
from motorlens.functions.expressions import PHASES, banded, mean_of_present, present_phases
from motorlens.session import materialise

# rows from which a report of wide rows packs them for the shuffle
PACKED_FROM = 2_000_000
# fixed values of the reports
LISTED_ABOVE = 0.5
HIGH_RISK_ABOVE = 0.7
SEVERITY_BANDS = [(0.8, "critical"), (0.6, "high"), (0.4, "medium")]
DAILY_STATUS_BANDS = [(10, "critical"), (5, "warning"), (0, "attention")]


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def locate_features(features: DataFrame, signals: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Features with the machine of their recording."""
    owner = signals.select(F.col("id").alias("raw_id"), "equipment_id")
    chosen = features if columns is None else features.select("raw_id", *columns)
    return chosen.join(owner, "raw_id")


def locate_predictions(
    predictions: DataFrame, features: DataFrame, signals: DataFrame, feature_columns: list[str] | None = None
) -> DataFrame:
    """Predictions with the recording, machine and chosen columns of their feature row."""
    source = features.select(F.col("id").alias("feature_id"), "raw_id", *(feature_columns or []))
    owner = signals.select(F.col("id").alias("raw_id"), "equipment_id")
    return predictions.join(source, "feature_id").join(owner, "raw_id")


def _owners(signals: DataFrame, equipment: DataFrame) -> DataFrame:
    """Recordings with code and name of their machine: the small sides meet first, so that wide rows are shuffled once."""
    machine = equipment.select(
        F.col("id").alias("equipment_id"), "equipment_code", F.col("name").alias("equipment_name")
    )
    return signals.select(F.col("id").alias("raw_id"), "equipment_id").join(machine, "equipment_id")


def signals_with_equipment(signals: DataFrame, equipment: DataFrame) -> DataFrame:
    machine = equipment.select(
        F.col("id").alias("equipment_id"), "equipment_code", F.col("name").alias("equipment_name"),
        F.col("type").alias("equipment_type"), F.col("status").alias("equipment_status"), "location",
    )
    return signals.join(machine, "equipment_id").select(
        "id", "equipment_id", "equipment_code", "equipment_name", "equipment_type", "equipment_status", "location",
        "recorded_at", "sample_rate_hz", "samples_count",
        F.expr("try_divide(samples_count * 1000, sample_rate_hz)").cast("bigint").alias("duration_ms"),
        F.col("has_a").alias("has_phase_a"), F.col("has_b").alias("has_phase_b"), F.col("has_c").alias("has_phase_c"),
        "file_name", "processed", "created_at",
    )


def features_analysis(features: DataFrame, signals: DataFrame, equipment: DataFrame) -> DataFrame:
    rms = [F.col(f"rms_{p}") for p in PHASES]
    zero = F.lit(0.0)
    kept = [f"{stat}_{p}" for stat in ("rms", "crest", "kurt", "skew", "mean", "std") for p in PHASES]
    ranges = [(F.col(f"max_{p}") - F.col(f"min_{p}")).alias(f"range_{p}") for p in PHASES]
    rows = features.select("id", "raw_id", "window_start", "window_end", *kept, *ranges, "created_at")
    return rows.join(_owners(signals, equipment), "raw_id").select(
        "id", "raw_id", "equipment_id", "equipment_code", "equipment_name", "window_start", "window_end",
        (F.unix_millis(F.col("window_end").cast("timestamp")) - F.unix_millis(F.col("window_start").cast("timestamp")))
        .alias("window_size_ms"),
        *kept,
        (F.coalesce(rms[0], zero) + F.coalesce(rms[1], zero) + F.coalesce(rms[2], zero)).alias("rms_total"),
        mean_of_present(rms).alias("rms_avg"),
        F.greatest(*[F.coalesce(F.col(f"crest_{p}"), zero) for p in PHASES]).alias("crest_max"),
        *[f"range_{p}" for p in PHASES],
        "created_at",
    )


def predictions_detailed(
    predictions: DataFrame, features: DataFrame, signals: DataFrame, equipment: DataFrame, defect_types: DataFrame,
    packed_from: int = PACKED_FROM,
) -> DataFrame:
    """Predictions with their feature's window, its machine and the defect, if it is listed.

    From ``packed_from`` predictions and features on, both cross the shuffles in compressed
    parcels, and every task joins a slot of them in memory.
    """
    source = features.select(F.col("id").alias("feature_id"), "raw_id", "window_start", "window_end")
    rows = predictions.select(
        "id", "feature_id", "defect_type_id", "probability", "predicted_severity", "confidence", "model_name", "model_version", "created_at")
    defect = defect_types.select(
        F.col("id").alias("defect_type_id"), F.col("code").alias("defect_code"), F.col("name").alias("defect_name"),
        F.col("category").alias("defect_category"),
    )
    owners = _owners(signals, equipment)
    # features are narrow here, so they meet their machines before the predictions
    joined = rows.join(defect, "defect_type_id", "left").join(source.join(owners, "raw_id"), "feature_id").select(
        "id", "feature_id", "raw_id", "equipment_id", "equipment_code", "equipment_name", "window_start", "window_end",
        "defect_type_id", "defect_code", "defect_name", "defect_category", "probability", "predicted_severity",
        "confidence", "model_name", "model_version", "created_at",
    )
    pairs = [(rows, source, "feature_id"), (source, owners, "raw_id"), (rows, defect, "defect_type_id")]
    kinds = [(a.schema[key].dataType, b.schema[key].dataType) for a, b, key in pairs]
    n, m = rows.count(), source.count()
    if n + m < packed_from or any(a != b or not isinstance(a, (T.StringType, T.IntegralType)) for a, b in kinds):
        return joined
    rows, source = rows.where(F.col("feature_id").isNotNull()), source.where(F.col("feature_id").isNotNull() & F.col("raw_id").isNotNull())
    by_feature, by_defect = P.slots_by(rows, n, "feature_id", "id", m), P.slots_by(rows, n, "defect_type_id", "id")
    by_recording = P.slots_by(source, m, "raw_id", "feature_id")
    listed = P.packed(defect.where(F.col("defect_type_id").isNotNull()).withColumn(P.SLOT, F.explode(by_defect.every)), P.LOOKUP)
    owned = P.packed(owners.where(F.col("raw_id").isNotNull()).withColumn(P.SLOT, F.explode(by_recording.every)), P.LOOKUP)
    rows = P.packed(rows.select("*", by_defect.one.alias(P.SLOT), by_feature.one.alias(P.NEXT)), P.ROWS)
    source = P.packed(source.select("*", by_recording.one.alias(P.SLOT), F.explode(by_feature.every).alias(P.NEXT)), P.ROWS)
    absent = {c: to_arrow_type(defect.schema[c].dataType) for c in defect.columns[1:]}
    return P.met_rows(
        P.met(rows, listed, by_defect.n, "defect_type_id", absent, P.ROWS),
        P.met(source, owned, by_recording.n, "raw_id", None, P.LOOKUP), by_feature.n, "feature_id", joined.schema)


def equipment_summary(
    equipment: DataFrame, signals: DataFrame, features: DataFrame, predictions: DataFrame, maintenance: DataFrame,
    fanout: bool = False,
) -> DataFrame:
    """Counts per machine.

    Children are counted per parent before they meet, so nothing is multiplied.
    ``fanout=True`` gives the counts of a plain chain of left joins instead: every
    signal counts once per prediction or feature row below it.
    """
    risky = F.count_if(F.col("probability") > HIGH_RISK_ABOVE).alias("high_risk")
    critical = F.count_if(F.col("predicted_severity") == "critical").alias("critical")
    per_feature = predictions.groupBy("feature_id").agg(F.count(F.lit(1)).alias("p"), risky, critical)
    per_signal = (
        features.select("raw_id", F.col("id").alias("feature_id"))
        .join(per_feature, "feature_id", "left")
        .groupBy("raw_id")
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            # rows a left join keeps: one per prediction, one for a feature without any
            F.sum(F.greatest(F.coalesce("p", F.lit(0)), F.lit(1))).alias("n_joined"),
            F.sum("p").alias("n_predictions"),
            F.sum("high_risk").alias("high_risk"),
            F.sum("critical").alias("critical"),
        )
    )
    joined = signals.select(F.col("id").alias("raw_id"), "equipment_id", "recorded_at", "processed").join(
        per_signal, "raw_id", "left"
    )
    zero = F.lit(0)
    weight = F.coalesce("n_joined", F.lit(1)) if fanout else F.lit(1)
    n_features = F.coalesce(F.col("n_joined") if fanout else F.col("n_features"), zero)

    def total(column: Column | str) -> Column:
        return F.coalesce(F.sum(column), zero).cast("bigint")

    facts = joined.select(
        "equipment_id", "recorded_at", weight.alias("signals"),
        F.when(~F.col("processed"), weight).otherwise(zero).alias("unprocessed"), n_features.alias("n_features"),
        F.coalesce("n_predictions", zero).alias("n_predictions"), F.coalesce("high_risk", zero).alias("high_risk"),
        F.coalesce("critical", zero).alias("critical"),
    )
    serviced = maintenance.where(F.col("status") == "completed").select("equipment_id", "completed_at")
    per_machine = (
        stack([facts, serviced])
        .groupBy(F.col("equipment_id").alias("id"))
        .agg(
            total("signals").alias("total_signals"),
            F.min("recorded_at").alias("first_signal_at"),
            F.max("recorded_at").alias("last_signal_at"),
            total("unprocessed").alias("unprocessed_signals"),
            total("n_features").alias("total_features"),
            total("n_predictions").alias("total_predictions"),
            total("high_risk").alias("high_risk_predictions"),
            total("critical").alias("critical_predictions"),
            F.max("completed_at").alias("last_maintenance_at"),
        )
    )
    counts = [c for c in per_machine.columns if c.startswith(("total_", "unprocessed", "high_risk", "critical"))]
    return equipment.select("id", "equipment_code", "name", "type", "status", "location").join(
        per_machine, "id", "left"
    ).fillna(0, subset=counts)


def rms_trends(features: DataFrame, signals: DataFrame, equipment: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    recent = features.where(within("window_start", as_of, days, "DAY"))
    rms = [f"rms_{p}" for p in PHASES]
    located = locate_features(recent, signals, ["window_start", *rms])
    daily = located.groupBy("equipment_id", floor_to("day", "window_start").alias("trend_date")).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in rms],
        *[F.min(c).alias(f"min_{c}") for c in rms],
        *[F.max(c).alias(f"max_{c}") for c in rms],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in rms],
        F.count(F.lit(1)).alias("measurements_count"),
    )
    machine = equipment.select(
        F.col("id").alias("equipment_id"), "equipment_code", F.col("name").alias("equipment_name")
    )
    return daily.join(machine, "equipment_id")


def anomaly_analysis(
    predictions: DataFrame, features: DataFrame, signals: DataFrame, equipment: DataFrame, defect_types: DataFrame,
    as_of: Moment,
) -> DataFrame:
    listed = predictions.where((F.col("probability") > LISTED_ABOVE) & (F.col("created_at") <= moment(as_of)))
    located = locate_predictions(listed, features, signals)
    category = defect_types.select(F.col("id").alias("defect_type_id"), F.col("category").alias("defect_category"))

    def last(amount: int, unit: str) -> Column:
        return F.count_if(F.col("created_at") > before(as_of, amount, unit))

    grouped = (
        located.join(category, "defect_type_id", "left")
        .groupBy("equipment_id", "defect_category", "predicted_severity")
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            last(24, "HOUR").alias("last_24h"),
            last(7, "DAY").alias("last_7d"),
            last(30, "DAY").alias("last_30d"),
            F.avg("probability").alias("avg_probability"),
            F.max("probability").alias("max_probability"),
            F.min("probability").alias("min_probability"),
            F.max("created_at").alias("last_prediction_at"),
        )
    )
    machine = equipment.select(
        F.col("id").alias("equipment_id"), "equipment_code", F.col("name").alias("equipment_name")
    )
    return grouped.join(machine, "equipment_id")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Several one-row aggregates as one row: stacked and folded, without a cross join."""
    stacked = stack(parts)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def system_health(
    signals: DataFrame, features: DataFrame, predictions: DataFrame, equipment: DataFrame, users: DataFrame,
    maintenance: DataFrame, as_of: Moment,
) -> DataFrame:
    n = F.count(F.lit(1))
    soon = F.col("scheduled_date").between(moment(as_of), after(as_of, 7, "DAY"))
    return one_row(
        [
            signals.agg(
                n.alias("total_signals"), F.count_if(~F.col("processed")).alias("unprocessed_signals"),
                F.max("recorded_at").alias("last_signal_at"),
            ),
            features.agg(n.alias("total_features"), F.max("created_at").alias("last_feature_at")),
            predictions.agg(
                n.alias("total_predictions"), F.max("created_at").alias("last_prediction_at"),
                F.count_if((F.col("predicted_severity") == "critical") & within("created_at", as_of, 24, "HOUR"))
                .alias("critical_alerts_24h"),
            ),
            equipment.agg(
                n.alias("total_equipment"), F.count_if(F.col("status") == "active").alias("active_equipment"),
                F.count_if(F.col("status") == "fault").alias("faulty_equipment"),
            ),
            users.agg(F.count_if("is_active").alias("active_users")),
            maintenance.agg(F.count_if((F.col("status") == "scheduled") & soon).alias("scheduled_maintenance_7d")),
        ]
    )


def performance_metrics(
    signals: DataFrame, features: DataFrame, predictions: DataFrame, as_of: Moment, days: int = 30
) -> DataFrame:
    def daily(frame: DataFrame, kind: str, size: Column, *more: Column) -> DataFrame:
        return (
            frame.where(within("created_at", as_of, days, "DAY"))
            .groupBy(floor_to("day", "created_at").alias("metric_date"))
            .agg(F.lit(kind).alias("metric_type"), F.count(F.lit(1)).alias("count"), F.avg(size).alias("avg_samples"), *more)
        )

    phases = sum((F.col(f"has_{p}").cast("bigint") for p in PHASES), F.lit(0).cast("bigint"))
    window_ms = seconds_between("window_start", "window_end") * 1000
    return stack(
        [
            daily(signals, "signals", F.col("samples_count"), F.sum(phases).alias("total_phases")),
            daily(features, "features", window_ms),
            daily(predictions, "predictions", F.col("probability")),
        ]
    )


def _recent_facts(
    signals: DataFrame, features: DataFrame, predictions: DataFrame, maintenance: DataFrame, as_of: Moment,
    hours: int = 24,
) -> DataFrame:
    """Signals, recent features, recent predictions and coming maintenance of every machine, stacked."""
    rms = [f"rms_{p}" for p in PHASES]
    recent_features = locate_features(
        features.where(within("window_start", as_of, hours, "HOUR")), signals, rms
    ).select("equipment_id", *rms, mean_of_present([F.col(c) for c in rms]).alias("rms_mean"))
    recent_predictions = locate_predictions(
        predictions.where(within("created_at", as_of, hours, "HOUR")).select(
            "feature_id", "probability", "predicted_severity"
        ),
        features,
        signals,
    ).select(
        "equipment_id", "probability", (F.col("predicted_severity") == "critical").cast("bigint").alias("critical")
    )
    coming = maintenance.where(
        (F.col("status") == "scheduled") & (F.col("scheduled_date") > moment(as_of))
    ).select("equipment_id", "scheduled_date")
    recorded = signals.select("equipment_id", "recorded_at", F.lit(1).cast("bigint").alias("signal"))
    return stack([recorded, recent_features, recent_predictions, coming])


def dashboard_summary(
    equipment: DataFrame, signals: DataFrame, features: DataFrame, predictions: DataFrame, maintenance: DataFrame,
    as_of: Moment,
) -> DataFrame:
    facts = _recent_facts(signals, features, predictions, maintenance, as_of).groupBy("equipment_id").agg(
        F.max("recorded_at").alias("last_signal_at"),
        *[F.avg(f"rms_{p}").alias(f"avg_rms_{p}_24h") for p in PHASES],
        F.max("probability").alias("max_risk_24h"),
        F.sum("critical").alias("critical_alerts_24h"),
        F.min("scheduled_date").alias("next_maintenance_at"),
    )
    machine = equipment.where(F.col("status") != "inactive").select(
        F.col("id").alias("equipment_id"), "equipment_code", F.col("name").alias("equipment_name"),
        F.col("type").alias("equipment_type"), F.col("status").alias("equipment_status"), "location",
    )
    return (
        machine.join(facts, "equipment_id", "left")
        .fillna(0, subset=["critical_alerts_24h"])
        .withColumn("last_updated", moment(as_of))
    )


def refresh(spark, name: str, summary: DataFrame, path: str) -> DataFrame:
    """Rebuild a stored summary and read it back from the table's files."""
    target = f"{path.rstrip('/')}/{name}"
    summary.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def equipment_health(
    equipment: DataFrame, signals: DataFrame, features: DataFrame, predictions: DataFrame, maintenance: DataFrame,
    as_of: Moment,
) -> DataFrame:
    """Health score 0..100 per machine that is not inactive, worst first."""
    facts = _recent_facts(signals, features, predictions, maintenance, as_of).groupBy("equipment_id").agg(
        F.max("recorded_at").alias("last_signal_at"),
        F.count("signal").alias("total_signals"),
        F.avg("rms_mean").alias("avg_rms_24h"),
        F.max("probability").alias("max_risk_24h"),
        F.sum("critical").alias("critical_alerts_24h"),
        F.min("scheduled_date").alias("next_maintenance_at"),
    )
    score = F.lit(100.0) - F.coalesce(F.col("max_risk_24h") * 100, F.lit(0.0)) - F.col("critical_alerts_24h") * 10
    return (
        equipment.where(F.col("status") != "inactive")
        .select(F.col("id").alias("equipment_id"), "equipment_code", F.col("name").alias("equipment_name"), "status")
        .join(facts, "equipment_id", "left")
        .fillna(0, subset=["total_signals", "critical_alerts_24h"])
        .withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
        .orderBy("health_score", "equipment_name", "equipment_id")
    )


def health_index(latest_features: DataFrame, anomalies: DataFrame, equipment: DataFrame, as_of: Moment) -> DataFrame:
    """Dashboard score from the newest feature row and the last day's anomalies; 50 without features."""
    penalty = F.lit(0)
    for p in PHASES:
        rms, crest = F.col(f"rms_{p}"), F.col(f"crest_{p}")
        penalty = penalty + F.when(rms > 50, 10).when(rms > 40, 5).otherwise(0)
        penalty = penalty + F.when((crest > 2.0) | (crest < 1.0), 8).otherwise(0)
    recent = (
        anomalies.where(within("created_at", as_of, 24, "HOUR"))
        .groupBy("equipment_id")
        .agg(F.count(F.lit(1)).alias("recent_anomalies"))
    )
    measured = latest_features.select("equipment_id", penalty.alias("penalty"))
    score = F.lit(100.0) - F.col("penalty") - F.col("recent_anomalies") * 15
    return (
        equipment.select(F.col("id").alias("equipment_id"))
        .join(measured, "equipment_id", "left")
        .join(recent, "equipment_id", "left")
        .fillna(0, subset=["recent_anomalies"])
        .select(
            "equipment_id",
            "recent_anomalies",
            F.when(F.col("penalty").isNull(), F.lit(50.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
            .alias("health_index"),
        )
    )


def newest_per(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row per key as a mergeable aggregate, so a hot key is reduced before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(ts, tie)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def paged(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page; Spark keeps only the first ``page * page_size`` rows per task."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def list_signals(
    signals: DataFrame, equipment_id: int | str | None = None, states: list[str] | None = None, page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    chosen = signals
    if equipment_id is not None:
        chosen = chosen.where(F.col("equipment_id") == equipment_id)
    if states:
        chosen = chosen.where(F.col("status").isin(*states))
    phases = F.array_compact(
        F.array(*[F.when(F.col(f"has_{p}"), F.lit(label)) for p, label in zip(PHASES, ("A", "B", "C"))])
    )
    listed = chosen.select(
        "id", "equipment_id", "recorded_at", "sample_rate_hz", "samples_count", "file_name", "status",
        phases.alias("phases"),
    )
    return paged(listed, [F.col("recorded_at").desc(), F.col("id")], page, page_size)


def list_equipment(equipment: DataFrame) -> DataFrame:
    active = equipment.where(F.col("status") == "active")
    return active.select("id", "equipment_code", "name", "type", "location").orderBy("name", "id")


def _anomalies(located: DataFrame, start: Moment, end: Moment, min_confidence: float | None) -> DataFrame:
    flagged = F.coalesce(F.col("anomaly_detected"), F.lit(False)) | (F.col("probability") > LISTED_ABOVE)
    chosen = located.where(flagged & F.col("created_at").between(moment(start), moment(end))).withColumn(
        "confidence", F.coalesce("confidence", "probability")
    )
    return chosen if min_confidence is None else chosen.where(F.col("confidence") >= min_confidence)


def list_anomalies(
    located: DataFrame, start: Moment, end: Moment, equipment_id: int | str | None = None,
    min_confidence: float | None = None, page: int = 1, page_size: int = 50,
) -> DataFrame:
    """Anomalies of a period, newest first; ``located`` has the feature's times and RMS columns."""
    chosen = located if equipment_id is None else located.where(F.col("equipment_id") == equipment_id)
    rows = _anomalies(chosen, start, end, min_confidence).select(
        "id", "feature_id", "equipment_id", F.lit("statistical_deviation").alias("anomaly_type"), "confidence",
        banded(F.col("confidence"), SEVERITY_BANDS, "low").alias("severity"),
        F.col("created_at").alias("detected_at"), "window_start", "window_end",
        present_phases("rms").alias("affected_phases"), "model_name", "model_version",
    )
    return paged(rows, [F.col("detected_at").desc(), F.col("id")], page, page_size)


def anomaly_period_summary(located: DataFrame, start: Moment, end: Moment, days: int) -> DataFrame:
    rows = _anomalies(located, start, end, None)
    return rows.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.avg("confidence").alias("average_confidence"),
        F.max("confidence").alias("max_confidence"),
        (F.count(F.lit(1)) / max(1, days)).alias("anomalies_per_day"),
    ).withColumn("period_days", F.lit(days))


def anomaly_daily_distribution(located: DataFrame, start: Moment, end: Moment) -> DataFrame:
    rows = _anomalies(located, start, end, None)
    return rows.groupBy("equipment_id", F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    return newest_per(forecasts, ["equipment_id"], "created_at", "id")


def daily_report(equipment: DataFrame, located: DataFrame, forecasts: DataFrame, as_of: Moment) -> DataFrame:
    """Anomalies of the last day and the newest forecast of every active machine."""
    recent = (
        located.where(F.col("anomaly_detected") & within("created_at", as_of, 24, "HOUR"))
        .groupBy("equipment_id")
        .agg(F.count(F.lit(1)).alias("anomalies_24h"))
    )
    forecast = latest_forecast(forecasts.where(F.col("created_at") <= moment(as_of))).select(
        "equipment_id", F.col("created_at").alias("forecast_at"), "max_probability"
    )
    return (
        equipment.where(F.col("status") == "active")
        .select(F.col("id").alias("equipment_id"), F.col("name").alias("equipment_name"))
        .join(recent, "equipment_id", "left")
        .join(forecast, "equipment_id", "left")
        .fillna(0, subset=["anomalies_24h"])
        .withColumn("status", banded(F.col("anomalies_24h"), DAILY_STATUS_BANDS, "normal", strict=True))
    )


def daily_totals(report: DataFrame) -> DataFrame:
    critical, warning = F.count_if(F.col("status") == "critical"), F.count_if(F.col("status") == "warning")
    total = F.count(F.lit(1))
    return report.agg(
        total.alias("total_equipment"),
        critical.alias("critical_equipment"),
        warning.alias("warning_equipment"),
        (total - critical - warning).alias("normal_equipment"),
        F.coalesce(F.sum("anomalies_24h"), F.lit(0)).cast("bigint").alias("total_anomalies_24h"),
    )


def daily_recommendations(report: DataFrame) -> DataFrame:
    """``(advice, equipment_name)`` rows; the all-normal line stands alone.

    One row per machine rather than one joined text per advice, so a fleet-wide
    incident does not end up in a single cell.
    """
    advices = F.array_compact(
        F.array(
            F.when(F.col("status") == "critical", F.lit("check immediately")),
            F.when(F.col("status") == "warning", F.lit("schedule a check")),
            F.when(F.col("anomalies_24h") > 20, F.lit("raised anomaly activity")),
        )
    )
    named = report.select(F.explode(advices).alias("advice"), "equipment_name", "equipment_id")
    troubled = F.count_if(F.col("status").isin("critical", "warning"))
    calm = report.agg(troubled.alias("n")).where(F.col("n") == 0).select(
        F.lit("all equipment works normally").alias("advice")
    )
    return stack([named, calm])


def processing_health(
    signals: DataFrame, features: DataFrame, located: DataFrame, equipment: DataFrame, as_of: Moment
) -> DataFrame:
    """One row: signals by state, features, last day's predictions and the shares the alerts use."""
    recent = located.where(within("created_at", as_of, 24, "HOUR"))
    states = ("pending", "processing", "completed", "failed")
    row = one_row(
        [
            signals.agg(
                F.count(F.lit(1)).alias("signals_total"),
                *[F.count_if(F.col("status") == s).alias(f"signals_{s}") for s in states],
            ),
            features.agg(F.count(F.lit(1)).alias("features_total")),
            recent.agg(
                F.count(F.lit(1)).alias("predictions_24h"),
                F.count_if("anomaly_detected").alias("anomalies_24h"),
                F.count_distinct(F.when(F.col("anomaly_detected"), F.col("equipment_id"))).alias("equipment_with_anomalies"),
            ),
            equipment.agg(F.count_if(F.col("status") == "active").alias("active_equipment")),
        ]
    )
    one = F.lit(1)
    return row.withColumn("anomaly_rate", F.col("anomalies_24h") / F.greatest(one, F.col("predictions_24h"))).withColumn(
        "anomaly_equipment_rate", F.col("equipment_with_anomalies") / F.greatest(one, F.col("active_equipment"))
    )


def processing_alerts(health: DataFrame) -> DataFrame:
    failed_share = F.try_divide(F.col("signals_failed"), F.col("signals_total"))
    affected = F.try_divide(F.col("equipment_with_anomalies"), F.col("active_equipment"))

    def rule(level: str, kind: str, value: Column, limit: float) -> Column:
        return F.struct(
            F.lit(level).alias("level"), F.lit(kind).alias("type"), value.cast("double").alias("value"),
            F.lit(float(limit)).alias("limit"),
        )

    rules = F.array(
        rule("warning", "processing_failures", failed_share, 0.1),
        rule("warning", "high_anomaly_count", F.col("anomalies_24h"), 50),
        rule("critical", "widespread_anomalies", affected, 0.3),
        rule("warning", "processing_backlog", F.col("signals_processing"), 100),
    )
    return health.select(F.inline(rules)).where(F.col("value") > F.col("limit"))


def files_overview(signals: DataFrame) -> DataFrame:
    duration = F.try_divide(F.col("samples_count").cast("double"), F.nullif(F.col("sample_rate_hz"), F.lit(0)))
    newest = F.max_by("file_name", F.struct("recorded_at", "id"))
    return signals.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("samples_count").alias("total_samples"),
        F.avg(F.when(duration != 0, duration)).alias("avg_duration_seconds"),
        F.max("recorded_at").alias("latest_recorded_at"),
        newest.alias("latest_file"),
    )


def diagnosis_overview(located: DataFrame) -> DataFrame:
    found = F.count_if("anomaly_detected")
    return located.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        found.alias("anomalies"),
        (found / F.count(F.lit(1)) * 100).alias("anomaly_percent"),
        F.max("created_at").alias("last_check"),
    )


def anomaly_table(located: DataFrame, defect_types: DataFrame) -> DataFrame:
    """Anomalous predictions with their defect, as the diagnosis page lists them."""
    defect = defect_types.select(F.col("id").alias("defect_type_id"), F.col("name").alias("defect_type"))
    return (
        located.where("anomaly_detected")
        .join(defect, "defect_type_id", "left")
        .select(
            "id", "equipment_id", "created_at", F.coalesce("defect_type", F.lit("unknown")).alias("defect_type"),
            "probability", "predicted_severity", "model_name",
        )
    )


def anomaly_timeline(located: DataFrame) -> DataFrame:
    """Points of the timeline per day, split into normal and anomalous."""
    series = F.when(F.col("anomaly_detected"), "anomalous").otherwise("normal")
    return located.groupBy("equipment_id", F.to_date("created_at").alias("date"), series.alias("series")).agg(
        F.count(F.lit(1)).alias("points"), F.avg("probability").alias("mean_probability"),
        F.max("probability").alias("max_probability"),
    )


def usage_statistics(
    signals: DataFrame, predictions: DataFrame, audit: DataFrame, start: Moment, end: Moment
) -> DataFrame:
    def during(column: str) -> Column:
        return F.col(column).between(moment(start), moment(end))

    return one_row(
        [
            audit.where(during("ts")).agg(
                F.count_if(F.col("action_type") == "file_upload").alias("files_uploaded"),
                F.count(F.lit(1)).alias("api_requests"),
            ),
            signals.where(during("created_at")).agg(F.count_if("processed").alias("signals_processed")),
            predictions.where(during("created_at")).agg(F.count_if("anomaly_detected").alias("anomalies_detected")),
        ]
    )


def daily_activity(audit: DataFrame, start: Moment, end: Moment) -> DataFrame:
    chosen = audit.where(F.col("ts").between(moment(start), moment(end)))
    return chosen.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("requests"))


def anomaly_types(predictions: DataFrame, defect_types: DataFrame, start: Moment, end: Moment) -> DataFrame:
    chosen = predictions.where(
        F.col("anomaly_detected") & F.col("created_at").between(moment(start), moment(end))
    )
    category = defect_types.select(F.col("id").alias("defect_type_id"), "category")
    per_type = chosen.groupBy("defect_type_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_type.join(category, "defect_type_id", "left")
        .groupBy(F.coalesce("category", F.lit("unknown")).alias("category"))
        .agg(F.sum("n").alias("anomalies"))
    )


def expired_signals(signals: DataFrame, as_of: Moment, days: int = 365) -> DataFrame:
    return signals.where(F.col("recorded_at") < before(as_of, days, "DAY"))


def apply_retention(
    signals: DataFrame, features: DataFrame, predictions: DataFrame, logs: DataFrame, sessions: DataFrame,
    as_of: Moment, days: int = 365,
) -> dict[str, DataFrame]:
    """What stays: old signals go with their features and predictions, old logs and expired sessions go too."""
    cutoff = before(as_of, days, "DAY")
    kept_signals = signals.where(~(F.col("recorded_at") < cutoff))
    gone = expired_signals(signals, as_of, days).select(F.col("id").alias("raw_id"))
    kept_features = features.join(gone, "raw_id", "left_anti")
    gone_features = features.join(gone, "raw_id", "left_semi").select(F.col("id").alias("feature_id"))
    return {
        "signals": kept_signals,
        "features": kept_features,
        "predictions": predictions.join(gone_features, "feature_id", "left_anti"),
        "logs": logs.where(~(F.col("created_at") < cutoff)),
        "sessions": sessions.where(~(F.col("expires_at") < moment(as_of))),
    }


def retention_counts(
    signals: DataFrame, logs: DataFrame, sessions: DataFrame, as_of: Moment, days: int = 365
) -> DataFrame:
    """``(table_name, deleted_count)`` for the scheduled clean-up."""
    cutoff = before(as_of, days, "DAY")

    def counted(name: str, frame: DataFrame, gone: Column) -> DataFrame:
        return frame.agg(F.lit(name).alias("table_name"), F.count_if(gone).alias("deleted_count"))

    return stack(
        [
            counted("raw_signals", signals, F.col("recorded_at") < cutoff),
            counted("system_logs", logs, F.col("created_at") < cutoff),
            counted("user_sessions", sessions, F.col("expires_at") < moment(as_of)),
        ]
    )


def apply_cleanup(signals: DataFrame, predictions: DataFrame, as_of: Moment, days: int = 90) -> dict[str, DataFrame]:
    """The lighter variant: old predictions and old failed signals go, nothing cascades."""
    cutoff = before(as_of, days, "DAY")
    old_failed = (F.col("created_at") < cutoff) & (F.col("status") == "failed")
    return {
        "predictions": predictions.where(~(F.col("created_at") < cutoff)),
        "signals": signals.where(~old_failed),
    }


def cleanup_counts(signals: DataFrame, predictions: DataFrame, as_of: Moment, days: int = 90) -> DataFrame:
    cutoff = before(as_of, days, "DAY")
    old_failed = (F.col("created_at") < cutoff) & (F.col("status") == "failed")
    return stack(
        [
            predictions.agg(
                F.lit("predictions").alias("table_name"), F.count_if(F.col("created_at") < cutoff).alias("deleted_count")
            ),
            signals.agg(F.lit("failed_signals").alias("table_name"), F.count_if(old_failed).alias("deleted_count")),
        ]
    )


def rms_zscore_anomalies(
    features: DataFrame, signals: DataFrame, as_of: Moment, lookback_days: int = 30, sigma: float = 3.0
) -> DataFrame:
    """Recent RMS values against each machine's and phase's own baseline, all machines at once."""
    rms = [f"rms_{p}" for p in PHASES]
    recent = features.where(within("window_start", as_of, lookback_days, "DAY"))
    located = locate_features(recent, signals, ["id", "window_start", *rms])
    entries = F.array(*[F.struct(F.lit(p.upper()).alias("phase"), F.col(f"rms_{p}").alias("rms_value")) for p in PHASES])
    long = located.select("id", "equipment_id", "window_start", F.inline(entries)).where(F.col("rms_value").isNotNull())
    baseline = long.groupBy("equipment_id", "phase").agg(
        F.avg("rms_value").alias("mean_value"), F.stddev_samp("rms_value").alias("std_value")
    )
    # stored, so that its size is known and a hot machine can be split in the join
    baseline = materialise(baseline)
    last_day = long.where(within("window_start", as_of, 24, "HOUR"))
    z = F.try_divide(F.col("rms_value") - F.col("mean_value"), F.nullif(F.col("std_value"), F.lit(0.0)))
    return (
        last_day.join(baseline, ["equipment_id", "phase"])
        .withColumn("z_score", z)
        .withColumn("is_anomaly", F.abs("z_score") > sigma)
        .withColumnRenamed("id", "feature_id")
    )


def diagnostic_report_rows(
    equipment: DataFrame, signals: DataFrame, features: DataFrame, located: DataFrame
) -> DataFrame:
    """Per machine: its newest recording's newest feature values, its anomaly count and the advice given."""
    metrics = [f"{stat}_{p}" for stat in ("rms", "crest", "kurt", "skew") for p in PHASES]
    last_recording = newest_per(signals.select("equipment_id", "recorded_at", "id"), ["equipment_id"], "recorded_at", "id")
    last_recording = last_recording.withColumnRenamed("id", "raw_id")
    # reduced where they are read, so that no feature row is shuffled whole
    measured = newest_per(features.select("raw_id", "window_start", "id", *metrics), ["raw_id"], "window_start", "id").select("raw_id", *metrics)
    found = located.groupBy("equipment_id").agg(F.count_if("anomaly_detected").alias("anomaly_count"))
    return (
        equipment.select(F.col("id").alias("equipment_id"), F.col("name").alias("equipment_name"))
        .join(last_recording, "equipment_id", "left")
        .join(measured, "raw_id", "left")
        .join(found, "equipment_id", "left")
        .fillna(0, subset=["anomaly_count"])
        .withColumn("advice", F.when(F.col("anomaly_count") > 0, "detailed diagnosis").otherwise("continue monitoring"))
    )
