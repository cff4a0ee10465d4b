"""Registered queries: feature matrix and anomaly models."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions.expressions import FEATURE_COLUMNS, PHASES
from motorlens.operators import clusters as C
from motorlens.operators import forest as I
from motorlens.operators import matrix as M
from motorlens.operators import metric as N
from motorlens.operators import models as A
from motorlens.operators import spectrum as P
from motorlens.operators import windows as W
from motorlens.plans.registry import query
from motorlens.plans.signal_queries import HOP, KERNEL, MIN_LENGTH, RATE, SIZE, stats_sql
from motorlens.plans.spectrum_queries import PEAK_FFT, PEAKS
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.session import table_folder
from motorlens.sources import star_tables as S

MODEL_COLUMNS = ["rms_a", "rms_b", "rms_c", "crest_a", "crest_c", "kurt_a", "skew_c"]
EPS, MIN_SAMPLES = 0.035, 5


@query(
    "training_frame",
    with_frames(
        "located_features equipment",
        f"""SELECT f.id, f.equipment_id, e.name AS equipment_name, f.window_start, {r6('f.rms_a')} AS rms_a
            FROM located_features f JOIN equipment e ON f.equipment_id = e.id
            ORDER BY f.window_start DESC, f.id LIMIT 5000""",
    ),
)
def training_frame(spark, sf_dir):
    rows = M.training_frame(S.features(spark, sf_dir), S.signals(spark, sf_dir), S.equipment(spark, sf_dir), limit=5000)
    return rows.select("id", "equipment_id", "equipment_name", "window_start", "rms_a")


@query(
    "training_frame_all",
    with_frames(
        "located_features equipment",
        f"""SELECT f.id, f.equipment_id, e.name AS equipment_name, f.window_start, {r6('f.rms_a')} AS rms_a
            FROM located_features f JOIN equipment e ON f.equipment_id = e.id""",
    ),
)
def training_frame_all(spark, sf_dir):
    rows = M.training_frame(S.features(spark, sf_dir), S.signals(spark, sf_dir), S.equipment(spark, sf_dir))
    return rows.select("id", "equipment_id", "equipment_name", "window_start", "rms_a")


def _long_sql(expressions: dict[str, str], source: str = "features") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} FROM {source}" for c, e in expressions.items())


@query(
    "column_quantiles",
    with_frames(
        "features",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {p}::DOUBLE AS prob, {r6(f'quantile_cont({c}, {p})')} AS quantile FROM features"""
            for c in FEATURE_COLUMNS
            for p in (0.25, 0.5, 0.75)
        ),
    ),
)
def column_quantiles(spark, sf_dir):
    """Exact medians and quartiles of every feature column."""
    features = S.features(spark, sf_dir)
    found = M.column_quantiles(features, list(FEATURE_COLUMNS), [0.25, 0.5, 0.75])
    rows = [(c, p, q) for c, quantiles in found.items() for p, q in quantiles.items()]
    return spark.createDataFrame(rows, "column string, prob double, quantile double")


@query(
    "impute_median",
    with_frames(
        "features",
        "SELECT id, " + ", ".join(
            r6(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM features))") + f" AS {c}" for c in MODEL_COLUMNS
        ) + ", 0.0::DOUBLE AS nothing FROM features",
    ),
)
def impute_median(spark, sf_dir):
    features = S.features(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    filled, _ = M.impute_median(features, [*MODEL_COLUMNS, "nothing"])
    return filled.select("id", *MODEL_COLUMNS, "nothing")


@query(
    "select_by_variance",
    with_frames(
        "features",
        f"SELECT * FROM ({_long_sql({c: r6(f'var_samp({c})') + ' AS variance' for c in FEATURE_COLUMNS})}) WHERE variance > 0.01",
    ),
)
def select_by_variance(spark, sf_dir):
    features = S.features(spark, sf_dir)
    columns = list(FEATURE_COLUMNS)
    chosen, variances = M.select_by_variance(features, columns), M.column_variances(features, columns)
    return spark.createDataFrame([(c, variances[c]) for c in chosen], "column string, variance double")


@query(
    "robust_scale",
    with_frames(
        "features",
        "SELECT id, " + ", ".join(
            r6(
                f"(coalesce({c}, s.{c}_2) - s.{c}_2) / CASE WHEN s.{c}_3 - s.{c}_1 = 0 THEN 1 ELSE s.{c}_3 - s.{c}_1 END"
            ) + f" AS {c}" for c in MODEL_COLUMNS
        ) + " FROM features, (SELECT " + ", ".join(
            f"quantile_cont({c}, {q}) AS {c}_{i}" for c in MODEL_COLUMNS for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))
        ) + " FROM features) s",
    ),
)
def robust_scale(spark, sf_dir):
    """Also the application of a fitted scaler to rows with gaps."""
    features = S.features(spark, sf_dir)
    return M.fit_robust(features, MODEL_COLUMNS).transform(features).select("id", *MODEL_COLUMNS)


@query(
    "standard_scale",
    with_frames(
        "features",
        "SELECT id, " + ", ".join(
            r6(f"(coalesce({c}, 0) - s.{c}_m) / CASE WHEN s.{c}_s = 0 THEN 1 ELSE s.{c}_s END") + f" AS {c}" for c in MODEL_COLUMNS
        ) + " FROM features, (SELECT " + ", ".join(
            f"avg(coalesce({c}, 0)) AS {c}_m, stddev_pop(coalesce({c}, 0)) AS {c}_s" for c in MODEL_COLUMNS
        ) + " FROM features) s",
    ),
)
def standard_scale(spark, sf_dir):
    features = S.features(spark, sf_dir)
    return M.fit_standard(features, MODEL_COLUMNS).transform(features).select("id", *MODEL_COLUMNS)


@query(
    "transform_features",
    with_frames(
        "features",
        "SELECT id, " + ", ".join(
            r6(f"(coalesce({c}, s.{c}_2) - s.{c}_2) / CASE WHEN s.{c}_3 - s.{c}_1 = 0 THEN 1 ELSE s.{c}_3 - s.{c}_1 END") + f" AS {c}"
            for c in MODEL_COLUMNS
        ) + " FROM features, (SELECT " + ", ".join(
            f"quantile_cont({c}, {q}) AS {c}_{i}" for c in MODEL_COLUMNS for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))
        ) + " FROM features WHERE window_start < TIMESTAMP '1999-01-01') s WHERE window_start >= TIMESTAMP '1999-01-01'",
    ),
)
def transform_features(spark, sf_dir):
    """Fitted on older rows, applied to newer ones."""
    features = S.features(spark, sf_dir)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    scaler = M.fit_robust(features.where(F.col("window_start") < cut), MODEL_COLUMNS)
    return scaler.transform(features.where(F.col("window_start") >= cut)).select("id", *MODEL_COLUMNS)


def _matrix(spark, sf_dir):
    return S.matrix(spark, sf_dir, outlier_every=50)


def _components_sql() -> str:
    """Leading two components of the scaled columns: squared covariance matrices tend to the first one, which is then taken out."""
    d = len(MODEL_COLUMNS)
    scaled = ", ".join(
        f"(coalesce({c}, s.{c}_2) - s.{c}_2) / CASE WHEN s.{c}_3 - s.{c}_1 = 0 THEN 1 ELSE s.{c}_3 - s.{c}_1 END AS x{i}"
        for i, c in enumerate(MODEL_COLUMNS))
    quartiles = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{i}" for c in MODEL_COLUMNS for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
    covariances = ", ".join(f"covar_samp(x{i}, x{j})" for i in range(d) for j in range(d))
    trace = lambda m: " + ".join(f"{m}[{i * d + i + 1}]" for i in range(d))
    diagonal = lambda m: "[" + ", ".join(f"{m}[{i * d + i + 1}]" for i in range(d)) + "]"
    product = lambda row, column: f"list_sum(list_transform(range({d}), lambda k: {row} * {column}))"
    square = f"list_transform(range({d * d}), lambda i: {product(f'm[(i // {d}) * {d} + k + 1]', f'm[k * {d} + i % {d} + 1]')})"

    def component(n: int) -> str:
        # the largest loading is positive, since it is the column of the largest diagonal element
        return f"""
    power{n} AS (
      SELECT 0 AS step, list_transform(c, lambda e: e / t) AS m FROM (SELECT c, {trace('c')} AS t FROM cov{n})
      UNION ALL
      SELECT step + 1, list_transform(q, lambda e: e / t) FROM (
        SELECT step, q, {trace('q')} AS t FROM (SELECT step, {square} AS q FROM power{n} WHERE step < 30))
    ), loading{n} AS (
      SELECT list_transform(range({d}), lambda i: m[i * {d} + j] / sqrt(m[(j - 1) * {d} + j])) AS v
      FROM (SELECT m, list_position({diagonal('m')}, list_max({diagonal('m')})) AS j FROM power{n} WHERE step = 30)
    )"""

    return f"""
    scaled AS (SELECT id, {scaled} FROM features, (SELECT {quartiles} FROM features) s),
    cov1 AS (SELECT [{covariances}] AS c FROM scaled),
    {component(1)},
    cov2 AS (
      SELECT list_transform(range({d * d}), lambda i: c[i + 1] - strength * v[i // {d} + 1] * v[i % {d} + 1]) AS c
      FROM (SELECT c, v, list_sum(list_transform(range({d * d}), lambda i: c[i + 1] * v[i // {d} + 1] * v[i % {d} + 1])) AS strength
            FROM cov1, loading1)
    ),
    {component(2)}"""


def _projected_sql() -> str:
    centred = [f"(x{i} - avg(x{i}) OVER ())" for i in range(len(MODEL_COLUMNS))]
    sums = [" + ".join(f"{x} * l{n}.v[{i + 1}]" for i, x in enumerate(centred)) for n in (1, 2)]
    return f"SELECT id, {r6(sums[0])} AS pc1, {r6(sums[1])} AS pc2 FROM scaled, loading1 l1, loading2 l2"


def _ranked_sql() -> str:
    names = "[" + ", ".join(f"'{c}'" for c in MODEL_COLUMNS) + "]"
    parts = " UNION ALL ".join(
        f"SELECT 'PC{n}' AS component, unnest({names}) AS feature, abs(unnest(v)) AS w FROM loading{n}" for n in (1, 2))
    return f"""SELECT component, CAST(row_number() OVER (PARTITION BY component ORDER BY w DESC, feature) AS INT) AS rank, feature,
      {r6('w')} AS contribution FROM ({parts})"""


@query("pca", with_frames("features", _projected_sql(), extra=_components_sql(), recursive=True))
def pca(spark, sf_dir):
    """First two components of the scaled feature columns."""
    features = S.features(spark, sf_dir)
    scaled = M.fit_robust(features, MODEL_COLUMNS).transform(features, into="x").select("id", "x")
    return M.fit_pca(scaled, "x", 2).transform(scaled, "x").drop("x")


@query("pca_contributions", with_frames("features", _ranked_sql(), extra=_components_sql(), recursive=True))
def pca_contributions(spark, sf_dir):
    features = S.features(spark, sf_dir)
    scaled = M.fit_robust(features, MODEL_COLUMNS).transform(features, into="x").select("x")
    return M.pca_contributions(spark, M.fit_pca(scaled, "x", 2), MODEL_COLUMNS)


_STATISTICS = [f"{s}_{p}" for s in ("rms", "crest", "kurt", "skew") for p in PHASES]


@query(
    "feature_vector22",
    with_frames(
        "samples",
        f"""SELECT w.signal_id, w.window_no, i - 1 AS position, {r6('v')} AS value FROM (
              SELECT signal_id, window_no, unnest(vec) AS v, unnest(range(1, len(vec) + 1)) AS i FROM (
                SELECT w.signal_id, w.window_no, list_resize(list_concat([{', '.join(f'coalesce(w.{c}, 0)' for c in _STATISTICS)}],
                       coalesce(p.flat, []::DOUBLE[])), 22, 0.0) AS vec
                FROM wide w LEFT JOIN (
                    SELECT signal_id, window_no, flatten(list([frequency, magnitude] ORDER BY rank)) AS flat FROM (
                        SELECT *, min(phase) OVER (PARTITION BY signal_id, window_no) AS first_phase FROM peaks WHERE rank < 10)
                    WHERE phase = first_phase AND rank < 5 GROUP BY 1, 2) p USING (signal_id, window_no))) w""",
        PEAKS + f"""stats AS ({stats_sql('smoothed')}),
        wide AS (SELECT signal_id, window_no, {', '.join(f'max("{c[:-2]}") FILTER (phase = {chr(39)}{c[-1]}{chr(39)}) AS {c}' for c in _STATISTICS)}
                 FROM stats GROUP BY 1, 2),""",
    ),
)
def feature_vector22(spark, sf_dir):
    windows = W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP)
    cleaned = W.clean_windows(windows, min_length=MIN_LENGTH, kernel=KERNEL)
    wide = W.assemble_features(W.stat_features(cleaned))
    segments = P.segment_arrays(cleaned).withColumn("sample_rate_hz", F.lit(RATE))
    peaked = P.describe_spectrum(segments, size=PEAK_FFT).groupBy(*W.WINDOW).agg(
        *[F.max(F.when(F.col("phase") == p, F.col("peaks"))).alias(f"peaks_{p}") for p in PHASES]
    )
    vectors = M.feature_vector22(wide.join(peaked, W.WINDOW))
    return vectors.select(*W.WINDOW, F.posexplode("vector").alias("position", "value")).withColumn(
        "position", F.col("position").cast("bigint")
    )


def _scored(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    return I.score_frame(matrix, I.fit_isolation_forest(matrix))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    """Score, decision value and label of every row of a matrix with planted outliers."""
    return _scored(spark, sf_dir).drop("x")


@query("isolation_importance")
def isolation_importance(spark, sf_dir):
    features = S.features(spark, sf_dir)
    scaled = M.fit_robust(features, MODEL_COLUMNS).transform(features, into="x")
    forest = I.fit_isolation_forest(scaled.select("id", "x"), contamination="auto")
    return I.isolation_importance(forest.to_frame(spark), MODEL_COLUMNS)


POINTS = "points AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
NEAR = f"pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {EPS}::DOUBLE * {EPS}::DOUBLE"


def _points(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )


CLUSTERS = f"""{POINTS},
near AS MATERIALIZED (SELECT a.id AS p, b.id AS q FROM points a JOIN points b ON {NEAR}),
core AS MATERIALIZED (SELECT p AS id FROM near GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}),
links AS MATERIALIZED (SELECT p, q FROM near WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
reach AS (SELECT id AS node, id AS root FROM core
          UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.node WHERE r.root < l.q),
component AS (SELECT node AS id, min(root) AS label FROM reach GROUP BY 1)"""


@query(
    "dbscan",
    f"""WITH RECURSIVE {CLUSTERS}
    SELECT p.id, coalesce(c.label, b.label, -1) AS label, c.id IS NOT NULL AS is_core
    FROM points p LEFT JOIN component c ON c.id = p.id
    LEFT JOIN (SELECT n.p AS id, min(c.label) AS label FROM near n JOIN component c ON c.id = n.q GROUP BY 1) b ON b.id = p.id""",
)
def dbscan(spark, sf_dir):
    return C.dbscan(_points(spark, sf_dir), ["x", "y"], EPS, MIN_SAMPLES)


@query(
    "neighbour_counts",
    f"""WITH {POINTS},
    cells AS (SELECT id, count(*) OVER (PARTITION BY floor(x / s), floor(y / s)) AS n
              FROM points, (SELECT {EPS}::DOUBLE / sqrt(2.0::DOUBLE) * (1 - 1e-12::DOUBLE) AS s))
    SELECT a.id, count(*) AS neighbours FROM points a JOIN points b ON {NEAR}
    WHERE a.id IN (SELECT id FROM cells WHERE n < {MIN_SAMPLES}) GROUP BY 1""",
)
def neighbour_counts(spark, sf_dir):
    return C.neighbour_counts(_points(spark, sf_dir), ["x", "y"], EPS, MIN_SAMPLES)


@query(
    "silhouette",
    f"""WITH RECURSIVE {CLUSTERS},
    labelled AS (
        SELECT p.id, p.x, p.y, coalesce(c.label, b.label) AS label FROM points p LEFT JOIN component c ON c.id = p.id
        LEFT JOIN (SELECT n.p AS id, min(c.label) AS label FROM near n JOIN component c ON c.id = n.q GROUP BY 1) b ON b.id = p.id
        WHERE coalesce(c.label, b.label) IS NOT NULL),
    apart AS (
        SELECT a.id, a.label AS own, o.label AS other, sum(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) AS total, count(*) AS n
        FROM labelled a, labelled o GROUP BY 1, 2, 3),
    sides AS (
        SELECT id, sum(total / greatest(n - 1, 1)) FILTER (own = other) AS inside, max(n) FILTER (own = other) AS n,
               min(total / n) FILTER (own <> other) AS outside FROM apart GROUP BY 1)
    SELECT {r6('avg(CASE WHEN n = 1 THEN 0 ELSE (outside - inside) / greatest(inside, outside) END)')} AS silhouette FROM sides""",
)
def silhouette(spark, sf_dir):
    points = _points(spark, sf_dir)
    labels = C.dbscan(points, ["x", "y"], EPS, MIN_SAMPLES)
    value = C.silhouette(points.join(labels, "id").withColumn("c", F.array("x", "y")), "c")
    schema = T.StructType([T.StructField("silhouette", T.DoubleType())])
    return spark.createDataFrame([(value,)], schema)


METRIC_EPS, METRIC_SAMPLES = 1.16, 4


def _metric_clusters(eps: float, samples: int) -> str:
    """Density clusters of all elements of the embeddings, by comparing all pairs."""
    limit = f"{eps}::DOUBLE * {eps}::DOUBLE"
    return f"""elements AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
near AS MATERIALIZED (SELECT a.id AS p, b.id AS q FROM elements a JOIN elements b ON pow(list_distance(a.x, b.x), 2) <= {limit}),
core AS MATERIALIZED (SELECT p AS id FROM near GROUP BY 1 HAVING count(*) >= {samples}),
links AS MATERIALIZED (SELECT p, q FROM near WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
reach AS (SELECT id AS node, id AS root FROM core
          UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.node WHERE r.root < l.q),
component AS (SELECT node AS id, min(root) AS label FROM reach GROUP BY 1)"""


_METRIC_LABELS = """
    SELECT p.id, coalesce(c.label, b.label, -1) AS label, c.id IS NOT NULL AS is_core
    FROM elements p LEFT JOIN component c ON c.id = p.id
    LEFT JOIN (SELECT n.p AS id, min(c.label) AS label FROM near n JOIN component c ON c.id = n.q GROUP BY 1) b ON b.id = p.id"""


@query("dbscan_metric", f"WITH RECURSIVE {_metric_clusters(METRIC_EPS, METRIC_SAMPLES)}{_METRIC_LABELS}")
def dbscan_metric(spark, sf_dir):
    """Clusters on all elements of the embeddings."""
    return N.dbscan(S.matrix(spark, sf_dir), "x", METRIC_EPS, METRIC_SAMPLES)


@query("dbscan_relaxed", f"WITH RECURSIVE {_metric_clusters(0.8 * 1.5, 2)}{_METRIC_LABELS}")
def dbscan_relaxed(spark, sf_dir):
    """No clusters at first, so once more with a wider eps and fewer points."""
    labels, _, _ = N.dbscan_relaxed(S.matrix(spark, sf_dir), "x", 0.8, 5)
    return labels


@query(
    "neighbour_counts_metric",
    f"""WITH elements AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)
    SELECT a.id, count(*) AS neighbours FROM elements a JOIN elements b
    ON pow(list_distance(a.x, b.x), 2) <= {METRIC_EPS}::DOUBLE * {METRIC_EPS}::DOUBLE GROUP BY 1""",
)
def neighbour_counts_metric(spark, sf_dir):
    return N.neighbour_counts(S.matrix(spark, sf_dir), "x", METRIC_EPS).drop("compared")


@query(
    "anomaly_rate_by_hour",
    with_frames(
        "predictions",
        f"""SELECT date_trunc('hour', created_at)::TIMESTAMP AS hour, count(*) FILTER (probability > 0.8) AS anomalies_forest,
                   count(*) AS total_samples, count(*) FILTER (confidence IS NULL) AS anomalies_cluster,
                   {r6('count(*) FILTER (probability > 0.8) / count(*)')} AS anomaly_rate_forest,
                   {r6('count(*) FILTER (confidence IS NULL) / count(*)')} AS anomaly_rate_cluster
            FROM predictions GROUP BY 1""",
    ),
)
def anomaly_rate_by_hour(spark, sf_dir):
    labelled = S.predictions(spark, sf_dir).select(
        F.col("created_at").alias("window_start"), F.when(F.col("probability") > 0.8, -1).otherwise(1).alias("forest_label"),
        F.when(F.col("confidence").isNull(), -1).otherwise(1).alias("cluster_label"),
    )
    return M.anomaly_rate_by_hour(labelled)


@query(
    "combine_labels",
    with_frames(
        "predictions",
        f"""SELECT id, f OR c AS anomaly_detected, {r6('conf')} AS confidence, (f OR c) AND conf > 0.7 AS wants_forecast,
                   'ensemble_anomaly_detection' AS model_name, '1.0.0' AS model_version
            FROM (SELECT id, probability > 0.8 AS f, confidence IS NULL AS c,
                         least(1.0, greatest(0.0, CASE WHEN probability > 0.8 THEN abs(0.4 - probability) ELSE 0.0 END,
                                             CASE WHEN confidence IS NULL THEN 0.8 ELSE 0.0 END)) AS conf FROM predictions)""",
    ),
)
def combine_labels(spark, sf_dir):
    labelled = S.predictions(spark, sf_dir).select(
        "id", F.when(F.col("probability") > 0.8, -1).otherwise(1).alias("forest_label"),
        F.when(F.col("confidence").isNull(), -1).otherwise(1).alias("cluster_label"),
        (0.4 - F.col("probability")).alias("decision"),
    )
    return A.combine_labels(labelled).select(
        "id", "anomaly_detected", "confidence", "wants_forecast", "model_name", "model_version"
    )


def _window_features(spark, sf_dir):
    wide = W.window_statistics(S.samples(spark, sf_dir), SIZE, HOP)
    return wide.withColumn("id", F.concat_ws("-", F.col("signal_id").cast("string"), F.col("window_no").cast("string")))


@query("train_anomaly_models")
def train_anomaly_models(spark, sf_dir):
    """All models on the window features, every row with its scores and labels."""
    _, scored = A.train_anomaly_models(_window_features(spark, sf_dir), eps=1.0)
    return scored.drop("x")


@query("detect_anomalies")
def detect_anomalies(spark, sf_dir):
    """Models are trained, stored, loaded again and applied to the same windows."""
    features = _window_features(spark, sf_dir)
    folder = table_folder(spark)
    A.retrain(spark, features, folder, datetime(2024, 1, 30), eps=1.0)
    models = A.load_latest(spark, folder)
    return A.detect_anomalies(features, models).select(
        "id", "score", "decision", "forest_label", "cluster", "anomaly_detected", "confidence", "wants_forecast"
    )
