"""Registered queries: loading and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS, PHASES
from motorlens.functions.ordering import position_within
from motorlens.operators import ingest as I
from motorlens.operators import reports as R
from motorlens.operators import validate as V
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.session import table_folder
from motorlens.sources import recordings as C
from motorlens.sources import star_tables as S

CHUNK = 20

# Recording text derived from the events: one file for every user group, odd cells and headers included.
LINES = """
numbered AS (
    SELECT *, 'motor_' || (user_id % 60)::VARCHAR || '.csv' AS file,
           row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts, event_id) AS line_no FROM events),
lines AS (
    SELECT file, line_no, CASE event_type
        WHEN 'click' THEN value::VARCHAR || ', ' || (value / 2)::VARCHAR || ',' || user_id::VARCHAR
        WHEN 'view' THEN value::VARCHAR || ',NaN'
        WHEN 'purchase' THEN '"' || value::VARCHAR || ',null,-1.5e1"'
        WHEN 'error' THEN ',abc,' || value::VARCHAR || ',9'
        ELSE CASE WHEN user_id % 4 = 0 THEN '   ' ELSE 'none,,' END END AS line FROM numbered
    UNION ALL
    SELECT 'motor_' || m::VARCHAR || '.csv', 0,
           CASE m % 5 WHEN 0 THEN 'current_R,current_S,current_T' WHEN 1 THEN 'current_R, current_S, current_T'
                WHEN 2 THEN 'R,S,T' WHEN 3 THEN 'bad,header' ELSE 'current_R,current_S,current_X' END
    FROM (SELECT DISTINCT user_id % 60 AS m FROM events)),"""

PARSED = LINES + """
accepted AS (SELECT file FROM lines WHERE line_no = 0 AND len(string_split(line, ',')) = 3),
cells AS (
    SELECT file, line_no, list_extract(parts, 1) AS x, list_extract(parts, 2) AS y, list_extract(parts, 3) AS z
    FROM (SELECT file, line_no, string_split(replace(line, '"', ''), ',') AS parts FROM lines
          WHERE line_no > 0 AND trim(line) <> '' AND file IN (SELECT file FROM accepted))),
parsed AS (
    SELECT file, line_no,
           CASE WHEN lower(trim(x)) NOT IN ('nan', 'null', 'none', '') THEN try_cast(trim(x) AS DOUBLE) END AS a,
           CASE WHEN lower(trim(y)) NOT IN ('nan', 'null', 'none', '') THEN try_cast(trim(y) AS DOUBLE) END AS b,
           CASE WHEN lower(trim(z)) NOT IN ('nan', 'null', 'none', '') THEN try_cast(trim(z) AS DOUBLE) END AS c
    FROM cells),
placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS row_no FROM parsed),"""


def _lines(spark, sf_dir):
    events = S.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    value = F.col("value").cast("string")
    group = F.col("user_id") % 60
    file = F.concat(F.lit("motor_"), group.cast("string"), F.lit(".csv"))
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.concat(value, F.lit(", "), (F.col("value") / 2).cast("string"), F.lit(","), user))
        .when(kind == "view", F.concat(value, F.lit(",NaN")))
        .when(kind == "purchase", F.concat(F.lit('"'), value, F.lit(',null,-1.5e1"')))
        .when(kind == "error", F.concat(F.lit(",abc,"), value, F.lit(",9")))
        .when(F.col("user_id") % 4 == 0, "   ")
        .otherwise("none,,")
    )
    data = position_within(
        events.select("ts", "event_id", file.alias("file"), line.alias("line")), ["file"], "ts", ["event_id"], "line_no",
    ).select("file", (F.col("line_no") + 1).alias("line_no"), "line")
    headers = ["current_R,current_S,current_T", "current_R, current_S, current_T", "R,S,T", "bad,header",
               "current_R,current_S,current_X"]
    header = F.element_at(F.array(*[F.lit(h) for h in headers]), (group % 5 + 1).cast("int"))
    first = events.select(group.alias("user_id")).distinct().select(
        file.alias("file"), F.lit(0).cast("bigint").alias("line_no"), header.alias("line")
    )
    return data.unionByName(first)


def _rows(spark, sf_dir):
    data, _ = I.check_header(_lines(spark, sf_dir))
    return I.parse_rows(data)


def _dense(rows):
    """Row numbers without the skipped blank lines."""
    slots = rows.withColumn("_at", F.timestamp_add("SECOND", F.col("line_no"), F.lit("2000-01-01").cast("timestamp_ntz")))
    return position_within(slots.withColumn("_at", F.col("_at").cast("timestamp_ntz")), ["file"], "_at", ["line_no"], "row_no")


@query("read_recordings", "WITH " + LINES.strip().rstrip(",") + " SELECT file, line_no, line FROM lines")
def read_recordings(spark, sf_dir):
    """Writes the derived recordings as text files and reads them back with their line numbers."""
    folder = table_folder(spark)
    lines = _lines(spark, sf_dir)
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy(
        "file"
    ).text(folder)
    read = C.read_recordings(spark, folder, "*.txt")
    name = F.regexp_extract("file", r"/file=([^/]*)/", 1)
    return read.select(name.alias("file"), "line_no", "line")


@query(
    "check_header",
    "WITH " + LINES.strip().rstrip(",") + """
    SELECT file, CASE WHEN len(string_split(line, ',')) <> 3 THEN 'refused'
                      WHEN line LIKE 'R,%' THEN 'unusual' ELSE 'ok' END AS lenient,
           CASE WHEN replace(line, ' ', '') = 'current_R,current_S,current_T' THEN 'ok' ELSE 'refused' END AS strict
    FROM lines WHERE line_no = 0""",
)
def check_header(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    lenient = I.header_verdicts(lines).withColumnRenamed("verdict", "lenient")
    strict = I.header_verdicts(lines, strict=True).withColumnRenamed("verdict", "strict")
    return lenient.join(strict, "file")


@query(
    "refused_files",
    "WITH " + LINES.strip().rstrip(",") + """
    SELECT file, CASE WHEN regexp_extract(file, '[0-9]+')::INT % 7 < 2 THEN 'empty' ELSE 'header' END AS reason FROM lines
    WHERE line_no = 0 AND (regexp_extract(file, '[0-9]+')::INT % 7 < 2 OR len(string_split(line, ',')) <> 3)""",
)
def refused_files(spark, sf_dir):
    """Some files lose all their lines and some get a blank header."""
    lines = _lines(spark, sf_dir)
    kind = F.regexp_extract("file", "[0-9]+", 0).cast("int") % 7
    header = F.when((kind == 1) & (F.col("line_no") == 0), " ").otherwise(F.col("line"))
    left = lines.where(kind != 0).select("file", "line_no", header.alias("line"))
    return I.refused_files(lines.select("file").distinct(), left)


@query(
    "parse_rows",
    "WITH " + PARSED.strip().rstrip(",") + f" SELECT file, line_no, {r6('a')} AS a, {r6('b')} AS b, {r6('c')} AS c FROM parsed",
)
def parse_rows(spark, sf_dir):
    return _rows(spark, sf_dir)


@query(
    "chunk_signals",
    "WITH " + PARSED.strip().rstrip(",") + f"""
    SELECT file, row_no // {CHUNK} AS chunk_no, (row_no // {CHUNK}) * {CHUNK} AS first_idx, count(*) AS samples_count,
           {', '.join(f"""CASE WHEN count({p}) > 0 THEN count(*) END AS len_{p},
           round(sum(round({p}::FLOAT::DOUBLE, 3)) + 3e-10, 3) + 0.0 AS sum_{p},
           round(arg_min({p}, row_no) FILTER ({p} IS NOT NULL)::FLOAT::DOUBLE, 3) + 0.0 AS first_{p}""" for p in PHASES)}
    FROM placed GROUP BY 1, 2 HAVING greatest(count(a), count(b), count(c)) > 0""",
)
def chunk_signals(spark, sf_dir):
    """Chunks, summarised per array so that rows stay comparable."""
    chunks = I.chunk_signals(_dense(_rows(spark, sf_dir)), CHUNK)
    columns = []
    for p in PHASES:
        known = F.filter(f"phase_{p}", lambda v: v.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + F.round(v.cast("double"), 3))
        columns += [
            F.when(F.col(f"phase_{p}").isNotNull(), F.size(f"phase_{p}")).cast("bigint").alias(f"len_{p}"),
            (F.round(total + 3e-10, 3) + 0.0).alias(f"sum_{p}"),
            (F.round(F.try_element_at(known, F.lit(1)).cast("double"), 3) + 0.0).alias(f"first_{p}"),
        ]
    return chunks.select("file", "chunk_no", "first_idx", "samples_count", *columns)


@query(
    "load_stats",
    "WITH " + PARSED + f"""
    per_chunk AS (SELECT file, row_no // {CHUNK} AS k, count(*) AS n, count(a) AS na, count(b) AS nb, count(c) AS nc
                  FROM placed GROUP BY 1, 2)
    SELECT file, sum(n)::BIGINT AS processed_rows, count(*) AS chunks,
           {', '.join(f"sum(n - n{p})::BIGINT AS missing_{p}, sum(n{p}) > 0 AS present_{p}, CASE WHEN sum(n{p}) > 0 THEN 'ok' ELSE 'missing' END AS status_{p}" for p in PHASES)},
           coalesce(sum(n) FILTER (greatest(na, nb, nc) > 0), 0)::BIGINT AS samples_count
    FROM per_chunk GROUP BY 1""",
)
def load_stats(spark, sf_dir):
    return I.load_stats(_dense(_rows(spark, sf_dir)), CHUNK)


@query(
    "dedup_by_fingerprint",
    with_frames(
        "signals",
        """SELECT file_hash, min(file) AS file FROM (
               SELECT file_hash, lpad(id::VARCHAR, 9, '0') || '/' || file_name AS file FROM signals
               WHERE recorded_at >= TIMESTAMP '1996-01-01')
           WHERE file_hash NOT IN (SELECT file_hash FROM signals WHERE recorded_at < TIMESTAMP '1996-01-01') GROUP BY 1""",
    ),
)
def dedup_by_fingerprint(spark, sf_dir):
    signals = S.signals(spark, sf_dir)
    named = signals.select(
        "file_hash", F.concat(F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("/"), "file_name").alias("file"), "recorded_at"
    )
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    fresh = named.where(F.col("recorded_at") >= cut).select("file_hash", "file")
    return I.dedup_by_fingerprint(fresh, named.where(F.col("recorded_at") < cut))


FILES = """
files AS (
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'data/' || lower(c_mktsegment) || '_' || c_custkey::VARCHAR || '.csv'
        WHEN 1 THEN 'EQ_' || (2000 + o_custkey % 25)::VARCHAR || '_' || lpad(o_custkey::VARCHAR, 6, '0') || '_data.csv'
        WHEN 2 THEN lower(replace(replace(c_name, '#', '_'), ' ', '_')) || '.csv' ELSE 'unknown' || o_orderkey::VARCHAR || '.csv' END AS file
    FROM orders JOIN customer ON o_custkey = c_custkey),
machines AS (
    SELECT c_custkey AS id, 'EQ_' || (2000 + c_custkey % 25)::VARCHAR || '_' || lpad(c_custkey::VARCHAR, 6, '0') AS equipment_code,
           replace(c_name, '#', ' ') AS name, status,
           lower(c_mktsegment) || '_' || c_custkey::VARCHAR || '.csv' AS registered
    FROM customer JOIN equipment e ON e.id = c_custkey)"""


@query(
    "resolve_equipment",
    with_frames(
        "equipment",
        """SELECT f.id, f.file, coalesce(r.m, c.m, t.m, (SELECT min(id) FROM machines WHERE status = 'active')) AS equipment_id,
                  CASE WHEN r.m IS NOT NULL THEN 'registered file' WHEN c.m IS NOT NULL THEN 'code'
                       WHEN t.m IS NOT NULL THEN 'title' ELSE 'first active' END AS matched_by
           FROM (SELECT *, lower(list_extract(string_split(file, '/'), -1)) AS n FROM files) f
           LEFT JOIN (SELECT n, min(id) AS m FROM (
                          SELECT m.id, lower(list_extract(string_split(f.file, '/'), -1)) AS n
                          FROM (SELECT DISTINCT file FROM files) f JOIN machines m
                              ON contains(m.registered, lower(list_extract(string_split(f.file, '/'), -1)))) GROUP BY 1) r
               ON r.n = f.n
           LEFT JOIN (SELECT lower(equipment_code) AS k, min(id) AS m FROM machines GROUP BY 1) c
               ON c.k = regexp_extract(f.n, '(eq_[^_]*_[^_.]*)', 1)
           LEFT JOIN (SELECT lower(name) AS k, min(id) AS m FROM machines GROUP BY 1) t
               ON t.k = replace(regexp_replace(f.n, '\\.[^.]*$', ''), '_', ' ')""",
        FILES,
    ),
)
def resolve_equipment(spark, sf_dir):
    customer = S.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    code = F.concat(F.lit("EQ_"), (key % 25 + 2000).cast("string"), F.lit("_"), F.lpad(key.cast("string"), 6, "0"))
    machines = S.equipment(spark, sf_dir).select(
        "id", "status", "specifications",
        F.concat(F.lit("EQ_"), (F.col("id") % 25 + 2000).cast("string"), F.lit("_"), F.lpad(F.col("id").cast("string"), 6, "0"))
        .alias("equipment_code"),
        F.translate("name", "#", " ").alias("name"),
    )
    order = F.col("o_orderkey")
    file = (
        F.when(order % 4 == 0, F.concat(F.lit("data/"), F.lower("c_mktsegment"), F.lit("_"), key.cast("string"), F.lit(".csv")))
        .when(order % 4 == 1, F.concat(code, F.lit("_data.csv")))
        .when(order % 4 == 2, F.concat(F.lower(F.translate("c_name", "# ", "__")), F.lit(".csv")))
        .otherwise(F.concat(F.lit("unknown"), order.cast("string"), F.lit(".csv")))
    )
    files = (
        S.table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == key)
        .select(order.alias("id"), file.alias("file"))
    )
    return I.resolve_equipment(files, machines)


@query(
    "decode_signal_blobs",
    f"""SELECT vec_id AS signal_id, phase, i - 1 AS sample_idx, round(v::DOUBLE + 3e-10, 6) + 0.0 AS value
        FROM (SELECT vec_id, phase, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM (
                  SELECT vec_id, 'a' AS phase, embedding[1:32] AS x FROM embeddings
                  UNION ALL SELECT vec_id, 'c', embedding[33:64] FROM embeddings))""",
)
def decode_signal_blobs(spark, sf_dir):
    """Embedding halves as stored blobs of two phases, decoded again; the middle phase is absent."""
    chunks = S.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("signal_id"), F.slice("embedding", 1, 32).alias("phase_a"),
        F.lit(None).cast("array<float>").alias("phase_b"), F.slice("embedding", 33, 32).alias("phase_c"),
    )
    columns = ["phase_a", "phase_b", "phase_c"]
    return C.decode_signal_blobs(C.encode_signal_blobs(chunks, columns), ["signal_id"], columns)


@query(
    "append_features",
    with_frames(
        "features",
        f"""SELECT date_trunc('month', window_start)::DATE AS date, count(*) AS n, min(id) AS first_id, {r6('sum(rms_a)')} AS rms_a FROM features
            WHERE window_start >= TIMESTAMP '1998-01-01' GROUP BY 1""",
    ),
)
def append_features(spark, sf_dir):
    """Feature rows appended in two runs, one folder per month, and read back."""
    rows = S.features(spark, sf_dir).where(F.col("window_start") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "window_start", "rms_a")
    folder = table_folder(spark)
    I.append_features(rows.where("length(id) % 2 = 0"), folder, per="month")
    I.append_features(rows.where("length(id) % 2 <> 0"), folder, per="month")
    stored = spark.read.schema("id string, window_start timestamp_ntz, rms_a double, date date").parquet(folder)
    return stored.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("rms_a").alias("rms_a"))


@query(
    "upsert_features",
    with_frames(
        "features",
        f"""SELECT raw_id, window_start, window_end, count(*) AS n, min(id) AS first_id, {r6('sum(rms_a)')} AS rms_a FROM (
                SELECT * FROM features WHERE window_start < TIMESTAMP '1999-01-01'
                UNION ALL
                SELECT * FROM (SELECT * FROM features WHERE window_start >= TIMESTAMP '1998-01-01'
                               QUALIFY row_number() OVER (PARTITION BY raw_id, window_start, window_end ORDER BY id) = 1) n
                WHERE NOT EXISTS (SELECT 1 FROM features e WHERE e.window_start < TIMESTAMP '1999-01-01'
                                  AND e.raw_id = n.raw_id AND e.window_start = n.window_start AND e.window_end = n.window_end))
            GROUP BY 1, 2, 3""",
    ),
)
def upsert_features(spark, sf_dir):
    features = S.features(spark, sf_dir)
    stored = features.where(F.col("window_start") < F.lit("1999-01-01").cast("timestamp_ntz"))
    new = features.where(F.col("window_start") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return I.upsert_features(new, stored).groupBy(*I.WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("rms_a").alias("rms_a")
    )


@query(
    "pending_signals",
    with_frames(
        "signals",
        """SELECT id, equipment_id, status FROM signals WHERE status IN ('pending', 'completed', 'failed')
           ORDER BY recorded_at, id LIMIT 500""",
    ),
)
def pending_signals(spark, sf_dir):
    return I.pending_signals(S.signals(spark, sf_dir), force=True, limit=500).select("id", "equipment_id", "status")


@query(
    "pending_signals_all",
    with_frames("signals", "SELECT id, equipment_id, status FROM signals WHERE status IN ('pending', 'completed', 'failed')"),
)
def pending_signals_all(spark, sf_dir):
    return I.pending_signals(S.signals(spark, sf_dir), force=True).select("id", "equipment_id", "status")


@query(
    "latest_status",
    """SELECT user_id AS signal_id, status, error, ts AS updated_at, status = 'completed' AS processed FROM (
           SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' WHEN 'click' THEN 'processing'
                          ELSE 'pending' END AS status, CASE WHEN event_type = 'error' THEN props END AS error FROM events)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_status(spark, sf_dir):
    kind = F.col("event_type")
    log = S.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("signal_id"), "ts", F.col("event_id").alias("id"),
        F.when(kind == "error", "failed").when(kind == "view", "completed").when(kind == "click", "processing")
        .otherwise("pending").alias("status"),
        F.when(kind == "error", F.col("props")).alias("error"),
    )
    return I.latest_status(log)


@query(
    "features_from_json",
    with_frames(
        "features",
        f"SELECT id, {', '.join(f'round({c}::DOUBLE + 3e-10, 6) + 0.0 AS {c}' for c in ('rms_a', 'rms_b', 'rms_c', 'crest_a', 'kurt_b'))} FROM features",
    ),
)
def features_from_json(spark, sf_dir):
    features = S.features(spark, sf_dir)
    documents = features.select("id", F.to_json(F.struct(*FEATURE_COLUMNS)).alias("features"))
    return I.features_from_json(documents).select("id", "rms_a", "rms_b", "rms_c", "crest_a", "kurt_b")


LIMITS = V.Limits(min_rate=30_000, max_rate=450_000, min_length=400, missing_warning=0.09, max_amplitude=300.0, flat_share=0.95)

PROFILE = """
profile AS (
    SELECT signal_id, phase, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, max(abs(value)) AS amplitude,
           avg(value) AS mean, stddev_pop(value) AS std FROM samples GROUP BY 1, 2),"""
RULES = {
    "check_sample_rate": f"""
        SELECT id AS signal_id, NULL::VARCHAR AS phase, CASE WHEN sample_rate_hz < {LIMITS.min_rate} THEN 'error' ELSE 'warning' END AS severity,
               CASE WHEN sample_rate_hz < {LIMITS.min_rate} THEN 'sample_rate_low' ELSE 'sample_rate_high' END AS rule,
               sample_rate_hz::DOUBLE AS measured
        FROM {{signals}} WHERE sample_rate_hz < {LIMITS.min_rate} OR sample_rate_hz > {LIMITS.max_rate}""",
    "check_length": f"""
        SELECT signal_id, phase, CASE WHEN n BETWEEN 3 AND 10 THEN 'warning' ELSE 'error' END AS severity, 'length' AS rule,
               n::DOUBLE AS measured FROM profile WHERE n < {LIMITS.min_length}""",
    "check_missing": f"""
        SELECT signal_id, phase, CASE WHEN missing / n > 0.8 THEN 'critical' ELSE 'warning' END AS severity, 'missing' AS rule,
               {r6('missing / n')} AS measured FROM profile WHERE missing / n > {LIMITS.missing_warning}""",
    "check_amplitude": f"""
        SELECT signal_id, phase, 'error' AS severity, 'amplitude' AS rule, {r6('amplitude')} AS measured FROM profile
        WHERE amplitude > {LIMITS.max_amplitude}""",
    "check_flatline": f"""
        SELECT signal_id, phase, 'warning' AS severity, 'flatline' AS rule, {r6('std')} AS measured FROM profile
        WHERE std < {LIMITS.flat_share} * abs(mean)""",
    "check_phase_consistency": """
        SELECT s.id AS signal_id, NULL::VARCHAR AS phase, CASE WHEN p.hi IS NULL THEN 'critical' ELSE 'error' END AS severity,
               CASE WHEN p.hi IS NULL THEN 'no_phases' ELSE 'phase_lengths' END AS rule,
               coalesce(p.hi - p.lo, 0)::DOUBLE AS measured
        FROM machines s LEFT JOIN (SELECT signal_id, min(n) AS lo, max(n) AS hi FROM profile GROUP BY 1) p ON p.signal_id = s.id
        WHERE p.hi IS NULL OR p.lo <> p.hi""",
}
MACHINES = "machines AS (SELECT DISTINCT user_id % 7 AS id FROM events),"


def _machines(spark, sf_dir):
    """The recordings of the samples plus two that never delivered any."""
    machines = S.table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("id")).distinct()
    return machines.withColumn("sample_rate_hz", F.lit(50_000))


@query("check_sample_rate", with_frames("signals", RULES["check_sample_rate"].format(signals="signals")))
def check_sample_rate(spark, sf_dir):
    return V.check_sample_rate(S.signals(spark, sf_dir), LIMITS)


def _profile(spark, sf_dir):
    return V.phase_profile(S.samples(spark, sf_dir))


@query("check_length", with_frames("samples", RULES["check_length"], PROFILE))
def check_length(spark, sf_dir):
    return V.check_length(_profile(spark, sf_dir), LIMITS)


@query("check_missing", with_frames("samples", RULES["check_missing"], PROFILE))
def check_missing(spark, sf_dir):
    return V.check_missing(_profile(spark, sf_dir), LIMITS)


@query("check_amplitude", with_frames("samples", RULES["check_amplitude"], PROFILE))
def check_amplitude(spark, sf_dir):
    return V.check_amplitude(_profile(spark, sf_dir), LIMITS)


@query("check_flatline", with_frames("samples", RULES["check_flatline"], PROFILE))
def check_flatline(spark, sf_dir):
    return V.check_flatline(_profile(spark, sf_dir), LIMITS)


@query("check_phase_consistency", with_frames("samples", RULES["check_phase_consistency"], PROFILE + MACHINES))
def check_phase_consistency(spark, sf_dir):
    return V.check_phase_consistency(_profile(spark, sf_dir), _machines(spark, sf_dir))


ISSUES = PROFILE + MACHINES + "issues AS (" + " UNION ALL ".join(
    sql for name, sql in RULES.items() if name != "check_sample_rate"
) + "),"


@query("validation_issues", with_frames("samples", "SELECT * FROM issues", ISSUES))
def validation_issues(spark, sf_dir):
    return V.validation_issues(S.samples(spark, sf_dir), _machines(spark, sf_dir), LIMITS)


@query(
    "validation_summary",
    with_frames(
        "samples",
        """SELECT m.id AS signal_id, count(i.rule) AS total_issues,
                  count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning,
                  count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'critical') AS critical,
                  count(*) FILTER (severity IN ('error', 'critical')) = 0 AS passes
           FROM machines m LEFT JOIN issues i ON i.signal_id = m.id GROUP BY 1""",
        ISSUES,
    ),
)
def validation_summary(spark, sf_dir):
    machines = _machines(spark, sf_dir)
    return V.validation_summary(V.validation_issues(S.samples(spark, sf_dir), machines, LIMITS), machines)


@query(
    "passing",
    with_frames(
        "samples",
        """SELECT phase, count(*) AS n FROM samples WHERE signal_id NOT IN (
               SELECT signal_id FROM issues WHERE rule = 'amplitude') GROUP BY 1""",
        ISSUES,
    ),
)
def passing(spark, sf_dir):
    samples = S.samples(spark, sf_dir)
    issues = V.check_amplitude(V.phase_profile(samples), LIMITS)
    return V.passing(samples, issues).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query(
    "constraint_violations",
    with_frames(
        "signals features predictions",
        """SELECT 'signals' AS table_name, id::VARCHAR AS id, 'positive_samples_count' AS "constraint" FROM signals WHERE NOT samples_count > 0
           UNION ALL SELECT 'signals', id::VARCHAR, 'positive_sample_rate' FROM signals WHERE NOT sample_rate_hz > 0
           UNION ALL SELECT 'features', id, 'window_order' FROM moved WHERE NOT window_end > window_start
           UNION ALL SELECT 'features', id, 'rms_a_not_negative' FROM moved WHERE rms_a < 0
           UNION ALL SELECT 'predictions', id, 'probability_range' FROM predictions WHERE probability * 1.02 NOT BETWEEN 0 AND 1
           UNION ALL SELECT 'predictions', id, 'confidence_range' FROM predictions WHERE confidence NOT BETWEEN 0 AND 1""",
        """moved AS (SELECT id, rms_a - 2 AS rms_a, window_start,
                            CASE WHEN rms_b > 9.5 THEN window_start ELSE window_end END AS window_end FROM features)""",
    ),
)
def constraint_violations(spark, sf_dir):
    """Tables with some rows moved out of range, so that every kind of rule has something to find."""
    features = S.features(spark, sf_dir).withColumn("rms_a", F.col("rms_a") - 2).withColumn(
        "window_end", F.when(F.col("rms_b") > 9.5, F.col("window_start")).otherwise(F.col("window_end"))
    )
    predictions = S.predictions(spark, sf_dir).withColumn("probability", F.col("probability") * 1.02)
    tables = {"signals": S.signals(spark, sf_dir), "features": features, "predictions": predictions}
    return R.stack(
        [
            V.constraint_violations(frame, kind).select(
                F.lit(kind).alias("table_name"), F.col("id").cast("string").alias("id"), "constraint"
            )
            for kind, frame in tables.items()
        ]
    )


@query(
    "features_usable",
    with_frames(
        "features",
        """SELECT raw_id, count(*) FILTER (rms_c IS NOT NULL) AS usable_rows, count(*) AS rows_seen FROM features GROUP BY 1""",
    ),
)
def features_usable(spark, sf_dir):
    """Checked on rows whose phase-a statistics are replaced by the often missing phase c."""
    features = S.features(spark, sf_dir).select(
        "raw_id", *[F.col(f"{s}_c").alias(f"{s}_a") for s in ("rms", "crest", "kurt", "skew")]
    )
    return V.features_usable(features).groupBy("raw_id").agg(
        F.count_if("usable").alias("usable_rows"), F.count(F.lit(1)).alias("rows_seen")
    )
