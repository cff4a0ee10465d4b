"""From text lines of recordings to stored signal chunks and feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS, PHASES
from motorlens.session import materialise

# fixed values of the loader
HEADER = "current_R,current_S,current_T"
HEADER_PREFIX = "current_"
MISSING_WORDS = ["nan", "null", "none"]
CHUNK_ROWS = 10_000
# what the reference's number parser accepts
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
BLANKS = " \t\r\n"
# parts over which files without a code in their name are dealt
SPREADS = 64


def _cells(line: Column | str) -> Column:
    # quotes only wrap numbers or a whole row here, so dropping them is enough
    return F.transform(F.split(F.translate(line, '"', ""), ","), lambda c: F.btrim(c, F.lit(BLANKS)))


def header_verdicts(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(file, verdict)``: ``ok``, ``unusual`` (lenient only) or ``refused``."""
    names = _cells("line")
    plain = F.regexp_replace(F.translate("line", '"', ""), r"\s", "")
    if strict:
        verdict = F.when(plain == HEADER, "ok").otherwise("refused")
    else:
        verdict = (
            F.when(F.size(names) != 3, "refused")
            .when(F.forall(names, lambda n: F.startswith(n, F.lit(HEADER_PREFIX))), "ok")
            .otherwise("unusual")
        )
    return lines.where(F.col("line_no") == 0).select("file", verdict.alias("verdict"))


def check_header(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(data lines of accepted files, refused files)``.

    The verdicts, one row per file, are stored first: lines are then kept by a join whose
    small side has a known size, and are not shuffled unless the files are very many.
    """
    verdicts = materialise(header_verdicts(lines, strict))
    refused = verdicts.where(F.col("verdict") == "refused").select("file")
    accepted = verdicts.where(F.col("verdict") != "refused").select("file")
    data = lines.where(F.col("line_no") > 0).join(accepted, "file", "left_semi")
    return data, refused


def refused_files(files: DataFrame, lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(file, reason)`` of every file that is not loaded: ``empty`` (no line, or a blank first one) or ``header``."""
    first = lines.where(F.col("line_no") == 0).select("file", (F.btrim("line", F.lit(BLANKS)) == "").alias("_blank"))
    verdicts = header_verdicts(lines, strict)
    judged = files.select("file").join(first, "file", "left").join(verdicts, "file", "left")
    reason = F.when(F.coalesce("_blank", F.lit(True)), "empty").when(F.col("verdict") == "refused", "header")
    return judged.select("file", reason.alias("reason")).where(F.col("reason").isNotNull())


def _number(cell: Column) -> Column:
    usable = cell.rlike(NUMBER) & ~F.lower(cell).isin(MISSING_WORDS)
    return F.when(usable, cell.try_cast("double"))


def parse_rows(data: DataFrame) -> DataFrame:
    """Data lines to ``(file, line_no, a, b, c)``.

    Short rows are padded, extra cells dropped, missing words and bad numbers
    become NULL, blank lines are skipped.
    """
    rows = data.where(F.btrim(F.translate("line", '"', ""), F.lit(BLANKS)) != "").withColumn("_cells", _cells("line"))
    return rows.select(
        "file", "line_no",
        *[_number(F.try_element_at("_cells", F.lit(i))).alias(p) for i, p in enumerate(PHASES, start=1)],
    )


def dedup_by_fingerprint(new: DataFrame, seen: DataFrame) -> DataFrame:
    """New files whose content was never loaded; of equal files the first name stays."""
    others = [c for c in new.columns if c != "file_hash"]
    first = new.groupBy("file_hash").agg(F.min_by(F.struct(*others), "file").alias("_row")).select("file_hash", "_row.*")
    return first.join(seen.select("file_hash"), "file_hash", "left_anti").select(*new.columns)


def resolve_equipment(files: DataFrame, equipment: DataFrame) -> DataFrame:
    """Machine of each file: by registered file name, by code in the name, by title, else the first active machine.

    A registered name may contain the file's name.  Every part of a registered name that
    is as long as some file's name is a possible file name, so containment becomes an
    equality join on those parts.
    """
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    named = files.withColumn("_name", name)
    code = F.regexp_extract("_name", r"(eq_[^_]*_[^_.]*)", 1)
    stem = F.regexp_replace("_name", r"\.[^.]*$", "")
    named = named.withColumn("_code", code).withColumn("_title", F.translate(stem, "_", " "))

    registered = F.lower(F.get_json_object("specifications", "$.filename"))
    # a file name has 255 characters at most, so there are few lengths
    lengths = named.where(F.length("_name") > 0).agg(F.collect_set(F.length("_name"))).scalar()
    fitting = F.filter("_lengths", lambda n: n <= F.length("_reg"))
    parts = F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(
        F.sequence(F.lit(1), F.length("_reg") - n + 1), lambda s: F.substring(F.col("_reg"), s, n)))))
    by_file = (
        equipment.withColumn("_reg", registered).withColumn("_lengths", lengths)
        .where(F.length("_reg") > 0)
        .select("id", F.explode(parts).alias("_name"))
        .groupBy("_name")
        .agg(F.min("id").alias("_by_file"))
    )
    codes = equipment.groupBy(F.lower("equipment_code").alias("_code")).agg(F.min("id").alias("_by_code"))
    titles = equipment.groupBy(F.lower("name").alias("_title")).agg(F.min("id").alias("_by_title"))
    fallback = equipment.where(F.col("status") == "active").agg(F.min("id")).scalar()
    # names without a code are the many ones, so they are dealt out over the spreads of the one machine without a code
    spread = F.when(F.col("_code") == "", F.pmod(F.xxhash64("file"), F.lit(SPREADS))).otherwise(0)
    copies = F.when(F.col("_code") == "", F.sequence(F.lit(0), F.lit(SPREADS - 1))).otherwise(F.array(F.lit(0)))
    named = named.withColumn("_spread", spread.cast("int"))
    codes = codes.select("*", F.explode(copies).alias("_spread"))
    matched = (
        named.join(by_file.hint("merge"), "_name", "left")
        .join(codes.hint("merge"), ["_code", "_spread"], "left")
        .join(titles.hint("merge"), "_title", "left")
    )
    how = (
        F.when(F.col("_by_file").isNotNull(), "registered file")
        .when(F.col("_by_code").isNotNull(), "code")
        .when(F.col("_by_title").isNotNull(), "title")
        .otherwise("first active")
    )
    return matched.select(
        *files.columns, F.coalesce("_by_file", "_by_code", "_by_title", fallback).alias("equipment_id"), how.alias("matched_by")
    )


def chunk_signals(rows: DataFrame, n: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of ``n`` rows with one float array per phase; an all-missing phase is NULL, an all-missing chunk dropped.

    ``rows`` is ``(file, row_no, a, b, c)`` with dense row numbers.
    """
    ordered = F.array_sort(F.collect_list(F.struct("row_no", *PHASES)))
    grouped = rows.groupBy("file", F.expr(f"row_no div {n}").alias("chunk_no")).agg(
        ordered.alias("_rows"), *[F.count(p).alias(f"_n{p}") for p in PHASES]
    )

    def values(phase: str) -> Column:
        return F.when(F.col(f"_n{phase}") > 0, F.transform("_rows", lambda r: r[phase].cast("float")))

    any_phase = F.greatest(*[F.col(f"_n{p}") for p in PHASES]) > 0
    return grouped.where(any_phase).select(
        "file", "chunk_no", (F.col("chunk_no") * n).alias("first_idx"),
        F.size("_rows").cast("bigint").alias("samples_count"), *[values(p).alias(f"phase_{p}") for p in PHASES],
    )


def load_stats(rows: DataFrame, n: int = CHUNK_ROWS) -> DataFrame:
    """Per file: rows, chunks, missing values and status of each phase, samples kept."""
    chunk = F.expr(f"row_no div {n}")
    per_chunk = rows.groupBy("file", chunk.alias("_chunk")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(p).alias(f"_n{p}") for p in PHASES]
    )
    kept = F.greatest(*[F.col(f"_n{p}") for p in PHASES]) > 0
    return per_chunk.groupBy("file").agg(
        F.sum("_rows").alias("processed_rows"),
        F.count(F.lit(1)).alias("chunks"),
        *[F.sum(F.col("_rows") - F.col(f"_n{p}")).alias(f"missing_{p}") for p in PHASES],
        *[(F.sum(f"_n{p}") > 0).alias(f"present_{p}") for p in PHASES],
        *[F.when(F.sum(f"_n{p}") > 0, "ok").otherwise("missing").alias(f"status_{p}") for p in PHASES],
        F.coalesce(F.sum(F.when(kept, F.col("_rows"))), F.lit(0)).alias("samples_count"),
    )


WINDOW_KEYS = ["raw_id", "window_start", "window_end"]


def upsert_features(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows plus those new windows that are valid and not stored yet; of equal new windows one stays."""
    others = [c for c in new.columns if c not in WINDOW_KEYS]
    valid = new.where(F.col("window_end") > F.col("window_start"))
    single = valid.groupBy(*WINDOW_KEYS).agg(F.min_by(F.struct(*others), "id").alias("_row")).select(*WINDOW_KEYS, "_row.*")
    fresh = single.join(existing.select(*WINDOW_KEYS), WINDOW_KEYS, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def append_features(fresh: DataFrame, path: str, per: str = "day") -> None:
    """Append feature rows, one folder per day (or month), so that time filters prune folders."""
    fresh.withColumn("date", F.to_date(F.date_trunc(per, "window_start"))).write.mode("append").partitionBy("date").parquet(path)


def pending_signals(signals: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Signals to process: pending ones, with ``force`` also finished and failed ones."""
    states = ["pending", "completed", "failed"] if force else ["pending"]
    chosen = signals.where(F.col("status").isin(states))
    return chosen if limit is None else chosen.orderBy("recorded_at", "id").limit(limit)


def latest_status(log: DataFrame) -> DataFrame:
    """Current state per signal from ``(signal_id, status, error, ts, id)`` transitions."""
    newest = F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "id")).alias("_row")
    return log.groupBy("signal_id").agg(newest).select(
        "signal_id", "_row.status", "_row.error", F.col("_row.ts").alias("updated_at"),
        (F.col("_row.status") == "completed").alias("processed"),
    )


def features_from_json(documents: DataFrame, column: str = "features") -> DataFrame:
    """A JSON document of features as typed columns; what is not a number becomes NULL.

    Numbers are read as numbers; only a document that holds anything else (a number in
    quotes, a word, a list, a number out of range) is read once more as texts, which are cast.
    """
    numbers, texts = (", ".join(f"{c} {kind}" for c in FEATURE_COLUMNS) for kind in ("double", "string"))
    parsed = documents.withColumn("_f", F.from_json(column, f"{numbers}, _odd string", {"columnNameOfCorruptRecord": "_odd"}))
    # NaN counts as the greatest number
    endless = F.greatest(*[F.abs(F.col(f"_f.{c}")) for c in FEATURE_COLUMNS]) >= F.lit(float("inf"))
    parsed = parsed.withColumn("_again", F.col("_f._odd").isNotNull() | F.coalesce(endless, F.lit(False)))
    parsed = parsed.withColumn("_t", F.when(F.col("_again"), F.from_json(column, texts)))
    kept = [c for c in documents.columns if c != column]
    return parsed.select(*kept, *[
        F.when(F.col("_again"), F.col(f"_t.{c}").try_cast("double")).otherwise(F.col(f"_f.{c}")).alias(c)
        for c in FEATURE_COLUMNS
    ])
