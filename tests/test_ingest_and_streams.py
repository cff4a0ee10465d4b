"""Files: reading, parsing, fingerprints, streams; and exports."""

import pytest
from pyspark.sql import functions as F

from motorlens.operators import alerts as L
from motorlens.operators import ingest as I
from motorlens.operators import validate as V
from motorlens.sources import recordings as C
from motorlens.sources import sinks
from motorlens.streaming import jobs as J

HEADER = "current_R,current_S,current_T"


def write(folder, name, lines, newline="\n"):
    path = folder / name
    path.write_bytes((newline.join(lines) + newline).encode())
    return path


def parsed(spark, lines):
    rows = [("f", i, line) for i, line in enumerate([HEADER, *lines])]
    data, refused = I.check_header(spark.createDataFrame(rows, "file string, line_no long, line string"))
    assert refused.count() == 0
    return [(r["a"], r["b"], r["c"]) for r in I.parse_rows(data).orderBy("line_no").collect()]


@pytest.mark.parametrize(
    "line,expected",
    [
        ("1.0,2.0,3.0", (1.0, 2.0, 3.0)),
        (" 1.0 ,\t2.0, 3.0", (1.0, 2.0, 3.0)),
        ('"1.0,2.0,3.0"', (1.0, 2.0, 3.0)),
        ("1.0,,3.0", (1.0, None, 3.0)),
        ("nan,NULL,None", (None, None, None)),
        ("1.0", (1.0, None, None)),
        ("1,2,3,4", (1.0, 2.0, 3.0)),
        ("abc,1e3,-.5", (None, 1000.0, -0.5)),
        ("1d,2f,0x10", (None, None, None)),
    ],
)
def test_row_cases(spark, line, expected):
    assert parsed(spark, [line]) == [expected]


def test_blank_lines_are_skipped(spark):
    assert len(parsed(spark, ["1,2,3", "", "   ", "4,5,6"])) == 2


def test_lines_are_not_shuffled_for_numbers_and_verdicts(spark, tmp_path):
    for k in range(4):
        write(tmp_path, f"motor_{k}.csv", [HEADER if k else "time,a"] + [f"{k},{i},0" for i in range(500)])
    lines = C.read_recordings(spark, str(tmp_path))
    data, refused = I.check_header(lines)
    assert (data.count(), refused.count()) == (1500, 1)
    for frame in (lines, data):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_large_files_keep_their_line_numbers(spark, tmp_path):
    for k in range(3):
        write(tmp_path, f"motor_{k}.csv", [HEADER] + [f"{k},{i},{i * i}" for i in range(15_000)], "\r\n" if k == 1 else "\n")
    (tmp_path / "other.txt").write_text("not a recording\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = C.read_recordings(spark, str(tmp_path))
        assert lines.select("file").distinct().count() == 3
        data = lines.where("line_no > 0").select("line_no", F.split("line", ",")[1].cast("long").alias("i"))
        assert data.count() == 45_000
        assert data.where("line_no != i + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_statistics_and_chunks(spark):
    rows = spark.createDataFrame(
        [("f", i, float(i), None if i % 10 == 0 else 1.0, None) for i in range(15_000)],
        "file string, row_no long, a double, b double, c double",
    )
    stats = I.load_stats(rows, 1000).first()
    assert stats["processed_rows"] == 15_000 and stats["chunks"] == 15
    assert stats["missing_b"] == 1500 and stats["status_c"] == "missing" and stats["samples_count"] == 15_000
    chunks = I.chunk_signals(rows, 1000)
    assert chunks.count() == 15 and chunks.where("phase_c is null").count() == 15


def test_copies_are_loaded_once(spark, tmp_path):
    write(tmp_path, "b.csv", [HEADER, "1,2,3"])
    write(tmp_path, "a.csv", [HEADER, "1,2,3"])
    write(tmp_path, "c.csv", [HEADER, "4,5,6"])
    prints = C.fingerprints(spark, str(tmp_path))
    seen = prints.where(F.col("file").endswith("c.csv"))
    fresh = I.dedup_by_fingerprint(prints, seen).collect()
    assert [r["file"].rsplit("/", 1)[1] for r in fresh] == ["a.csv"]


def test_blob_round_trip(spark):
    df = spark.createDataFrame([(1, [1.5, None, 3.0], None)], "id int, phase_a array<double>, phase_b array<double>")
    blobs = C.encode_signal_blobs(df, ["phase_a", "phase_b"])
    rows = C.decode_signal_blobs(blobs, ["id"], ["phase_a", "phase_b"]).orderBy("sample_idx").collect()
    assert [(r["phase"], r["sample_idx"], r["value"]) for r in rows] == [("a", 0, 1.5), ("a", 1, None), ("a", 2, 3.0)]


def profile_of(spark, values):
    rows = [(1, "a", float(v) if v is not None else None) for v in values]
    return V.phase_profile(spark.createDataFrame(rows, "signal_id int, phase string, value double"))


@pytest.mark.parametrize("n,expected", [(2, ["error"]), (3, ["warning"]), (10, ["warning"]), (11, ["error"]), (99, ["error"]), (100, [])])
def test_length_rule(spark, n, expected):
    rows = V.check_length(profile_of(spark, range(n))).collect()
    assert [r["severity"] for r in rows] == expected


def test_good_recording_passes_and_tiny_one_fails(spark):
    signals = spark.createDataFrame([(1, 5000), (2, 5000), (3, 500)], "id int, sample_rate_hz int")
    good = spark.range(1500).select(F.lit(1).alias("signal_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("phase"), F.randn(1).alias("value"))
    tiny = spark.createDataFrame([(2, "a", 1.0), (2, "a", 2.0)], "signal_id int, phase string, value double")
    issues = V.validation_issues(good.union(tiny), signals)
    summary = {r["signal_id"]: r for r in V.validation_summary(issues, signals).collect()}
    assert summary[1]["passes"] and summary[1]["total_issues"] == 0
    assert not summary[2]["passes"]
    assert summary[3]["critical"] == 1 and summary[3]["error"] == 1
    assert V.passing(good.union(tiny), issues).select("signal_id").distinct().collect()[0][0] == 1


def test_recordings_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.csv", [HEADER] + [f"{i % 7},{i % 5},{i % 3}" for i in range(200)])
    write(source, "copy_of_a.csv", [HEADER] + [f"{i % 7},{i % 5},{i % 3}" for i in range(200)])
    write(source, "bad.csv", ["bad,header,here,x", "1,2,3"])
    options = dict(size=64, hop=32, spectrum_size=64)

    def run():
        stream = J.watch_files(spark, str(source), per_batch=1)
        J.stream_features(
            stream, str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "ck"), 1000, **options
        ).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    first = run()
    assert first.count() == 5  # one distinct recording of 200 samples
    assert first.select("signal_id").distinct().count() == 1
    assert run().count() == 5  # nothing new, nothing changes
    write(source, "b.csv", [HEADER, "1,2,3", "2,3,4", "3,4,5"])
    assert run().where(F.col("signal_id").endswith("b.csv")).count() == 1  # a tiny upload still gives features


def test_silent_machines_come_back(spark, tmp_path):
    source = str(tmp_path / "events")
    schema = "equipment_id long, ts timestamp"

    def add(rows):
        spark.createDataFrame(rows, "equipment_id long, t string").select("equipment_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = J.stream_silent_machines(spark.readStream.schema(schema).parquet(source))
        return {r["equipment_id"] for r in J.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()}

    add([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:30:00"), (3, "2024-01-01 02:00:00")])
    assert run() == {1, 2}
    add([(1, "2024-01-01 02:30:00"), (2, "2024-01-01 05:00:00")])
    assert run() == {1, 2, 3}


def test_silent_batch_twin(spark):
    machines = spark.createDataFrame([(1,), (2,), (3,)], "equipment_id int")
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:59:00")], "equipment_id int, t string").select(
        "equipment_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    rows = L.silent_machines(machines, events, "2024-01-01 01:00:01").collect()
    assert {r["equipment_id"] for r in rows} == {1, 3}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2])], "equipment_id int, name string, x array<int>")
    sinks.export(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["x"] == "[1,2]"
    sinks.write_forecasts(df, df.select("name"), str(tmp_path / "f"), per_machine=True)
    assert (tmp_path / "f" / "forecasts" / "equipment_id=1").is_dir()
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "z"), "xml")


def test_refused_files_have_a_reason(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    lines = spark.createDataFrame([("a", 0, HEADER), ("a", 1, "1,2,3"), ("b", 0, "x,y"), ("c", 0, "  ")], "file string, line_no bigint, line string")
    assert {r["file"]: r["reason"] for r in I.refused_files(files, lines).collect()} == {"b": "header", "c": "empty", "d": "empty"}


def test_fingerprint_follows_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_LINES", 3)
    rows = [HEADER, *[f"{i},{i},{i}" for i in range(20)]]
    for name, lines in (("a.csv", rows), ("b.csv", rows), ("c.csv", rows[:-1]), ("d.csv", [*rows[:5], rows[6], rows[5], *rows[7:]])):
        write(tmp_path, name, lines)
    found = {r["file"].rsplit("/", 1)[1]: r["file_hash"] for r in C.fingerprints(spark, str(tmp_path)).collect()}
    assert found["a.csv"] == found["b.csv"] and len({found[f"{x}.csv"] for x in "acd"}) == 3


def test_registered_names_of_any_extension(spark):
    machines = spark.createDataFrame(
        [(1, "EQ_1", "first", "active", '{"filename": "Data/Run_7.TXT and more"}'), (2, "EQ_2", "second", "active", None)],
        "id int, equipment_code string, name string, status string, specifications string")
    files = spark.createDataFrame([("x/run_7.txt",), ("y/run_8.txt",), ("second",)], "file string")
    found = {r["file"]: (r["equipment_id"], r["matched_by"]) for r in I.resolve_equipment(files, machines).collect()}
    assert found == {"x/run_7.txt": (1, "registered file"), "y/run_8.txt": (1, "first active"), "second": (2, "title")}


def test_lookups_of_machines_are_not_broadcast(spark):
    machines = spark.createDataFrame(
        [(1, "", "first", "inactive", None), (2, "EQ_1_a", "second", "active", '{"filename": "run.csv"}'), (3, None, "x y", "active", None)],
        "id int, equipment_code string, name string, status string, specifications string")
    names = ["p/run.csv", "eq_1_A.csv", "x_y.csv", None, *[f"free{i}.csv" for i in range(100)]]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    found = I.resolve_equipment(files, machines)
    rows = {r["file"]: (r["equipment_id"], r["matched_by"]) for r in found.collect()}
    # a machine without a code has the files without one, wherever they are dealt
    assert rows == {"p/run.csv": (2, "registered file"), "eq_1_A.csv": (2, "code"), "x_y.csv": (1, "code"), None: (2, "first active"),
                    **{f"free{i}.csv": (1, "code") for i in range(100)}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 3


def test_a_file_name_with_odd_characters_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a [1] {x}*.csv", [HEADER, "1,2,3"])
    J.stream_recordings(J.watch_files(spark, str(source)), str(tmp_path / "seen"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 1


def test_features_from_json_reads_numbers_as_numbers(spark):
    """Documents of numbers are read once, without texts; what else they hold still ends as it did."""
    texts = ['{"rms_a": 1.5, "crest_b": -2, "min_c": 1e-3}', '{"rms_a": "1.5", "crest_b": "x", "min_c": [1]}', '{"rms_a": 1', "", None,
             '{"rms_a": 1e400, "crest_b": 7, "min_c": true}', '{"rms_a": NaN, "crest_b": " 3 "}', '{"rms_a": Infinity, "min_c": null}', '{"_odd": "x", "rms_a": "3"}']
    documents = spark.createDataFrame(list(enumerate(texts)), "id int, features string")
    found = I.features_from_json(documents).orderBy("id")
    assert "StructField(rms_a,DoubleType" in found._jdf.queryExecution().analyzed().toString()
    none = (None, None, None)
    assert [(r["rms_a"], r["crest_b"], r["min_c"]) for r in found.collect()] == [
        (1.5, -2.0, 0.001), (1.5, None, None), none, none, none, (None, 7.0, None), (None, 3.0, None), none, (3.0, None, None)]


def test_stream_features_deals_large_files_over_more_tasks(spark, tmp_path, monkeypatch):
    """The tasks that hold windows grow with the bytes of new files; the rows do not depend on their number."""
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.csv", [HEADER] + [f"{i % 7},{i % 5},{i % 3}" for i in range(200)])
    seen = []
    extract = J.extract_features

    def run(folder):
        def spy(samples, parts=None, **options):
            seen.append(parts)
            return extract(samples, parts=parts, **options)

        monkeypatch.setattr(J, "extract_features", spy)
        J.stream_features(
            J.watch_files(spark, str(source)), f"{folder}/seen", f"{folder}/out", f"{folder}/ck", 1000, size=64, hop=32, spectrum_size=64
        ).awaitTermination()
        rows = spark.read.parquet(f"{folder}/out").select("window_no", "rms_a", "max_b", "clean_length_c", "processed_phases")
        return sorted(tuple(r) for r in rows.collect())

    few = run(tmp_path / "few")
    monkeypatch.setattr(J, "BYTES_OF_PART", 100)
    assert run(tmp_path / "many") == few and len(few) == 5
    # 200 lines of 6 bytes and the header
    assert seen == [1, 1 + (200 * 6 + len(HEADER) + 1) // 100]
