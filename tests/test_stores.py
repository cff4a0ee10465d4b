"""Rollups from changes, pruned upserts and pages by seek against rebuilding, plain upserts and offsets."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from motorlens.operators import ingest as I
from motorlens.operators import stores as W

START = datetime(2024, 1, 1)


def readings(spark, machines, hours, seed):
    rng = random.Random(seed)
    rows = [(m, START + timedelta(hours=h, minutes=rng.randrange(60)), None if rng.random() < 0.1 else rng.gauss(5, 2)) for m in machines for h in hours]
    return spark.createDataFrame(rows, "equipment_id bigint, ts timestamp_ntz, value double")


def rebuilt(rows, keep_from=None):
    kept = rows if keep_from is None else rows.where(F.date_trunc("hour", "ts").cast("timestamp_ntz") >= F.lit(keep_from).cast("timestamp_ntz"))
    return {r["equipment_id"]: (r["readings"], round(r["mean_rms"], 9), round(r["std_rms"], 6), r["min_rms"], r["max_rms"], r["first_hour"], r["last_hour"])
            for r in W.merged(W.partial_sums(kept)).collect()}


def summary(spark, store):
    return {r["equipment_id"]: (r["readings"], round(r["mean_rms"], 9), round(r["std_rms"], 6), r["min_rms"], r["max_rms"], r["first_hour"], r["last_hour"])
            for r in W.stored_summary(spark, store).collect()}


def files_of(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{store}/summary") for f in names if f.endswith(".parquet")}


def test_rollup_follows_changes(spark, tmp_path):
    store = str(tmp_path / "store")
    first, later, late = readings(spark, range(12), range(30), 1), readings(spark, [3, 4, 40], range(30, 50), 2), readings(spark, [4], range(3), 3)
    W.refresh_changed(spark, store, first, 0)
    assert summary(spark, store) == rebuilt(first)
    before = files_of(store)
    touched = W.refresh_changed(spark, store, later, 1)
    assert summary(spark, store) == rebuilt(first.unionByName(later)) and len(touched) <= 3
    # other machines' files are the same ones
    after = files_of(store)
    same = {f for f in before if f"bucket={f.rsplit('bucket=', 1)[1].split('/')[0]}" not in {f"bucket={b}" for b in touched}}
    assert same and all(after.get(f) == before[f] for f in same)
    everything = first.unionByName(later).unionByName(late)
    for _ in range(2):
        # a repeated batch changes nothing
        W.refresh_changed(spark, store, late, 2)
        assert summary(spark, store) == rebuilt(everything)
    # retention: machines whose expired hours are their only ones disappear
    cut = "2024-01-02 10:00:00"
    empty = everything.limit(0)
    W.refresh_changed(spark, store, empty, 3, keep_from=cut)
    assert summary(spark, store) == rebuilt(everything, cut) and set(summary(spark, store)) == {3, 4, 40}
    # nothing has expired since, so nothing is renewed
    assert W.refresh_changed(spark, store, empty, 4, keep_from=cut, kept_before=cut) == []


def features(spark, rows):
    made = [(i, raw, START + timedelta(days=day), START + timedelta(days=day, seconds=length), float(i)) for i, raw, day, length in rows]
    return spark.createDataFrame(made, "id bigint, raw_id bigint, window_start timestamp_ntz, window_end timestamp_ntz, rms_a double")


def test_upsert_reads_the_days_of_new_rows(spark, tmp_path):
    path = str(tmp_path / "features")
    old = features(spark, [(i, i % 3, i % 20, 1) for i in range(60)] + [(900, 5, 2, 0)])
    new = features(spark, [(100, 0, 4, 1), (101, 0, 5, 1), (99, 7, 5, 1), (98, 7, 5, 1), (102, 8, 30, 1), (103, 8, 30, 0)])
    W.upsert_stored(old, path)
    stored = spark.read.parquet(path)
    near = W.stored_windows(stored, new.withColumn("date", F.to_date("window_start")))
    assert near.select(F.input_file_name()).distinct().count() == 2 < stored.select(F.input_file_name()).distinct().count() == 20
    W.upsert_stored(new, path)
    valid = old.where("window_end > window_start")
    expected = {tuple(r) for r in I.upsert_features(new, I.upsert_features(valid, valid.limit(0))).collect()}
    found = [tuple(r) for r in spark.read.parquet(path).select(*old.columns).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_deep_pages_read_as_much_as_the_first(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, START + timedelta(minutes=rng.randrange(500)), f"u{i % 7}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, who string")
    keys, path = [("ts", True), ("id", True)], str(tmp_path / "sorted")
    W.store_sorted(df, keys, path, parts=25)
    everything = [tuple(r) for r in df.orderBy(F.desc("ts"), F.desc("id")).collect()]
    read = {}
    for page in (0, 1, 57, 98, 99, 100):
        after = None if page == 0 else dict(zip(("id", "ts", "who"), everything[50 * page - 1]))
        found = W.page_after(spark, path, keys, after, 50)
        assert [tuple(r) for r in found.select("id", "ts", "who").collect()] == everything[50 * page : 50 * page + 50]
        read[page] = len(W.parts_after(spark, path, keys, after, 50))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan or page == 100
    assert read[0] == 1 and max(read.values()) <= 2
