"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "asDict"):
        return tuple((k, _plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return ("decimal", float(value))
    return value


def _key(row):
    return tuple((value is not None, "" if value is None else (f"{value:.4f}" if isinstance(value, float) else str(value)))
                 for value in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(row[n]) for n in names) for row in df.collect()), key=_key)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    raw = [d[0] for d in cursor.description]
    names = sorted(raw)
    order = [raw.index(n) for n in names]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()), key=_key)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    return type(a) is type(b) and a == b


def difference(df, con, sql) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    names, left = spark_rows(df)
    other, right = duck_rows(con, sql)
    if names != other:
        return f"columns {names} vs {other}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; e.g. {left[:2]} / {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if not all(_same(x, y) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ; e.g. {dict(zip(names, zip(*bad[0])))}"
    return None


def exact_difference(df, con, sql) -> int:
    """Number of rows that are not bit-identical after rounding."""
    names, left = spark_rows(df)
    _, right = duck_rows(con, sql)
    for a, b in zip(left, right):
        odd = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        if odd:
            print("   inexact:", odd[:3])
            break
    return sum(a != b for a, b in zip(left, right))


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from motorlens.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                message = difference(df, con, oracles[name]) or "ok"
                if message == "ok":
                    inexact = exact_difference(df, con, oracles[name])
                    message = f"ok rows={len(spark_rows(df)[1])}" + (f" INEXACT {inexact}" if inexact else "")
            else:
                message = f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            message = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        if not message.startswith(("ok", "rows only")):
            failed += 1
        print(f"{name:34s} {time.time() - started:6.2f}s {message}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
