"""Time helpers.  Stored times carry no zone; every report takes an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = datetime | str


def moment(as_of: Moment) -> Column:
    """A zone-free timestamp literal."""
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def before(as_of: Moment, amount: int, unit: str) -> Column:
    """``as_of`` minus an interval, e.g. ``before(t, 24, "HOUR")``."""
    return moment(as_of) - F.expr(f"INTERVAL '{amount}' {unit}")


def after(as_of: Moment, amount: int, unit: str) -> Column:
    return moment(as_of) + F.expr(f"INTERVAL '{amount}' {unit}")


def floor_to(unit: str, column: Column | str) -> Column:
    """``date_trunc`` that stays zone-free."""
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def within(column: Column | str, as_of: Moment, amount: int, unit: str) -> Column:
    """True inside ``(as_of - interval, as_of]``; both bounds keep a report repeatable."""
    column = F.col(column) if isinstance(column, str) else column
    return (column > before(as_of, amount, unit)) & (column <= moment(as_of))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def plus_microseconds(start: Column | str, micros: Column) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    return F.timestamp_add("MICROSECOND", micros, start).cast("timestamp_ntz")
