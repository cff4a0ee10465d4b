"""Display text of sizes, durations and numbers, and file-name cleaning, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the display texts
SIZE_UNITS = ["B", "KB", "MB", "GB"]
SECONDS, MINUTES, HOURS = "сек", "мин", "ч"
UNSAFE_CHARACTERS = r'[<>:"/\\|?*]'
MAX_NAME_LENGTH = 100


def _fixed(value: Column, decimals: int, grouped: bool = False) -> Column:
    text = F.format_number(value, decimals)
    return text if grouped else F.translate(text, ",", "")


def file_size(size_bytes: Column) -> Column:
    """``1536`` as ``1.5 KB``; the largest unit is GB."""
    text = None
    for power, unit in enumerate(SIZE_UNITS):
        shown = F.concat(_fixed(size_bytes / float(1024**power), 1), F.lit(f" {unit}"))
        fits = size_bytes < float(1024 ** (power + 1)) if unit != SIZE_UNITS[-1] else F.lit(True)
        text = F.when(fits, shown) if text is None else text.when(fits, shown)
    return F.when(size_bytes == 0, F.lit("0 B")).otherwise(text)


def duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(_fixed(seconds, 1), F.lit(f" {SECONDS}")))
        .when(seconds < 3600, F.concat(_fixed(seconds / 60, 1), F.lit(f" {MINUTES}")))
        .otherwise(F.concat(_fixed(seconds / 3600, 1), F.lit(f" {HOURS}")))
    )


def number(value: Column, decimals: int = 3) -> Column:
    """Thousands separators from 1000 on, ``N/A`` for a missing value."""
    plain = F.when(F.abs(value) >= 1000, _fixed(value, decimals, grouped=True)).otherwise(_fixed(value, decimals))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(plain)


def day_time(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy HH:mm:ss")


def safe_file_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, UNSAFE_CHARACTERS, "_"), 1, MAX_NAME_LENGTH)


def hidden(text: Column) -> Column:
    """SHA-256 of sensitive text."""
    return F.sha2(text, 256)
