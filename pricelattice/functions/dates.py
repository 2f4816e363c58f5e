"""Date and time functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ISTANBUL = "Europe/Istanbul"
# The date layouts that sources use.
DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "dd_MM_yyyy", "dd/MM/yyyy", "yyyy-M"]


def any_date(c: Column, formats: list[str] | None = None) -> Column:
    """First layout that fits; null when none does. 'yyyy-M' keeps months 1 to 9 (they must not be lost)."""
    s = F.trim(c)
    return reduce(lambda a, b: F.coalesce(a, b), [F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats or DATE_FORMATS])


def date_or_raw(c: Column) -> Column:
    """ISO text of a known layout, else the text unchanged."""
    return F.coalesce(F.date_format(any_date(c), "yyyy-MM-dd"), c)


def any_timestamp(c: Column) -> Column:
    """ISO with or without offset; text without an offset is Istanbul local time. Null when it cannot be read."""
    has_zone = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ts = F.try_to_timestamp(c)
    return F.when(has_zone, ts).otherwise(F.to_utc_timestamp(ts, ISTANBUL))


def istanbul_iso(ts: Column) -> Column:
    """Istanbul ISO text of a UTC timestamp (the zone has been +03:00 without DST since 2016)."""
    local = F.from_utc_timestamp(ts, ISTANBUL)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(ts)) / 60).cast("int")
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    m = F.abs(minutes)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad((m / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def compact_timestamp(c: Column) -> Column:
    """14 digits yyyyMMddHHmmss."""
    return F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))


def contract_hour(c: Column) -> Column:
    """'PH26042212', block contracts ('PB26042212-03') too -> the UTC instant of 2026-04-22 12:00 in Istanbul; null for other shapes."""
    digits = F.regexp_extract(c, r"P[A-Z](\d{8})", 1)
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(F.lit("20"), digits), F.lit("yyyyMMddHH")), ISTANBUL)


def date_in_path(c: Column) -> Column:
    """Date in a file name: 2026-04-22 or 22_04_2026."""
    iso, dmy = F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(c, r"(\d{2}_\d{2}_\d{4})", 1)
    return F.coalesce(F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(dmy, F.lit("dd_MM_yyyy"))))


def partition_text(d: Column) -> dict[str, Column]:
    """Zero-padded year, month, day."""
    return {"year": F.date_format(d, "yyyy"), "month": F.date_format(d, "MM"), "day": F.date_format(d, "dd")}


def overlap_start(last: Column, floor: Column, hours: int = 48) -> Column:
    """Where an incremental read starts: `hours` before the newest row, never before the floor; the floor when there is no row."""
    return F.coalesce(F.greatest(last - F.expr(f"INTERVAL {hours} HOURS"), floor), floor)


def prev_month(m: Column) -> Column:
    return F.pmod(m - 2, F.lit(12)) + 1


def next_month(m: Column) -> Column:
    return F.pmod(m, F.lit(12)) + 1
