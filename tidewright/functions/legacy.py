"""Scalar functions of older dialects, spelled with the meaning they had there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Oracle date mask parts and the Java pattern letters for them, longest first.
ORACLE_MASKS = (
    ("YYYY", "yyyy"),
    ("MONTH", "MMMM"),
    ("MON", "MMM"),
    ("MM", "MM"),
    ("DD", "dd"),
    ("HH24", "HH"),
    ("MI", "mm"),
    ("SS", "ss"),
    ("YY", "yy"),
)


def tsql_isnull(value: Column, fallback: Column) -> Column:
    """Two-argument ISNULL: a replacement, not a test."""
    return F.coalesce(value, fallback)


def oracle_decode(value: Column, *pairs_and_default: Column) -> Column:
    """DECODE: NULL matches NULL; a trailing odd argument is the default."""
    args = list(pairs_and_default)
    default = args.pop() if len(args) % 2 else F.lit(None)
    out = None
    for search, result in zip(args[::2], args[1::2]):
        hit = value.eqNullSafe(search)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return default if out is None else out.otherwise(default)


def oracle_text(value: Column) -> Column:
    """Oracle keeps no empty strings: '' reads as NULL."""
    return F.nullif(value, F.lit(""))


def tsql_datediff(unit: str, start: Column, end: Column) -> Column:
    """DATEDIFF(unit, start, end): unit boundaries crossed, not whole units elapsed."""
    if unit == "day":
        return F.datediff(end, start).cast("long")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    if unit == "month":
        return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("long")
    if unit == "hour":
        hours = F.unix_seconds(F.date_trunc("hour", end)) - F.unix_seconds(F.date_trunc("hour", start))
        return F.floor(hours / 3600)
    raise ValueError(unit)


def tsql_dateadd(unit: str, amount: Column, start: Column) -> Column:
    """DATEADD(unit, amount, start)."""
    if unit == "month":
        return F.add_months(start, amount)
    if unit == "year":
        return F.add_months(start, amount * 12)
    if unit == "day":
        return F.date_add(start, amount)
    raise ValueError(unit)


def oracle_to_date(value: Column, mask: str) -> Column:
    pattern = mask.upper()
    for part, letters in ORACLE_MASKS:
        pattern = pattern.replace(part, f"\0{ORACLE_MASKS.index((part, letters))}\0")
    for i, (_, letters) in enumerate(ORACLE_MASKS):
        pattern = pattern.replace(f"\0{i}\0", letters)
    return F.to_date(value, pattern)
