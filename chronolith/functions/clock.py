"""Clocks and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column, separator: str = ":") -> Column:
    """HH:MM:SS of seconds, cut off, not rounded; below zero as zero."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string(separator.join(["%02d"] * 3), F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def time_of_day(seconds: Column) -> Column:
    """HH:MM:SS of seconds, cut off, by a clock that begins anew each day; below zero on the day before."""
    return clock(F.pmod(F.floor(seconds), F.lit(86_400)))


def clock_millis(seconds: Column) -> Column:
    """HH:MM:SS.mmm of seconds."""
    at = F.greatest(seconds.cast("double"), F.lit(0.0))
    ms = F.floor(F.bround((at - F.floor(at)) * 1000, 6)).cast("long")
    return F.concat(clock(at), F.format_string(".%03d", ms))


def seconds_of(text: Column) -> Column:
    """Seconds of M:SS or H:MM:SS; 0 of anything else."""
    parts = F.split(text, ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return F.when(F.size(parts).isin(2, 3) & text.rlike(r"^\d+(:\d+){1,2}$"), total).otherwise(F.lit(0.0))


def span_minutes(text: Column) -> Column:
    """Minutes between the first and the last H:MM:SS of a text; 0 with fewer than two."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{1,2}:\d{2}:\d{2})"), F.lit(1))
    return F.when(F.size(found) >= 2, (seconds_of(F.element_at(found, -1)) - seconds_of(F.element_at(found, 1))) / 60.0).otherwise(F.lit(0.0))


def marks(text: Column) -> Column:
    """Seconds of each token of a list of marks, by commas or spaces: base 60; tokens that aren't numbers are left out."""
    tokens = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[,\s]+"), lambda x: x != "")
    number = lambda x: x.try_cast("double")
    whole = F.filter(tokens, lambda t: F.forall(F.split(t, ":"), lambda p: number(p).isNotNull()))
    return F.transform(whole, lambda t: F.aggregate(F.split(t, ":"), F.lit(0.0), lambda a, p: a * 60 + number(p)))


def date_of(text: Column, today: Column | None = None) -> Column:
    """The date of YYYY-MM-DD or DD-MM-YYYY, by - or /; null or a word for today is today; an error for others."""
    now = today if today is not None else F.current_date()
    raw = F.replace(F.lower(F.trim(text)), F.lit("/"), F.lit("-"))
    iso = F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(raw, F.lit("yyyy-M-d")))
    dmy = F.when(raw.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_timestamp(raw, F.lit("d-M-yyyy")))
    found = F.coalesce(iso, dmy).cast("date")
    wrong = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")
    return F.when(text.isNull() | raw.isin("hoy", "today", "now", "ahora"), now).when(found.isNotNull(), found).otherwise(wrong)


def date_tag(date: Column) -> Column:
    return F.date_format(date, "dd-MM-yyyy")


def date_pattern(date: Column) -> Column:
    """A pattern of the date within names: ISO or day first, by - _ . space or nothing."""
    y, m, d = (F.date_format(date, p) for p in ("yyyy", "MM", "dd"))
    gap = F.lit(r"[-_.\s]?")
    return F.concat(F.lit("(?:"), y, gap, m, gap, d, F.lit("|"), d, gap, m, gap, y, F.lit(")"))
