"""Column functions: buckets, labels, durations and the normal distribution."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as 10ms, 5m or 1h."""
    found = re.fullmatch(r"([1-9][0-9]*)(ms|s|m|h)", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def bucket_ms(text: str) -> int:
    """Milliseconds of a bucket size such as 5m, 1h or 1d."""
    found = re.fullmatch(r"([1-9][0-9]*)(m|h|d)", text)
    if not found:
        raise ValueError(f"not a bucket size: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def duration_of(text: Column) -> Column:
    """Milliseconds of a column of durations; null where it is none."""
    size, unit = (F.regexp_extract(text, "^([1-9][0-9]*)(ms|s|m|h)$", n) for n in (1, 2))
    factor = F.when(unit == "ms", 1).when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000)
    return F.nullif(size, F.lit("")).cast("long") * factor


def bucket_start(time: Column, bucket_ms: int) -> Column:
    """First millisecond of the bucket that holds a time of day."""
    return (time - time % bucket_ms).cast("long")


def clock_label(start: Column) -> Column:
    """HH:mm:ss.SSS of a time of day in milliseconds."""
    parts = (F.floor(start / 3_600_000), F.floor(start / 60_000) % 60, F.floor(start / 1000) % 60, start % 1000)
    two = [F.concat(F.when(p < 10, "0").otherwise(""), p.cast("string")) for p in parts[:3]]
    three = F.concat(F.when(parts[3] < 10, "00").when(parts[3] < 100, "0").otherwise(""), parts[3].cast("string"))
    # a formatter costs more than all else that is done with a tick, so that it is kept for times before the day and nulls
    return F.when(start >= 0, F.concat(two[0], F.lit(":"), two[1], F.lit(":"), two[2], F.lit("."), three)).otherwise(
        F.format_string("%02d:%02d:%02d.%03d", *parts))


def time_bucket_continuous(time: Column, bucket_ms: int) -> Column:
    """Clock label HH:mm:ss.SSS of the bucket that holds a time of day in milliseconds."""
    return clock_label(bucket_start(time, bucket_ms))


def auction_phase(session: Column, auction: Column) -> Column:
    """AMO, AMC, PMO or PMC for prints of an opening or closing auction, else null."""
    half = F.when(session == "am", "AM").when(session == "pm", "PM")
    return F.concat(half, F.when(auction == 1, "O").when(auction == 2, "C"))


def time_bucket(time: Column, session: Column, auction: Column, bucket_ms: int) -> Column:
    """The auction's phase, else the clock label."""
    return F.coalesce(auction_phase(session, auction), time_bucket_continuous(time, bucket_ms))


def session_label(bucket: Column) -> Column:
    """Session of a bucket: an auction's own label, AM before noon, PM after, else Other."""
    hour = F.try_to_number(F.nullif(F.regexp_extract(bucket, "^([0-2]?[0-9]):[0-5][0-9]", 1), F.lit("")), F.lit("99"))
    return F.when(bucket.isin("AMO", "AMC", "PMO", "PMC"), bucket).when(hour < 12, "AM").when(hour >= 12, "PM").otherwise("Other")


def symbol_anchor(symbol: Column) -> Column:
    """Stable anchor of a symbol: slug, where it has one, and the first eight hex digits of its SHA-1; a blank one fails."""
    text = F.trim(symbol)
    slug = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""))
    anchor = F.concat_ws("-", F.lit("symbol-detail"), F.nullif(slug, F.lit("")), F.substring(F.sha1(text), 1, 8))
    return F.when(text == "", F.raise_error(F.lit("symbol must not be empty"))).otherwise(anchor)


#: Sessions of a day in order.
SESSIONS = ("AM opening auction", "AM continuous session", "AM closing auction", "PM opening auction", "PM continuous session",
            "PM closing auction", "Other")


def activity_session(bucket: Column) -> Column:
    """The session of the day that a bucket belongs to."""
    part = session_label(F.upper(F.trim(F.coalesce(bucket, F.lit("")))))
    names = {"AMO": SESSIONS[0], "AM": SESSIONS[1], "AMC": SESSIONS[2], "PMO": SESSIONS[3], "PM": SESSIONS[4], "PMC": SESSIONS[5]}
    out = F.lit(SESSIONS[6])
    for code, name in names.items():
        out = F.when(part == code, name).otherwise(out)
    return out


def bucket_order(bucket: Column, legacy: bool = False) -> Column:
    """Sort key of a bucket label in market order: opening auction, clock buckets and closing auction of each half day.

    legacy gives the older keys, in which clock buckets come after every auction but the full day.
    """
    form = "^([0-2]?[0-9]):([0-5][0-9])"
    minute = F.nullif(F.regexp_extract(bucket, form, 1), F.lit("")).cast("int") * 60 + F.nullif(F.regexp_extract(bucket, form, 2), F.lit("")).cast("int")
    if legacy:
        keys, clock, other = (0, 200, 300, 500), minute + 100, 900
    else:
        keys, clock, other = (0, 1000, 2000, 5000), F.when(minute < 720, minute).otherwise(minute + 2000), 9000
    out = F.coalesce(clock, F.lit(other))
    for label, key in zip(("AMO", "AMC", "PMO", "PMC"), keys):
        out = F.when(bucket == label, key).otherwise(out)
    return out


#: Coefficients of Hart's rational approximation, highest power first.
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    x = F.abs(z)

    def horner(values: tuple[float, ...]) -> Column:
        total = F.lit(values[0])
        for v in values[1:]:
            total = total * x + F.lit(v)
        return total

    tail = F.lit(0.65)
    for n in (4, 3, 2, 1):
        tail = F.lit(float(n)) / (x + tail)
    density = F.exp(-x * x / 2)
    upper = F.when(x < 7.07106781186547, density * horner(_HART_TOP) / horner(_HART_BOTTOM)).otherwise(
        density / (x + tail) / F.lit(2.506628274631))
    return F.when(z > 0, 1 - upper).otherwise(upper)
