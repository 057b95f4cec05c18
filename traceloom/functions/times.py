"""Time expressions. Nanosecond times stay BIGINT; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.edge_text import trim_all

NS = 1_000_000_000
ISO = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?$"
CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)? (AM|PM)$"


def ntz_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def seconds(ns: Column) -> Column:
    """Whole seconds, exact for 64-bit nanoseconds."""
    return F.call_function("div", ns, F.lit(NS))


def hour_key(ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds(ns)), "yyyy-MM-dd_HH")


def day_key(ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds(ns)), "yyyy-MM-dd")


def hour_start_ns(ns: Column) -> Column:
    return ns - F.pmod(ns, F.lit(3600 * NS))


def ns_text(ns: Column, zone: str = "UTC") -> Column:
    """'yyyy-MM-dd HH:mm:ss.nnnnnnnnn' in ``zone``."""
    at = F.from_utc_timestamp(F.timestamp_seconds(seconds(ns)), zone)
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("."),
                    F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0"))


def text_ns(text: Column, zone: str = "UTC") -> Column:
    """Inverse of :func:`ns_text`; a missing fraction counts as zero."""
    whole = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_extract(text, r"^([^.]*)", 1), F.lit("yyyy-MM-dd HH:mm:ss")), zone)
    frac = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})$", 1), 9, "0").cast("long")
    return F.unix_seconds(whole) * NS + frac


def epoch_seconds(value: Column, compat: bool = False) -> Column:
    """Seconds from an epoch of unknown scale.

    ``compat=True`` keeps the historic bounds, under which a plain epoch in
    seconds is taken for milliseconds.
    """
    ns, us, ms = (1e15, 1e12, 1e9) if compat else (1e17, 1e14, 1e11)
    return F.when(value > ns, value / 1e9).when(value > us, value / 1e6).when(value > ms, value / 1e3).otherwise(
        value.cast("double"))


def _iso_text(t: Column) -> Column:
    frac = F.rpad(F.regexp_extract(t, r"\.(\d+)$", 1), 6, "0")
    return F.concat(F.substring(t, 1, 19), F.lit("."), frac)


def _clock_24h(t: Column) -> Column:
    """'h:mm[:ss] AM' to 'HH:mm:ss'; null when the text is no 12-hour clock."""
    hour = F.regexp_extract(t, CLOCK, 1).try_cast("int")
    sec = F.regexp_extract(t, CLOCK, 3)
    h24 = F.pmod(hour, F.lit(12)) + F.when(F.regexp_extract(t, CLOCK, 4) == "PM", 12).otherwise(0)
    text = F.concat_ws(":", F.lpad(h24.cast("string"), 2, "0"), F.regexp_extract(t, CLOCK, 2),
                       F.when(sec == "", "00").otherwise(sec))
    return F.when(t.rlike(CLOCK) & hour.between(1, 12), text)


def normalize_timestamp(ts: Column, window_name: Column, log_type: Column) -> Column:
    """One text form for all log types, with the window start as fallback."""
    t = trim_all(F.coalesce(ts, F.lit("")))
    start = F.regexp_extract(window_name, r"^([^_]*)", 1)
    clock = F.concat_ws(" ", F.substring(start, 1, 10), F.concat(_clock_24h(t), F.lit(".000000")))
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}")
    valid = t.rlike(ISO) & t.try_cast("timestamp_ntz").isNotNull()
    return (F.when(dated & valid, _iso_text(t))
            .when(dated, t)
            .when((log_type == "audit") & t.rlike("AM|PM") & _clock_24h(t).isNotNull(), clock)
            .otherwise(F.concat(start, F.lit(".000000"))))


def timestamp_epoch(ts: Column, window_name: Column) -> Column:
    """Epoch seconds of a timestamp text; 0.0 when it cannot be read."""
    t = trim_all(ts)
    day = F.regexp_extract(window_name, r"^(\d{4}-\d{2}-\d{2})", 1)
    plain = F.when(t.rlike(r"^\d{1,2}:\d{2}:\d{2}(\.\d*)?$"), F.lpad(F.regexp_extract(t, r"^([\d:]+)", 1), 8, "0"))
    clock = F.try_to_timestamp(F.concat_ws(" ", day, F.coalesce(_clock_24h(F.upper(t)), plain)),
                               F.lit("yyyy-MM-dd HH:mm:ss"))
    iso = F.when(t.rlike(ISO), F.unix_micros(t.try_cast("timestamp")) / 1e6)
    return F.coalesce(iso, F.unix_seconds(clock).cast("double"), F.lit(0.0))


def scenario_for_window(window_key: Column, spans: list[tuple[str, str, str]], default: str) -> Column:
    """Scenario name from the first (name, first day, last day) span that holds the window."""
    out = F.lit(default)
    for name, first, last in reversed(spans):
        out = F.when(F.substring(window_key, 1, 10).between(first, last), F.lit(name)).otherwise(out)
    return out
