"""Times. Epoch nanoseconds (``*_ns`` longs) are the truth; timestamps are derived where a zone is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import trimmed

NS = 1_000_000_000
ET = "America/New_York"
# Zone names of feed dates and their offsets.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def utc(ns: Column) -> Column:
    """Timestamp of whole seconds, for a session in UTC. Divided exactly: a quotient of doubles may round up to the next second."""
    return F.timestamp_seconds(((ns - F.pmod(ns, F.lit(NS))) / F.lit(NS)).cast("long"))


def utc_micros(ns: Column) -> Column:
    """Timestamp of whole microseconds, divided exactly."""
    return F.timestamp_micros(((ns - F.pmod(ns, F.lit(1000))) / F.lit(1000)).cast("long"))


def eastern(ns: Column) -> Column:
    """US Eastern wall time."""
    return F.from_utc_timestamp(utc(ns), ET)


def eastern_date(ns: Column) -> Column:
    return F.to_date(eastern(ns))


def eastern_minute(ns: Column) -> Column:
    """Minute of the Eastern day."""
    t = eastern(ns)
    return F.hour(t) * 60 + F.minute(t)


def eastern_hms(ns: Column) -> Column:
    return F.date_format(eastern(ns), "HH:mm:ss")


def eastern_midnight_ns(day: Column) -> Column:
    return F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp"), ET)) * NS


def utc_iso(ns: Column) -> Column:
    """ISO text with milliseconds, truncated."""
    ms = F.pmod(ns - F.pmod(ns, F.lit(1_000_000)), F.lit(NS)) / 1_000_000
    return F.concat(F.date_format(utc(ns), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(ms.cast("int").cast("string"), 3, "0"), F.lit("Z"))


def _offset_s(zone: Column) -> Column:
    """Seconds east of UTC of ``+hhmm``, ``-hh:mm``, ``Z`` or a zone name; null if unknown."""
    z = F.upper(F.regexp_replace(trimmed(zone), ":", ""))
    named = ZONES | dict.fromkeys(("Z", "GMT", "UT", "UTC", ""), "+0000")
    z = F.coalesce(F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[z], z)
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    return F.when(z.rlike(r"^[-+][0-9]{4}$"), sign * (F.substring(z, 2, 2).try_cast("int") * 3600 + F.substring(z, 4, 2).try_cast("int") * 60))


def parse_rfc822(c: Column) -> Column:
    """Epoch ns of ``[Fri,] 25 Sep 2026 [12:00[:00]] [zone]``, else null. Two-digit years below 70 are 20xx; unknown zones are UTC."""
    at = r"(?i)^\s*(?:[a-z]+,?\s+)?([0-9]{1,2})[ -]+([a-z]{3})[a-z]*[ -]+([0-9]{4}|[0-9]{2})(?:\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?\s*(.*)$"
    g = lambda i: F.regexp_extract(c, at, i)
    n = lambda i: F.coalesce(g(i).try_cast("bigint"), F.lit(0))
    year = F.when(F.length(g(3)) == 2, n(3) + F.when(n(3) < 70, 2000).otherwise(1900)).otherwise(n(3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(g(2)))
    day = F.unix_date(F.call_function("try_make_timestamp", year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")) + n(1) - 1
    s = day.cast("bigint") * 86400 + n(4) * 3600 + n(5) * 60 + n(6) - F.coalesce(_offset_s(g(7)), F.lit(0))
    return F.when(c.rlike(at) & (month > 0) & n(1).between(1, 31), s * NS)


def parse_iso8601(c: Column) -> Column:
    """Epoch ns of an ISO date or date and time with up to nine fraction digits; no zone is UTC, an unknown one null."""
    at = r"^\s*([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[Tt ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:[.,]([0-9]+))?\s*(\S*))?\s*$"
    g = lambda i: F.regexp_extract(c, at, i)
    n = lambda i: F.coalesce(g(i).try_cast("bigint"), F.lit(0))
    first = F.call_function("try_make_timestamp", n(1), n(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    day = F.unix_date(first).cast("bigint") + n(3) - 1
    frac = F.rpad(F.substring(g(7), 1, 9), 9, "0").try_cast("bigint")
    s = day * 86400 + n(4) * 3600 + n(5) * 60 + n(6) - _offset_s(g(8))
    return F.when(c.rlike(at) & n(2).between(1, 12) & n(3).between(1, 31), s * NS + F.coalesce(frac, F.lit(0)))


def parse_any_datetime(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[0-9]{4}-"), parse_iso8601(c)).otherwise(parse_rfc822(c))


def parse_eastern(mdy: Column, hms: Column) -> Column:
    """Epoch ns of ``09/25/2026`` and ``09:30:00[.500]`` Eastern: midnight plus the time of day. Blank time is midnight."""
    day = F.to_date(F.try_to_timestamp(trimmed(mdy), F.lit("M/d/yyyy")))
    at = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\.([0-9]{1,3})[0-9]*)?$"
    t = F.coalesce(trimmed(hms), F.lit(""))
    n = lambda i: F.coalesce(F.regexp_extract(t, at, i).try_cast("bigint"), F.lit(0))
    ms = F.coalesce(F.rpad(F.regexp_extract(t, at, 4), 3, "0").try_cast("bigint"), F.lit(0))
    return F.when((t == "") | t.rlike(at), eastern_midnight_ns(day) + (n(1) * 3600 + n(2) * 60 + n(3)) * NS + ms * 1_000_000)


# Share of a day's volume that is usually done by each half hour from 09:30 to 16:00.
VOLUME_CURVE = [0, 0.13, 0.22, 0.29, 0.35, 0.40, 0.45, 0.49, 0.53, 0.58, 0.63, 0.69, 0.78, 1]


def volume_fraction(minute: Column) -> Column:
    """Expected share of the day's volume by a minute of the Eastern day: 0 before 04:00, 0.04 at 09:30, 0.96 at 16:00, 1 from 20:00."""
    rth = (minute - 570) / 30.0
    i = F.floor(rth).cast("int")
    curve = F.array(*(F.lit(float(x)) for x in VOLUME_CURVE))
    lo, hi = F.get(curve, i), F.get(curve, F.least(i + 1, F.lit(len(VOLUME_CURVE) - 1)))
    inside = 0.04 + 0.92 * (lo + (hi - lo) * (rth - i))
    return F.when(minute < 240, 0.0).when(minute < 570, 0.04 * (minute - 240) / 330.0).when(minute < 960, inside).when(minute < 1200, 0.96 + 0.04 * (minute - 960) / 240.0).otherwise(1.0)


def parse_ymd(c: Column) -> Column:
    """Date of ``2026-09-25`` or ``20260925``, else null; days that a month lacks are null too."""
    t = trimmed(c)
    return F.coalesce(F.to_date(F.try_to_timestamp(F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(F.when(t.rlike("^[0-9]{8}$"), t), F.lit("yyyyMMdd"))))


def civil_days(day: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(day)


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(day) - 1
