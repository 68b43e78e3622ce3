"""Date and time functions as Column expressions over naive ISO texts and TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")


def parse_iso(text: Column) -> Column:
    """Wall-clock time of an ISO text; a zone or fraction is dropped."""
    return _ntz(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")), "yyyy-MM-dd'T'HH:mm:ss")


def from_filename(stem: Column) -> Column:
    """The first of three patterns in a file's stem that is a real date and time."""
    found = None
    for pattern in (r"(20\d{2}\d{2}\d{2})[_-]?(\d{6})", r"IMG[_-](\d{8})[_-](\d{6})", r"PXL[_-](\d{8})[_-](\d{6})"):
        digits = F.concat(F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2))
        one = _ntz(F.nullif(digits, F.lit("")), "yyyyMMddHHmmss")
        found = one if found is None else F.coalesce(found, one)
    return found


def from_local_text(text: Column) -> Column:
    """Times as photo services write them for people; a zone's short name at the end is ignored."""
    t = F.regexp_replace(F.trim(text), r",(\d{4})", ", $1")
    t = F.regexp_replace(t, r"(?i)\s+(UTC|GMT|BST|CEST|CET|EDT|EST|PDT|PST|IST)$", "")
    month_first = F.regexp_replace(t, r"^(?i)(mon|tues|wednes|thurs|fri|satur|sun)day\s+", "")
    shapes = [(month_first, "MMMM d, yyyy h:mm a"), (month_first, "MMMM d, yyyy H:mm"), (t, "yyyy-MM-dd HH:mm:ss"), (t, "yyyy:MM:dd HH:mm:ss"), (t, "yyyy-MM-dd'T'HH:mm:ss")]
    return F.coalesce(*[_ntz(c, p) for c, p in shapes])


def from_history_text(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), r"\s+UTC$", "")
    return F.coalesce(_ntz(t, "yyyy-MM-dd HH:mm:ss"), parse_iso(t))


def from_digits(number: Column) -> Column:
    """A time given as fourteen digits in a number."""
    text = F.lpad(F.regexp_replace(number.cast("string"), r"\D", ""), 14, "0")
    return F.when(F.length(F.regexp_replace(number.cast("string"), r"\D", "")) <= 14, _ntz(text, "yyyyMMddHHmmss"))


def epoch_seconds(number: Column) -> Column:
    """Seconds of an epoch that may be in milliseconds (1e10 and more)."""
    return F.when(F.abs(number) >= 1e10, F.floor(number / 1000)).otherwise(F.floor(number)).cast("long")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def exif_to_iso(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` with any fraction as an ISO text."""
    return F.regexp_replace(F.trim(text), r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}:\d{2}:\d{2}).*$", "$1-$2-$3T$4")


def zip_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", year, month, day, hour, minute, second)


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def prefer_name_at_whole_hours(name: Column, other: Column) -> Column:
    """The name's time if it differs from the other by whole hours (within 90 s), as zone mistakes do."""
    gap = seconds_between(name, other)
    rest = F.pmod(gap, F.lit(3600.0))
    whole = (gap > 0) & ((rest <= 90) | (3600 - rest <= 90))
    return F.when(whole, name).otherwise(F.coalesce(other, name))


def canonical_time(name: Column, local: Column, formatted_utc: Column, epoch: Column, zone: Column) -> Column:
    """Capture time by precedence; with a zone the epoch leads, else the file's name."""
    in_zone = lambda ts: F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")
    at_zone = (
        F.when(epoch.isNotNull(), prefer_name_at_whole_hours(name, in_zone(from_epoch(epoch))))
        .when(local.isNotNull(), prefer_name_at_whole_hours(name, local))
        .when(name.isNotNull(), name)
        .when(formatted_utc.isNotNull(), prefer_name_at_whole_hours(name, in_zone(formatted_utc)))
    )
    plain = F.coalesce(name, local, formatted_utc, from_epoch(epoch))
    return iso(F.when(zone.isNotNull(), F.coalesce(at_zone, plain)).otherwise(plain))


def offset_minutes(zone: Column) -> Column:
    """Minutes of ``+HH:MM``, ``Z``, ``UTC`` or ``GMT``; null otherwise."""
    t = F.trim(zone)
    sign, hours, minutes = (F.regexp_extract(t, r"^([+-])(\d{2}):?(\d{2})$", k) for k in (1, 2, 3))
    value = F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 60 + minutes.try_cast("int"))
    return F.when(t.isin("Z", "UTC", "GMT"), F.lit(0)).when(sign != "", value)


def zone_name(zone: Column) -> Column:
    """``UTC``, ``UTC+HH:MM``, or the text itself where it isn't an offset."""
    m = offset_minutes(zone)
    shown = F.format_string("UTC%s%02d:%02d", F.when(m >= 0, "+").otherwise("-"), F.floor(F.abs(m) / 60), F.abs(m) % 60)
    return F.when(F.trim(zone) == "", None).when(F.trim(zone).isin("Z", "UTC", "GMT"), "UTC").when(m.isNotNull(), shown).otherwise(F.trim(zone))


def with_zone(text: Column, zone: Column) -> Column:
    """(local, utc, zone_name): the texts with their offset; only the name if the zone isn't an offset."""
    m, ts = offset_minutes(zone), parse_iso(text)
    shown = F.format_string("%s%02d:%02d", F.when(m >= 0, "+").otherwise("-"), F.floor(F.abs(m) / 60), F.abs(m) % 60)
    utc = F.timestamp_seconds(F.unix_seconds(ts.cast("timestamp")) - m * 60)
    known = ts.isNotNull() & m.isNotNull()
    return F.struct(
        F.when(known, F.concat(iso(ts), shown)).otherwise(text).alias("local"),
        F.when(known, F.concat(iso(utc), F.lit("+00:00"))).alias("utc"),
        F.when(ts.isNotNull(), zone_name(zone)).alias("zone_name"),
    )


def month_day(text: Column) -> Column:
    return F.substring(text, 6, 5)


def month_day_label(md: Column) -> Column:
    return F.date_format(_ntz(F.concat(F.lit("2000-"), md), "yyyy-MM-dd"), "MMMM dd")


def moment_label(text: Column) -> Column:
    return F.coalesce(F.date_format(parse_iso(text), "MMMM yyyy"), F.lit("Unknown Date"))


def clock_label(text: Column) -> Column:
    return F.date_format(parse_iso(text), "HH:mm")


def days_back(md: Column, pivot: Column) -> Column:
    """Days from a month-day back to the pivot's in a leap year; 367 where either is no date."""
    doy = lambda c: F.dayofyear(F.try_to_timestamp(F.concat(F.lit("2000-"), c), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.pmod(doy(pivot) - doy(md), F.lit(366)), F.lit(367))


def frame_offsets(duration: Column) -> Column:
    """Seconds at which to look into a video: 15, 50 and 85 % of it, kept inside and at least 0.35 s apart."""
    at = F.array(*[F.greatest(F.lit(0.0), F.least(duration * share, F.greatest(duration - 0.1, F.lit(0.0)))) for share in (0.15, 0.5, 0.85)])
    keep = F.aggregate(at, F.array().cast("array<double>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k - x) < 0.35), kept).otherwise(F.concat(kept, F.array(x))))
    return F.when(duration.isNull() | (duration <= 0), F.array(F.lit(0.0))).otherwise(keep)
