"""Coordinates, distances and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions import text

EARTH_KM, SITE_KM = 6371.0, 4.0
_DMS = r"^\s*([+-]?)(\d+) +(\d+) +(\d+\.?\d*|\.\d+)\s*$"


def coordinate(raw: Column) -> Column:
    """Decimal degrees from a decimal number or from degrees, minutes and seconds between spaces."""
    raw = raw.cast("string")
    part = lambda g: F.regexp_extract(raw, _DMS, g).try_cast("double")
    sign = F.when(F.regexp_extract(raw, _DMS, 1) == "-", -1.0).otherwise(1.0)
    return F.coalesce(text.to_float(raw), F.when(raw.rlike(_DMS), sign * (part(2) + part(3) / 60 + part(4) / 3600)))


def site(lat_raw: Column, lon_raw: Column) -> Column:
    """struct(lat, lon) in range, or null: both are there, not both zero; 0 to 360 becomes -180 to 180."""
    lat, lon = coordinate(lat_raw), coordinate(lon_raw)
    lon = F.when(lon > 180, lon - 360).otherwise(lon)
    fine = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    x = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(x)))


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    return F.degrees(haversine_km(dec1, ra1, dec2, ra2) / EARTH_KM)


_HEADER = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
_NAMED = (r"(\d{4})-(\d{2})-(\d{2})[_-](\d{2})-(\d{2})-(\d{2})", r"(?<!\d)(\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})(?!\d)")
_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(_FORMAT)).cast("timestamp_ntz")


def header_time(date_obs: Column) -> Column:
    """Date and time of a header; zone and fraction are ignored, a date alone is no time."""
    both = F.concat_ws(" ", F.regexp_extract(date_obs, _HEADER, 1), F.regexp_extract(date_obs, _HEADER, 2))
    return F.when(date_obs.rlike(_HEADER), _time(both))


def file_time(name: Column) -> Column:
    """Date and time in a file name, in either of two spellings."""
    ways = []
    for pattern in _NAMED:
        g = [F.regexp_extract(name, pattern, k) for k in range(1, 7)]
        ways.append(F.when(name.rlike(pattern), _time(F.concat(F.concat_ws("-", *g[:3]), F.lit(" "), F.concat_ws(":", *g[3:])))))
    return F.coalesce(*ways)


def night(time: Column) -> Column:
    """The date of the evening: from noon to noon."""
    return F.to_date(time - F.expr("INTERVAL 12 HOURS"))


def night_bounds(date: str) -> tuple[str, str]:
    """The texts between which a header time belongs to a night."""
    from datetime import date as day
    from datetime import timedelta

    first = day.fromisoformat(date)
    return f"{first}T12:00:00", f"{first + timedelta(days=1)}T12:00:00"


def exposure_token(seconds: Column) -> Column:
    """Seconds with six significant digits and no trailing zeros, as a power of ten from a million and below 0.0001."""
    scientific = F.regexp_replace(F.regexp_replace(F.lower(F.format_string("%.5e", seconds)), r"\.?0+e", "e"), r"e([+-])(\d)$", "e$1 0$2")
    power = F.regexp_extract(F.format_string("%.5e", seconds), r"e([+-]\d+)$", 1).cast("int")
    ways = [F.when(power == p, F.format_string(f"%.{max(0, 5 - p)}f", seconds)) for p in range(-4, 6)]
    written = F.coalesce(*ways)
    plain = F.when(F.contains(written, F.lit(".")), F.regexp_replace(written, r"\.?0+$", "")).otherwise(written)
    return F.concat(F.when(seconds == 0, "0").when(written.isNull(), F.replace(scientific, F.lit(" "), F.lit(""))).otherwise(plain), F.lit("s"))
