"""Scalar functions: Column in, Column out, no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EARTH_RADIUS, MODE_OF_TYPE, MODES, TIME_ZONE, WALK_METRES_PER_SECOND

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_real(x: Column) -> Column:
    """Decimal number or null; blanks, words, hex, infinities and NaN are null."""
    return F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double"))


def to_int(x: Column) -> Column:
    """As ``to_real``, then truncated."""
    return to_real(x).cast("long")


def clock_seconds(x: Column) -> Column:
    """H:MM:SS to seconds; hours may pass 24; three numeric parts or null."""
    part = [to_int(F.get(F.split(x, ":"), F.lit(i))) for i in range(3)]
    return F.when(F.size(F.split(x, ":")) == 3, part[0] * 3600 + part[1] * 60 + part[2]).cast("int")


def presence(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def presence_trimmed(x: Column) -> Column:
    return presence(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def name_of(number: Column, names: dict) -> Column:
    """Enumeration name, null where the number is not known."""
    return F.try_element_at(_literal_map(names), number.cast("int"))


def safe_mode(route_type: Column) -> Column:
    return name_of(route_type, MODE_OF_TYPE)


def mode(route_type: Column) -> Column:
    """Fails on a type that is no mode."""
    return F.coalesce(safe_mode(route_type), F.raise_error(F.concat(F.lit("unknown route_type "), route_type.cast("string"))))


def type_of_mode(name: Column) -> Column:
    return F.try_element_at(_literal_map({v: k for k, v in MODE_OF_TYPE.items()}), name)


def mode_rank(route_type: Column) -> Column:
    return F.when(route_type == 1, 0).when(route_type == 0, 1).when(route_type == 3, 2)


def mode_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MODES]), rank)


def metres_between(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere."""
    p, q = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (q - p) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(a))


def walk_seconds(metres: Column) -> Column:
    return F.round(metres / WALK_METRES_PER_SECOND).cast("int")


def service_date(epoch: Column) -> Column:
    """Local calendar date of an instant (epoch seconds)."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch), TIME_ZONE))


def yyyymmdd(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def weekday(date: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(date) - 1


def midnight(date: Column) -> Column:
    """Epoch seconds of local midnight. Needs the session's time zone to be UTC."""
    return F.unix_timestamp(F.to_utc_timestamp(date.cast("timestamp"), TIME_ZONE))


def absolute(date: Column, seconds: Column) -> Column:
    return midnight(date) + seconds


def since_midnight(date: Column, epoch: Column) -> Column:
    return epoch - midnight(date)


def iso_local(epoch: Column) -> Column:
    """Local time with its offset, yyyy-MM-ddTHH:mm:ss+HH:MM."""
    local = F.from_utc_timestamp(F.timestamp_seconds(epoch), TIME_ZONE)
    offset = F.unix_timestamp(local) - epoch
    sign = F.when(offset < 0, "-").otherwise("+")
    size = F.abs(offset)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign,
        F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(size / 60) % 60).cast("string"), 2, "0"),
    )


def translated(translations: Column) -> Column:
    """First text in English or of no language, else the first."""
    english = F.get(F.filter(translations, lambda t: t["language"].isNull() | (t["language"] == "en")), F.lit(0))
    return F.coalesce(english["text"], F.get(translations, F.lit(0))["text"])


def alert_category(effect: Column, header: Column, description: Column) -> Column:
    """Words of the text decide first, in this order, then the effect."""
    text = F.lower(F.concat_ws(" ", header, description))

    def has(*words):
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    return (
        F.when(has("elevator"), "elevator").when(has("escalator"), "escalator").when(has("planned"), "planned")
        .when(has("no service"), "no_service").when(has("detour", "bypass", "not stopping"), "detour").when(has("delay"), "delay")
        .when(effect == "no_service", "no_service").when(effect.isin("detour", "modified_service", "stop_moved"), "detour")
        .when(effect.isin("significant_delays", "reduced_service"), "delay").when(effect == "accessibility_issue", "elevator")
        .when(effect.isin("additional_service", "no_effect"), "planned").otherwise("other")
    )


def direction(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def route_signature(legs: Column) -> Column:
    transit = F.filter(legs, lambda leg: leg["type"] == "transit")
    return F.array_join(F.transform(transit, lambda leg: leg["route_id"].cast("string")), ">")
