"""Stops and routes: search, detail, catalogs, modes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import SEARCH_CAP, SEARCH_LIMIT, STOPS_PER_DIRECTION


def is_station(column="location_type"):
    return F.coalesce(F.col(column) == 1, F.lit(False))


def stop_route_types(t) -> DataFrame:
    """Distinct (stop_id, route_id, route_type) over the whole feed."""
    return (
        t.stop_times.select("stop_id", "trip_id")
        .join(t.trips.select("trip_id", "route_id"), "trip_id")
        .select("stop_id", "route_id")
        .distinct()
        .join(t.routes.select("route_id", "route_type"), "route_id")
    )


def served_routes(t) -> DataFrame:
    """(stop_id, route_id, route_type): a stop's own routes and its platforms'; read where
    it is stored."""
    if t.served is not None:
        return t.served
    own = stop_route_types(t)
    child = t.stops.where("parent_station is not null").select("stop_id", "parent_station")
    through = own.join(child, "stop_id").select(F.col("parent_station").alias("stop_id"), "route_id", "route_type")
    return own.select("stop_id", "route_id", "route_type").unionByName(through).distinct()


def stop_modes(t, stops: DataFrame | None = None) -> DataFrame:
    """(stop_id, mode) of every served stop, or those of ``stops``: the best mode that
    serves it."""
    served = served_routes(t)
    if stops is not None:
        served = served.join(stops.select("stop_id"), "stop_id", "left_semi")
    rank = served.groupBy("stop_id").agg(F.min(S.mode_rank(F.col("route_type"))).alias("rank"))
    return rank.where("rank is not null").select("stop_id", S.mode_of_rank(F.col("rank")).alias("mode"))


def route_modes(t) -> DataFrame:
    return t.routes.select("route_id", S.safe_mode(F.col("route_type")).alias("mode"))


def stop_summaries(t, stops: DataFrame | None = None) -> DataFrame:
    """Every served stop, or those of ``stops``."""
    rows = t.stops if stops is None else stops
    return rows.join(stop_modes(t, stops), "stop_id").select(
        "stop_id", "stop_code", F.col("stop_name").alias("name"), "mode", is_station().alias("is_station"), "parent_station",
        F.coalesce("stop_lat", F.lit(0.0)).alias("lat"), F.coalesce("stop_lon", F.lit(0.0)).alias("lon"),
    )


def _triples(text: Column) -> Column:
    """The distinct runs of three letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(text, k, 3)))


def name_grams(t) -> DataFrame:
    """(gram, stop_id): the letter triples of every stop's name, in lower case."""
    name = F.lower("stop_name")
    long = t.stops.where(F.length(name) >= 3)
    return long.select(F.explode(_triples(name)).alias("gram"), "stop_id")


def _named(t, query: str, wildcards: bool) -> DataFrame:
    """Stops whose name holds the query's letters. Where triples are stored, only names that
    have all of the query's are compared; a query without three plain letters in a row, or
    a timetable that is not stored, compares every name."""
    low = query.lower()
    plain = re.split("[%_]", low) if wildcards else [low]
    wanted = sorted({run[k : k + 3] for run in plain for k in range(len(run) - 2) if run[k : k + 3].isascii()})
    stops = t.stops
    if t.grams is not None and wanted:
        found = t.grams.where(F.col("gram").isin(wanted)).groupBy("stop_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        stops = stops.join(found, "stop_id", "left_semi")
    name, letters = F.lower("stop_name"), F.lower(F.lit(query))
    if not wildcards:
        return stops.where(F.contains(name, letters))
    # a backslash is a letter like any other
    return stops.where(F.like(name, F.concat(F.lit("%"), F.replace(letters, F.lit("\\"), F.lit("\\\\")), F.lit("%"))))


def search_by_name(t, query: str, mode: str | None = None, limit: int = SEARCH_LIMIT, wildcards: bool = False) -> DataFrame:
    """Served stops whose name holds the query's letters, by name; ``truncated``
    where there were more than ``limit``. With ``wildcards`` a ``%`` in the query stands for
    any letters and a ``_`` for any one."""
    found = stop_summaries(t, _named(t, query, wildcards))
    if mode:
        found = found.where(F.col("mode") == mode)
    return _capped(found.orderBy("name", "stop_id").limit(SEARCH_CAP), limit, "name", "stop_id")


#: A cell is a place's latitude and longitude in 2 ** 16 steps each, their bits in turn.
_BITS = 16


def _steps(value: float, low: float, width: float) -> int:
    return min((1 << _BITS) - 1, max(0, int((value - low) / width * (1 << _BITS))))


def cell(lat: Column, lon: Column) -> Column:
    """The cell's number: places near each other have numbers with the same first bits."""
    out = F.lit(0).cast("long")
    for value, low, width, shift in ((lat, -90.0, 180.0, 1), (lon, -180.0, 360.0, 0)):
        step = F.least(F.lit((1 << _BITS) - 1), F.greatest(F.lit(0), F.floor((value - low) / width * (1 << _BITS)))).cast("long")
        for k in range(_BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(step, k).bitwiseAND(F.lit(1)), 2 * k + shift))
    return out


def placed_stops(t) -> DataFrame:
    """The stops that have a place, with their ``cell``."""
    return t.stops.where("stop_lat is not null and stop_lon is not null").select(cell(F.col("stop_lat"), F.col("stop_lon")).alias("cell"), "*")


def cell_ranges(low: tuple, high: tuple, most: int = 24) -> list:
    """Ranges of cells that hold all places between two corners (lat, lon): quarters of
    quarters, the largest that reach beyond the box split first, ``most`` of them about."""
    y0, y1 = _steps(low[0], -90.0, 180.0), _steps(high[0], -90.0, 180.0)
    x0, x1 = _steps(low[1], -180.0, 360.0), _steps(high[1], -180.0, 360.0)
    whole, split = [], [(_BITS, 0, 0, 0)]  # bits of a side, corner y and x, first cell
    while split and len(split) + len(whole) < most:
        bits, y, x, first = split.pop(0)
        half = bits - 1
        for q in range(4):
            cy, cx, at = y + ((q >> 1) << half), x + ((q & 1) << half), first + (q << 2 * half)
            if cy > y1 or cx > x1 or cy + (1 << half) <= y0 or cx + (1 << half) <= x0:
                continue
            inside = cy >= y0 and cx >= x0 and cy + (1 << half) - 1 <= y1 and cx + (1 << half) - 1 <= x1
            (whole if inside or not half else split).append((half, cy, cx, at))
    ranges = sorted((at, at + (1 << 2 * bits) - 1) for bits, _, _, at in whole + split)
    out: list = []
    for a, b in ranges:
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _capped(found: DataFrame, limit: int, *order) -> DataFrame:
    # the window is over SEARCH_CAP rows at most
    ranked = found.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    ranked = ranked.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    return ranked.where(F.col("_n") <= limit).drop("_n")


def search_near(t, lat: float, lon: float, radius: float = 500, mode: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Served stops within the radius, nearest first; the mode filter comes after
    the nearest ``SEARCH_CAP`` were taken."""
    import math

    high = radius / 111_000 * 1.01
    wide = high / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + high))))
    if t.places is None:
        box = t.stops.where(F.col("stop_lat").between(lat - high, lat + high) & F.col("stop_lon").between(lon - wide, lon + wide))
    else:
        # stored in order of their cells, of which the box covers a few ranges
        reach = [F.col("cell").between(a, b) for a, b in cell_ranges((lat - high, lon - wide), (lat + high, lon + wide))]
        box = t.places.where(reduce(lambda x, y: x | y, reach)).drop("cell")
    metres = S.metres_between(F.lit(lat), F.lit(lon), F.col("stop_lat"), F.col("stop_lon"))
    near = box.withColumn("metres", metres).where(F.col("metres") <= radius)
    served = served_routes(t).join(near.select("stop_id"), "stop_id", "left_semi").select("stop_id").distinct()
    near = near.join(served, "stop_id", "left_semi").orderBy("metres", "stop_id").limit(SEARCH_CAP)
    found = stop_summaries(t, near.drop("metres")).join(near.select("stop_id", "metres"), "stop_id")
    if mode:
        found = found.where(F.col("mode") == mode)
    return _capped(found, limit, "metres", "stop_id")


def list_routes(t, mode: str | None = None) -> DataFrame:
    out = t.routes.select("route_id", "route_short_name", "route_long_name", S.mode(F.col("route_type")).alias("mode"), F.col("route_color").alias("color"))
    return (out.where(F.col("mode") == mode) if mode else out).orderBy("route_id")


def stop_detail(t, stop_id: int) -> DataFrame:
    """One row, or none where nothing serves the stop or its platforms."""
    routes = (
        served_routes(t).where(F.col("stop_id") == stop_id).select("stop_id", "route_id").distinct().join(list_routes(t), "route_id")
        .groupBy("stop_id").agg(F.sort_array(F.collect_list(F.struct("route_id", "route_short_name", "route_long_name", "mode", "color"))).alias("routes"))
    )
    platforms = t.stops.where(F.col("parent_station") == stop_id).agg(F.sort_array(F.collect_list("stop_id")).alias("platforms"))
    return stop_summaries(t, t.stops.where(F.col("stop_id") == stop_id)).join(routes, "stop_id").crossJoin(platforms)


def as_json(rows: DataFrame) -> DataFrame:
    """(value): a JSON object a row, without what is null or empty text, ids as strings."""
    out = []
    for f in rows.schema.fields:
        x = F.col(f.name).cast("string") if f.name.endswith("_id") or f.name == "parent_station" else F.col(f.name)
        out.append((F.when(x != "", x) if f.dataType.simpleString() == "string" or f.name.endswith("_id") else x).alias(f.name))
    return rows.select(F.to_json(F.struct(*out)).alias("value"))


def route_directions(t) -> DataFrame:
    """(route_id, direction_id, headsign): the most common headsign of each
    direction. A null direction sorts first and then counts as 0."""
    counted = t.trips.groupBy("route_id", "direction_id", "trip_headsign").agg(F.count("*").alias("cnt"))
    order = Window.partitionBy("route_id", S.direction(F.col("direction_id"))).orderBy(
        F.col("direction_id").asc_nulls_first(), F.desc("cnt"), F.col("trip_headsign").asc_nulls_first()
    )
    return counted.withColumn("n", F.row_number().over(order)).where("n = 1").select(
        "route_id", S.direction(F.col("direction_id")).alias("direction_id"), F.coalesce("trip_headsign", F.lit("")).alias("headsign"), "cnt"
    )


def canonical_trips(t) -> DataFrame:
    """(route_id, direction_id, trip_id, stop_count): the longest trip of each direction;
    read where it is stored."""
    if t.canonical is not None:
        return t.canonical
    counted = t.stop_times.groupBy("trip_id").agg(F.count("stop_id").alias("stop_count"))
    trips = t.trips.select("trip_id", "route_id", "direction_id").join(counted, "trip_id")
    order = Window.partitionBy("route_id", S.direction(F.col("direction_id"))).orderBy(
        F.col("direction_id").asc_nulls_first(), F.desc("stop_count"), "trip_id"
    )
    return trips.withColumn("n", F.row_number().over(order)).where("n = 1").select(
        "route_id", S.direction(F.col("direction_id")).alias("direction_id"), "trip_id", "stop_count"
    )


def route_stops(t, cap: int = STOPS_PER_DIRECTION) -> DataFrame:
    """The first stops of every direction's canonical trip, ``truncated`` where
    there are more than ``cap``."""
    rows = canonical_trips(t).join(t.stop_times.select("trip_id", "stop_id", "stop_sequence"), "trip_id")
    rows = rows.join(t.stops.select("stop_id", F.col("stop_name").alias("name")), "stop_id")
    w = Window.partitionBy("route_id", "direction_id")
    ranked = rows.withColumn("position", F.row_number().over(w.orderBy("stop_sequence", "stop_id")).cast("int"))
    return ranked.withColumn("truncated", F.count("*").over(w) > cap).where(F.col("position") <= cap).select(
        "route_id", "direction_id", "position", "stop_id", "name", "truncated"
    )


def terminus(t, short_name: str, by: str = "stop_lon", last: bool = False) -> DataFrame:
    """The station at an end of a route: the one whose platform has the least (``last``: the
    largest) ``stop_lon`` or ``stop_lat``. Platforms without a place are passed over."""
    calls = t.routes.where(F.col("route_short_name") == short_name).select("route_id").join(t.trips.select("trip_id", "route_id"), "route_id").join(t.stop_times.select("trip_id", "stop_id"), "trip_id")
    platforms = t.stops.where("parent_station is not null and stop_lat is not null and stop_lon is not null").join(calls.select("stop_id"), "stop_id", "left_semi")
    stations = t.stops.select(F.col("stop_id").alias("parent_station"), F.col("stop_name").alias("name"))
    ends = platforms.join(stations, "parent_station").groupBy(F.col("parent_station").alias("id"), "name").agg((F.max(by) if last else F.min(by)).alias("metric"))
    return ends.orderBy(F.desc("metric") if last else "metric", "id").limit(1).select("id", "name")


def first_weekday(t) -> DataFrame:
    """(start_date, date, noon): the calendar's first day, the first Monday to Friday from
    there on, and that day's noon in UTC, a time at which trips run. An empty calendar
    gives no row."""
    first = t.calendar.agg(F.min("start_date").alias("start_date")).where("start_date is not null")
    begin = F.to_date(F.col("start_date").cast("string"), "yyyyMMdd")
    days = F.when(S.weekday(begin) == 6, 2).when(S.weekday(begin) == 0, 1).otherwise(0)
    dated = first.select("start_date", F.date_add(begin, days).alias("date"))
    return dated.select("start_date", "date", (F.unix_date("date").cast("long") * 86400 + 43200).alias("noon"))


def trips_existing(t, trip_ids: DataFrame) -> DataFrame:
    """Those of ``trip_ids`` (trip_id) that are static trips, once each."""
    return trip_ids.select("trip_id").distinct().join(t.trips.select("trip_id"), "trip_id", "left_semi")


def count_trips(t) -> DataFrame:
    return t.trips.agg(F.count("*").alias("n"))


def trip_with_route(t, trip_ids: DataFrame) -> DataFrame:
    return t.trips.join(trip_ids, "trip_id", "left_semi").join(t.routes.drop("route_color"), "route_id")
