"""Active services and the next departures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import LOOKAHEAD_DAYS, SCHEDULE_LIMIT

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def active_services(t, dates: DataFrame) -> DataFrame:
    """(date, service_id) for a table of dates: the calendar's rule, and the added,
    less the removed; a service both added and removed on a day is removed."""
    d = dates.select("date", S.yyyymmdd(F.col("date")).alias("day"), S.weekday(F.col("date")).alias("wd"))
    runs = F.get(F.array(*DAYS), F.col("wd")) == 1
    base = d.join(t.calendar, (F.col("start_date") <= F.col("day")) & (F.col("end_date") >= F.col("day")) & runs)
    base = base.select("date", "service_id")
    change = d.select(F.col("date").alias("on"), "day").join(t.calendar_dates.withColumnRenamed("date", "day"), "day")
    added = change.where("exception_type = 1").select(F.col("on").alias("date"), "service_id")
    removed = change.where("not (exception_type <=> 1)").select(F.col("on").alias("date"), "service_id")
    return base.union(added).distinct().join(removed, ["date", "service_id"], "left_anti")


def departures(t, stop_ids: DataFrame | None = None, route_id: int | None = None) -> DataFrame:
    """Departures joined with trip and route, before any day is chosen."""
    rows = t.stop_times.where("dep is not null").select("trip_id", "stop_id", "stop_sequence", "dep")
    if stop_ids is not None:
        rows = rows.join(stop_ids, "stop_id", "left_semi")
    trips = t.trips.select("trip_id", "route_id", "service_id", "trip_headsign", "direction_id")
    if route_id is not None:
        trips = trips.where(F.col("route_id") == route_id)
    return rows.join(trips, "trip_id").join(t.routes.select("route_id", "route_short_name"), "route_id")


def packed_departures(t, services: DataFrame | None = None) -> DataFrame:
    """One row for each stop and pattern (route, direction, headsign): a map from service to
    its departures in order of time, trip and sequence. Read where it is stored; where it is
    not, of ``services`` (service_id) alone if they are given. Dealt by stop once."""
    if t.boards is not None:
        return t.boards
    rows = t.stop_times.where("dep is not null").select("trip_id", "stop_id", F.col("stop_sequence").alias("seq"), "dep")
    trips = t.trips.select("trip_id", "route_id", "service_id", "trip_headsign", "direction_id")
    if services is not None:
        trips = trips.join(services.select("service_id").distinct(), "service_id", "left_semi")
    rows = rows.join(trips, "trip_id").join(t.routes.select("route_id", "route_type"), "route_id", "left").repartition("stop_id")
    pattern = ["stop_id", "route_id", "direction_id", "trip_headsign", "route_type"]
    # an array is one service day of one pattern at one stop
    daily = rows.where("service_id is not null").groupBy(*pattern, "service_id").agg(F.sort_array(F.collect_list(F.struct("dep", "trip_id", "seq"))).alias("departures"))
    return daily.groupBy(*pattern).agg(F.map_from_entries(F.collect_list(F.struct("service_id", "departures"))).alias("departures"))


def day_departures(t, running: DataFrame, modes: list | None = None) -> DataFrame:
    """(stop_id, route_id, headsign, midnight, dep, trip_id, seq, before): the departures of
    all services that run on a day (midnight, service_id), each with the time of the one
    before it of its pattern (route, direction, headsign) at the stop, if any."""
    trips = t.trips.select("trip_id", "route_id", "service_id", "trip_headsign", "direction_id")
    if modes:
        trips = trips.join(t.routes.where(S.safe_mode(F.col("route_type")).isin(*modes)).select("route_id"), "route_id", "left_semi")
    down = t.stop_times if t.runs is None else t.runs
    rows = down.where("dep is not null").select("trip_id", "stop_id", F.col("stop_sequence").alias("seq"), "dep")
    rows = rows.join(trips.join(running, "service_id"), "trip_id")
    order = Window.partitionBy("stop_id", "midnight", "route_id", "direction_id", "trip_headsign").orderBy("dep", "trip_id", "seq")
    return rows.select("stop_id", "route_id", F.coalesce("trip_headsign", F.lit("")).alias("headsign"), "midnight", "dep", "trip_id", "seq", F.lag("dep").over(order).alias("before"))


def first_departure(departures: Column, services: Column, time: Column) -> Column:
    """The first packed departure (dep, trip_id, seq) of the services at or after ``time``."""
    return F.array_min(F.transform(services, lambda x: F.get(departures[x], departures_before(departures[x], time))))


def departures_before(departures: Column, time: Column) -> Column:
    """How many of the packed departures leave before ``time``, by binary search."""
    whole = F.struct(F.lit(0).alias("lo"), F.size(departures).alias("hi"))

    def halve(span, _):
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        early, open_ = F.get(departures, mid)["dep"] < time, span["lo"] < span["hi"]
        return F.struct(F.when(open_ & early, mid + 1).otherwise(span["lo"]).alias("lo"), F.when(open_ & ~early, mid).otherwise(span["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(departures) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, whole, halve, lambda span: span["lo"])


def boarding_stops(t, requests: DataFrame) -> DataFrame:
    """(request_id, stop_id, platform): a station's platforms, else the stop itself."""
    asked = requests.select("request_id", F.col("stop_id").alias("asked"))
    known = asked.join(t.stops.select(F.col("stop_id").alias("asked"), "location_type"), "asked")
    child = t.stops.where("parent_station is not null").select("stop_id", F.col("parent_station").alias("asked"))
    platforms = known.where("location_type <=> 1").join(child, "asked").select("request_id", "stop_id", F.lit(True).alias("platform"))
    own = known.where("not (location_type <=> 1)").select("request_id", F.col("asked").alias("stop_id"), F.lit(False).alias("platform"))
    return platforms.unionByName(own)


def first_departures(rows: DataFrame, by: list, n: int) -> DataFrame:
    """The first ``n`` departures of each group, numbered by ``k``."""
    order = Window.partitionBy(*by).orderBy("dep", "trip_id", "stop_id", "stop_sequence")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)


def next_departures(t, requests: DataFrame, limit: int = SCHEDULE_LIMIT, route_id: int | None = None) -> DataFrame:
    """The next ``limit`` departures of every request (request_id, stop_id, when
    in epoch seconds), over service days -1 to +14; one request is a table of one
    row. ``truncated``: there were more; ``base``: there was one by the day after.

    From the day after on a service's whole day counts, so its first departures at a
    request's stops are the same on every such day and are ranked once; days are put to
    those few. Only the two days around ``when`` compare each departure with it. What is
    ranked are numbers alone; names are joined to the departures that are told."""
    offsets = F.explode(F.sequence(F.lit(-1), F.lit(LOOKAHEAD_DAYS)))
    days = requests.select("request_id", "when", S.service_date(F.col("when")).alias("today")).withColumn("offset", offsets)
    days = days.withColumn("date", F.date_add("today", F.col("offset")))
    services = active_services(t, days.select("date").distinct())
    days = days.join(services, "date").withColumn("from", S.since_midnight(F.col("date"), F.col("when")))
    places = boarding_stops(t, requests)
    # stored by trip, stop times meet trips where they are
    rows = (t.stop_times if t.runs is None else t.runs).where("dep is not null").select("trip_id", "stop_id", "stop_sequence", "dep")
    trips = t.trips if route_id is None else t.trips.where(F.col("route_id") == route_id)
    served = trips.join(t.routes.select("route_id"), "route_id", "left_semi").select("trip_id", "service_id")
    rows = rows.join(served, "trip_id").join(places, "stop_id")
    near = rows.join(days.where("offset <= 0"), ["request_id", "service_id"]).where(F.col("dep") >= F.col("from"))
    near = first_departures(near, ["request_id", "date"], limit + 1)
    whole = first_departures(rows, ["request_id", "service_id"], limit + 1).join(days.where("offset > 0"), ["request_id", "service_id"])
    rows = near.unionByName(first_departures(whole, ["request_id", "date"], limit + 1))
    rows = rows.withColumn("at", S.absolute(F.col("date"), F.col("dep"))).where(F.col("at") >= F.col("when"))
    every = Window.partitionBy("request_id")
    rows = rows.withColumn("k", F.row_number().over(every.orderBy("at", "trip_id", "stop_id")))
    rows = rows.withColumn("truncated", F.count("*").over(every) > limit).withColumn("base", F.max(F.col("offset") <= 1).over(every))
    names = trips.select("trip_id", "route_id", "trip_headsign", "direction_id").join(t.routes.select("route_id", "route_short_name"), "route_id")
    return rows.where(F.col("k") <= limit).join(names, "trip_id").select(
        "request_id", F.col("k").cast("int").alias("k"), "route_id", "route_short_name",
        F.coalesce("trip_headsign", F.lit("")).alias("headsign"), S.direction(F.col("direction_id")).alias("direction_id"),
        "at", S.iso_local(F.col("at")).alias("scheduled_time"), F.when(F.col("platform"), F.col("stop_id")).alias("platform_stop_id"),
        "truncated", "base",
    )


def schedule_hint(found: list, route_given: bool) -> str | None:
    """The note that goes with one request's departures."""
    if not found:
        return "No scheduled service found in the next 14 days."
    if not found[0]["base"]:
        return f"No service in the window asked for; showing the next available service day from {found[0]['scheduled_time']}."
    if found[0]["truncated"] and not route_given:
        return "Only the first departures are shown; naming a route shortens the list."
    return None
