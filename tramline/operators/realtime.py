"""Arrivals, vehicles and alerts from snapshots, and the trip-id join report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ARRIVALS_LIMIT, CAUSES, EFFECTS, FEED_LIMIT, OCCUPANCIES, SEVERITIES
from .catalog import count_trips, route_modes, stop_modes

UPDATES = "trip_id string, route_id string, stops array<struct<stop_id: string, arrival: long, departure: long>>"
VEHICLES = "vehicle_id string, route_id string, trip_id string, lat double, lon double, bearing double, occupancy int, timestamp long"
_TEXT = "array<struct<text: string, language: string>>"
ALERTS = (
    f"id string, header {_TEXT}, description {_TEXT}, url {_TEXT}, cause int, effect int, severity int, "
    "informed array<struct<route_id: string, stop_id: string, route_type: int>>, active array<struct<start: long, end: long>>"
)


def placed(feed: DataFrame) -> DataFrame:
    """A feed's rows with their place in it, ``position``: snapshots bring it; of other
    tables it is the order in which their rows are read."""
    return feed if "position" in feed.columns else feed.withColumn("position", F.monotonically_increasing_id())


def predicted_arrivals(t, updates: DataFrame, stop_ids: DataFrame, now: int, route_id: str | None = None, limit: int = ARRIVALS_LIMIT) -> DataFrame:
    """Predictions at the stops (asked, stop_id), soonest first, with the static
    trip's identity where its id is known and the feed's own where it is not.

    ``limit`` + 1 are taken before those that no route can be found for go."""
    rows = updates.select("trip_id", "route_id", F.explode("stops").alias("s")).select(
        "trip_id", "route_id", S.to_int(F.col("s.stop_id")).alias("rt_stop_id"), F.coalesce("s.arrival", "s.departure").alias("at")
    )
    if route_id is not None:
        rows = rows.where(F.col("route_id") == route_id)
    rows = rows.where(F.col("at").isNotNull() & (F.col("at") >= now))
    rows = rows.join(t.rt_stop_crosswalk.join(stop_ids, "stop_id"), "rt_stop_id")
    order = Window.partitionBy("asked").orderBy("at", "trip_id", "rt_stop_id")
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit + 1)
    static = t.trips.select(F.col("trip_id").alias("static_id"), F.col("route_id").alias("static_route"), "trip_headsign", "direction_id")
    rows = rows.withColumn("number", S.to_int(F.col("trip_id"))).join(static, F.col("number") == F.col("static_id"), "left")
    rows = rows.withColumn("route", F.coalesce(F.col("static_route"), S.to_int(S.presence_trimmed(F.col("route_id")))))
    rows = rows.where("route is not null").join(t.routes.select(F.col("route_id").alias("route"), "route_short_name"), "route", "left")
    w = Window.partitionBy("asked")
    rows = rows.withColumn("n", F.row_number().over(w.orderBy("k"))).withColumn("truncated", F.count("*").over(w) > limit)
    return rows.where(F.col("n") <= limit).select(
        "asked", "route", "route_short_name", F.coalesce("trip_headsign", F.lit("")).alias("headsign"),
        F.coalesce("direction_id", F.lit(0)).alias("direction_id"), "at", S.iso_local(F.col("at")).alias("time"),
        F.lit(True).alias("realtime"), F.lit("predicted").alias("source"), "n", "truncated",
    )


def vehicles_for_route(vehicles: DataFrame, route_id: str, now: int, limit: int = FEED_LIMIT) -> DataFrame:
    """Vehicles of a route in the feed's order; ``truncated`` where there are more."""
    rows = placed(vehicles).where((F.col("route_id") != "") & (F.col("route_id") == route_id))
    rows = rows.where("vehicle_id is not null and lat is not null and lon is not null")
    return first_of_feed(rows, limit).select(
        "vehicle_id", "lat", "lon", "bearing", "route_id", S.presence(F.col("trip_id")).alias("trip_id"),
        S.name_of(F.col("occupancy"), OCCUPANCIES).alias("occupancy_status"), S.iso_local(F.coalesce("timestamp", F.lit(now))).alias("timestamp"),
        "position", "truncated",
    )


def first_of_feed(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by ``position``, and whether there were more."""
    few = rows.orderBy("position").limit(limit + 1)  # so the window is over few rows
    few = few.withColumn("_n", F.row_number().over(Window.orderBy("position")))
    return few.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_n") <= limit).drop("_n")


def alerts(t, feed: DataFrame) -> DataFrame:
    """Alerts with names, category, and the routes, stops and modes they concern."""
    named = placed(feed).select(
        "*", S.translated(F.col("header")).alias("h"), S.translated(F.col("description")).alias("d"), S.translated(F.col("url")).alias("u"),
        S.name_of(F.col("effect"), EFFECTS).alias("e"),
    )
    parts = named.select("id", F.explode_outer("informed").alias("i")).select(
        "id", S.presence(F.col("i.route_id")).alias("route"), S.presence(F.col("i.stop_id")).alias("stop"), S.safe_mode(F.col("i.route_type")).alias("own")
    )
    parts = (
        parts.join(route_modes(t).select(F.col("route_id").cast("string").alias("route"), F.col("mode").alias("by_route")), "route", "left")
        .join(stop_modes(t).select(F.col("stop_id").cast("string").alias("stop"), F.col("mode").alias("by_stop")), "stop", "left")
        .groupBy("id").agg(
            F.sort_array(F.collect_set("route")).alias("routes"), F.sort_array(F.collect_set("stop")).alias("stops"),
            F.sort_array(F.array_distinct(F.flatten(F.array(F.collect_set("own"), F.collect_set("by_route"), F.collect_set("by_stop"))))).alias("modes"),
        )
    )
    return named.join(parts, "id").select(
        "id", F.coalesce("h", F.lit("")).alias("header"), F.col("d").alias("description"), S.name_of(F.col("severity"), SEVERITIES).alias("severity"),
        S.name_of(F.col("cause"), CAUSES).alias("cause"), F.col("e").alias("effect"), S.alert_category(F.col("e"), F.col("h"), F.col("d")).alias("category"),
        "routes", "stops", "modes", F.col("active").alias("active_period"), F.col("u").alias("url"), "position",
    )


def matching_alerts(found: DataFrame, mode=None, route=None, stop=None, category=None, limit: int = FEED_LIMIT) -> DataFrame:
    """Alerts that meet every filter given, in the feed's order; ``truncated`` where there
    are more than ``limit``."""
    for column, value in (("modes", mode), ("routes", route), ("stops", stop)):
        if value is not None:
            found = found.where(F.coalesce(F.array_contains(column, str(value)), F.lit(False)))
    return first_of_feed(found.where(F.col("category") == category) if category else found, limit)


def join_report(t, updates: DataFrame, sample: int = 10) -> DataFrame:
    """One row: how many of the feed's trip ids the static side knows, how many updates
    without a known trip still name a route, and the first ids in the feed's order that
    are unknown (numbers before others) or no numbers.

    An update with a null or empty trip id counts as an update, not as an id."""
    rows = placed(updates).select("position", F.col("trip_id").alias("raw"), S.to_int(F.col("trip_id")).alias("trip_id"), S.presence_trimmed(F.col("route_id")).alias("route"))
    rows = rows.join(t.trips.select("trip_id", F.lit(True).alias("known")), "trip_id", "left")
    named, number, known = F.col("raw").isNotNull() & (F.col("raw") != ""), F.col("trip_id").isNotNull(), F.col("known").isNotNull()
    per_id = rows.where(named).groupBy("raw").agg(
        F.min("position").alias("position"), F.max(number).alias("number"), F.max(known).alias("known"), F.count("*").alias("n")
    )
    # the first ids alone go to one list
    unknown = per_id.where("not known").orderBy(F.desc("number"), "position").limit(sample)
    odd = rows.where(named & ~number).orderBy("position").limit(sample)
    lists = [
        df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "raw"))), lambda x: x["raw"]).alias(name))
        for df, order, name in ((unknown, [(~F.col("number")).alias("late"), "position"], "sample_unmatched_trip_ids"), (odd, ["position"], "sample_non_numeric_trip_ids"))
    ]
    by_id = per_id.agg(
        F.count("*").alias("distinct_rt_trip_ids"), F.count_if("number").alias("numeric_trip_ids"), F.count_if("known").alias("matched_trip_ids"),
        F.count_if(~F.col("known")).alias("unmatched_trip_ids"), F.coalesce(F.sum(F.when(~F.col("number"), F.col("n"))), F.lit(0)).alias("non_numeric_trip_ids"),
    )
    by_update = rows.agg(
        F.count("*").alias("rt_trip_updates"), F.count_if(~known).alias("unmatched_updates"), F.count_if(~known & F.col("route").isNotNull()).alias("unmatched_updates_recovered")
    )
    one = count_trips(t).withColumnRenamed("n", "static_trip_count")
    for part in (by_update, by_id, *lists):
        one = one.crossJoin(part)  # of one row each
    share = F.col("matched_trip_ids") * 1000 / F.nullif(F.col("distinct_rt_trip_ids"), F.lit(0))
    return one.withColumns(
        {"overlap_pct": F.coalesce(F.floor(share + 0.5) / 10, F.lit(0.0)), "unmatched_updates_unrecoverable": F.col("unmatched_updates") - F.col("unmatched_updates_recovered")}
    )


def fares(spark, category: str | None = None, fare_type: str | None = None) -> DataFrame:
    from ..schemas import FARES

    out = spark.createDataFrame(FARES, "category string, fare_type string, price double, currency string")
    for column, value in (("category", category), ("fare_type", fare_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def fares_of(spark, asked: DataFrame) -> DataFrame:
    """``asked`` (category, and other columns) with the fares of each row's category."""
    return asked.join(F.broadcast(fares(spark)), "category")  # the table's nine rows
