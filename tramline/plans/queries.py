"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, itineraries, realtime, routing, schedule, transfers
from ..schemas import FARES
from ..sources.testviews import timetable, with_views
from ..timetable import Timetable

#: 2026-07-24 08:00 in Toronto.
WHEN = 1784894400
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function of (timetable, spark, sf_dir) under its name."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(timetable(spark, sf_dir), spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = with_views(sql)
        return function

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DEPARTURES = "v_stop_times st JOIN v_trips t ON st.trip_id = t.trip_id JOIN v_routes r ON t.route_id = r.route_id"


@query(f"""SELECT r.route_id, r.route_short_name, t.trip_headsign AS headsign, t.direction_id, st.dep, st.trip_id
    FROM {_DEPARTURES} WHERE st.stop_id = 1 AND t.service_id = 0 AND st.dep >= 28800 ORDER BY st.dep, st.trip_id, st.stop_sequence LIMIT 20""")
def j1_departures_of_stop(t: Timetable, spark, sf_dir):
    rows = t.stop_times.where((F.col("stop_id") == 1) & (F.col("dep") >= 28800)).join(t.trips.where("service_id = 0"), "trip_id").join(t.routes, "route_id")
    return rows.orderBy("dep", "trip_id", "stop_sequence").limit(20).select("route_id", "route_short_name", F.col("trip_headsign").alias("headsign"), "direction_id", "dep", "trip_id")


@query(f"""WITH_DAYS SELECT * FROM (SELECT stop_id, cast(k AS int) AS k, route_id, headsign, direction_id, cast("at" AS bigint) AS "at", truncated FROM
    (SELECT s.request AS stop_id, row_number() OVER (PARTITION BY s.request ORDER BY d.midnight + st.dep, st.trip_id, st.stop_id) AS k,
    count(*) OVER (PARTITION BY s.request) > 5 AS truncated, r.route_id, t.trip_headsign AS headsign, t.direction_id, d.midnight + st.dep AS "at"
    FROM {_DEPARTURES} JOIN (SELECT stop_id AS request, stop_id FROM v_stops WHERE location_type = 0 UNION ALL
    SELECT parent_station, stop_id FROM v_stops WHERE parent_station IN (SELECT stop_id FROM v_stops)) AS s ON st.stop_id = s.stop_id
    JOIN v_days d ON d.service_id = t.service_id WHERE d.midnight + st.dep >= {WHEN}) AS every WHERE k <= 5) AS final""")
def q6_next_departures(t: Timetable, spark, sf_dir):
    asked = t.stops.select(F.col("stop_id").alias("request_id"), "stop_id", F.lit(WHEN).alias("when"))
    out = schedule.next_departures(t, asked, limit=5)
    return out.select(F.col("request_id").alias("stop_id"), "k", "route_id", "headsign", "direction_id", "at", "truncated")


def _days_sql() -> str:
    """(service_id, midnight) of service days -1 to +14 around WHEN: the calendar of
    the views runs service k on weekday k, with its exceptions written out."""
    rows = []
    removed, added = {(20260724, 5), (20260725, 2)}, {(20260724, 1), (20260725, 2)}
    import datetime as dt

    for i in range(16):
        day = dt.date(2026, 7, 23) + dt.timedelta(days=i)
        number = day.year * 10000 + day.month * 100 + day.day
        active = {(number, (day.weekday() + 1) % 7)} | {x for x in added if x[0] == number}
        for _, service in sorted(active - removed):
            rows.append(f"({service}, {1784779200 + 86400 * i})")
    return f"v_days AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(service_id, midnight))"


ORACLES["q6_next_departures"] = ORACLES["q6_next_departures"].replace(") WITH_DAYS SELECT", f"), {_days_sql()} SELECT")


@query("""WITH_DATES SELECT cast(date AS varchar(10)) AS date, service_id FROM (SELECT d.date, c.service_id FROM d JOIN v_calendar c ON d.day >= c.start_date AND d.day <= c.end_date
    AND (CASE d.wd WHEN 0 THEN c.sunday WHEN 1 THEN c.monday WHEN 2 THEN c.tuesday WHEN 3 THEN c.wednesday WHEN 4 THEN c.thursday WHEN 5 THEN c.friday ELSE c.saturday END) = 1
    UNION SELECT d.date, x.service_id FROM d JOIN v_calendar_dates x ON x.date = d.day WHERE x.exception_type = 1) AS runs
    WHERE NOT EXISTS (SELECT 1 FROM d JOIN v_calendar_dates x ON x.date = d.day WHERE x.exception_type <> 1 AND d.date = runs.date AND x.service_id = runs.service_id)""")
def q15_active_services(t: Timetable, spark, sf_dir):
    """On every day of the year on which there is an order, and around the exceptions."""
    day = F.make_date(F.lit(2026), F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(28)))
    return schedule.active_services(t, _read(spark, sf_dir, "orders").select(day.alias("date")).distinct()).select(F.col("date").cast("string").alias("date"), "service_id")


_DATES = """d AS (SELECT date, cast(year(date) * 10000 + month(date) * 100 + day(date) AS int) AS day, dayofweek(date) AS wd
    FROM (SELECT DISTINCT make_date(2026, month(o_orderdate), least(day(o_orderdate), 28)) AS date FROM orders) AS x)"""
ORACLES["q15_active_services"] = ORACLES["q15_active_services"].replace(") WITH_DATES SELECT", f"), {_DATES} SELECT")


@query(f"""SELECT * FROM (SELECT t.service_id, st.stop_id, st.trip_id, st.dep, cast(row_number() OVER (PARTITION BY st.stop_id, t.service_id ORDER BY st.dep, st.trip_id, st.stop_sequence) AS int) AS k
    FROM {_DEPARTURES} WHERE st.dep >= 30000) AS ranked WHERE k <= 3""")
def w4_first_departures_by_day(t: Timetable, spark, sf_dir):
    rows = schedule.first_departures(schedule.departures(t).where("dep >= 30000"), ["stop_id", "service_id"], 3)
    return rows.select("service_id", "stop_id", "trip_id", "dep", F.col("k").cast("int").alias("k"))


_SUMMARY = """SELECT s.stop_id, s.stop_code, s.stop_name AS name, m.mode, s.location_type = 1 AS is_station, s.parent_station,
    round(s.stop_lat, 6) AS lat, round(s.stop_lon, 6) AS lon FROM v_stops s JOIN v_modes m ON s.stop_id = m.stop_id"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query(_SUMMARY)
def q12_list_stops(t: Timetable, spark, sf_dir):
    return _rounded(catalog.stop_summaries(t))


@query(_SUMMARY + " WHERE lower(s.stop_name) LIKE '%00001%' ORDER BY s.stop_name, s.stop_id LIMIT 5")
def q1_search_stops_by_name(t: Timetable, spark, sf_dir):
    return _rounded(catalog.search_by_name(t, "00001", limit=5)).drop("truncated")


_METRES = "2 * 6371000 * asin(sqrt(pow(sin((radians(s.stop_lat) - radians(cast(43.7 AS double))) / 2), 2) + cos(radians(cast(43.7 AS double))) * cos(radians(s.stop_lat)) * pow(sin((radians(s.stop_lon) - radians(cast(-79.5 AS double))) / 2), 2)))"


@query(f"SELECT s.stop_id, m.mode, cast(round({_METRES}) AS int) AS metres FROM v_stops s JOIN v_modes m ON s.stop_id = m.stop_id WHERE {_METRES} <= 5000 ORDER BY {_METRES}, s.stop_id LIMIT 20")
def q2_search_stops_near(t: Timetable, spark, sf_dir):
    return catalog.search_near(t, 43.7, -79.5, 5000).select("stop_id", "mode", F.round("metres").cast("int").alias("metres"))


@query("""SELECT s.stop_id, m.mode, cast(count(DISTINCT t.route_id) AS bigint) AS n_routes, cast((SELECT count(*) FROM v_stops c WHERE c.parent_station = 5) AS bigint) AS n_platforms
    FROM v_stops s JOIN v_modes m ON s.stop_id = m.stop_id JOIN v_stops p ON p.stop_id = s.stop_id OR p.parent_station = s.stop_id
    JOIN v_stop_times st ON st.stop_id = p.stop_id JOIN v_trips t ON st.trip_id = t.trip_id WHERE s.stop_id = 5 GROUP BY s.stop_id, m.mode""")
def q3_stop_detail(t: Timetable, spark, sf_dir):
    return catalog.stop_detail(t, 5).select("stop_id", "mode", F.size("routes").cast("long").alias("n_routes"), F.size("platforms").cast("long").alias("n_platforms"))


_MODE = "CASE route_type WHEN 1 THEN 'subway' WHEN 0 THEN 'streetcar' ELSE 'bus' END"


@query(f"SELECT route_id, route_short_name, route_long_name, {_MODE} AS mode, route_color AS color FROM v_routes WHERE route_type = 1")
def q4_list_routes(t: Timetable, spark, sf_dir):
    return catalog.list_routes(t, "subway")


@query("""SELECT route_id, direction_id, headsign, cnt FROM (SELECT route_id, direction_id, trip_headsign AS headsign, count(*) AS cnt,
    row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, trip_headsign) AS n FROM v_trips GROUP BY route_id, direction_id, trip_headsign) AS x WHERE n = 1""")
def q5_route_directions(t: Timetable, spark, sf_dir):
    return catalog.route_directions(t)


_CANONICAL = """SELECT * FROM (SELECT t.route_id, t.direction_id, t.trip_id, c.stop_count, row_number() OVER (PARTITION BY t.route_id, t.direction_id ORDER BY c.stop_count DESC, t.trip_id) AS n
    FROM v_trips t JOIN (SELECT trip_id, count(stop_id) AS stop_count FROM v_stop_times GROUP BY trip_id) AS c ON t.trip_id = c.trip_id) AS ranked WHERE n = 1"""


@query(f"SELECT route_id, direction_id, trip_id, stop_count FROM ({_CANONICAL}) AS x")
def q5_canonical_trips(t: Timetable, spark, sf_dir):
    return catalog.canonical_trips(t)


@query(f"""SELECT route_id, direction_id, cast(position AS int) AS position, stop_id, name, total > 3 AS truncated FROM (SELECT c.route_id, c.direction_id,
    row_number() OVER (PARTITION BY c.route_id, c.direction_id ORDER BY st.stop_sequence, st.stop_id) AS position, count(*) OVER (PARTITION BY c.route_id, c.direction_id) AS total,
    st.stop_id, s.stop_name AS name FROM ({_CANONICAL}) AS c JOIN v_stop_times st ON st.trip_id = c.trip_id JOIN v_stops s ON s.stop_id = st.stop_id) AS x WHERE position <= 3""")
def q5_route_stops(t: Timetable, spark, sf_dir):
    return catalog.route_stops(t, 3)


@query("""SELECT s.stop_id FROM v_stops s WHERE EXISTS (SELECT 1 FROM v_stop_times st JOIN v_trips t ON st.trip_id = t.trip_id JOIN v_routes r ON t.route_id = r.route_id
    WHERE st.stop_id = s.stop_id AND r.route_type = 1) OR EXISTS (SELECT 1 FROM v_stop_times st JOIN v_stops c ON c.stop_id = st.stop_id
    JOIN v_trips t ON st.trip_id = t.trip_id JOIN v_routes r ON t.route_id = r.route_id WHERE c.parent_station = s.stop_id AND r.route_type = 1)""")
def j8_stops_served_by_mode(t: Timetable, spark, sf_dir):
    return t.stops.join(catalog.served_routes(t).where(F.col("route_type") == S.type_of_mode(F.lit("subway"))), "stop_id", "left_semi").select("stop_id")


@query("""SELECT st.stop_id, t.route_id, r.route_type FROM v_stop_times st JOIN v_trips t ON st.trip_id = t.trip_id JOIN v_routes r ON t.route_id = r.route_id GROUP BY st.stop_id, t.route_id, r.route_type""")
def j14_route_types_by_stop(t: Timetable, spark, sf_dir):
    return catalog.stop_route_types(t).select("stop_id", "route_id", "route_type")


@query("SELECT t.trip_id, t.route_id, t.trip_headsign AS headsign, r.route_long_name FROM v_trips t JOIN v_routes r ON t.route_id = r.route_id WHERE t.trip_id IN (1, 2, 3, 32, 33)")
def q16_static_trips(t: Timetable, spark, sf_dir):
    ids = spark.createDataFrame([(x,) for x in (1, 2, 3, 32, 33, -5)], "trip_id long")
    return catalog.trip_with_route(t, ids).select("trip_id", "route_id", F.col("trip_headsign").alias("headsign"), "route_long_name")


_END = """SELECT p.parent_station AS id, q.stop_name AS name FROM v_routes r JOIN v_trips t ON r.route_id = t.route_id JOIN v_stop_times st ON st.trip_id = t.trip_id JOIN v_stops p ON p.stop_id = st.stop_id
    JOIN v_stops q ON q.stop_id = p.parent_station WHERE r.route_short_name = '7' AND p.stop_lat IS NOT NULL AND p.stop_lon IS NOT NULL GROUP BY p.parent_station, q.stop_name ORDER BY METRIC, p.parent_station LIMIT 1"""


@query(_END.replace("METRIC", "min(p.stop_lon)"))
def q18_terminus(t: Timetable, spark, sf_dir):
    """The western end."""
    return catalog.terminus(t, "7")


@query(_END.replace("METRIC", "max(p.stop_lat) DESC"))
def q18_terminus_north(t: Timetable, spark, sf_dir):
    return catalog.terminus(t, "7", "stop_lat", last=True)


@query("""SELECT start_date, cast(day AS date) AS date, cast(epoch(day) AS bigint) + 43200 AS noon FROM (SELECT start_date, first + to_days(CASE dayofweek(first) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END) AS day
    FROM (SELECT min(start_date) AS start_date, strptime(cast(min(start_date) AS varchar), '%Y%m%d') AS first FROM v_calendar) AS a) AS b""")
def a5_first_weekday(t: Timetable, spark, sf_dir):
    return catalog.first_weekday(t)


@query("SELECT from_stop_id, to_stop_id, min_walk_seconds, type FROM v_station")
def b3_station_transfers(t: Timetable, spark, sf_dir):
    return transfers.station_transfers(t.stops)


@query("SELECT from_stop_id, to_stop_id, min_walk_seconds, type FROM v_street WHERE metres <= 2500")
def b5_street_transfers(t: Timetable, spark, sf_dir):
    return transfers.street_transfers(t.stops, 2500)


@query("SELECT from_stop_id, to_stop_id, min_walk_seconds, type FROM v_transfers")
def b6_merged_transfers(t: Timetable, spark, sf_dir):
    return t.transfers


#: Another feed: the same codes for two stops in three, other ids, and stations of its own.
_OTHER = """SELECT cast(stop_id + 90000 AS bigint) AS stop_id, CASE WHEN stop_id % 3 = 0 THEN NULL ELSE stop_code END AS stop_code, stop_name, stop_lat, stop_lon,
    cast(CASE WHEN stop_id % 4 = 0 THEN 90001 END AS bigint) AS parent_station, cast(CASE WHEN stop_id % 10 = 1 THEN 1 ELSE 0 END AS int) AS location_type FROM v_stops"""
_OVERLAID = f"""SELECT s.stop_id, coalesce(o.parent_station, s.parent_station) AS parent_station FROM v_stops s LEFT JOIN ({_OTHER}) AS o ON o.stop_code = s.stop_code AND o.parent_station IS NOT NULL"""


def _other(t):
    return t.stops.select(
        (F.col("stop_id") + 90000).alias("stop_id"), F.when(F.col("stop_id") % 3 != 0, F.col("stop_code")).alias("stop_code"), "stop_name", "stop_lat", "stop_lon",
        F.when(F.col("stop_id") % 4 == 0, F.lit(90001)).cast("long").alias("parent_station"), F.when(F.col("stop_id") % 10 == 1, 1).otherwise(0).alias("location_type"),
    )


@query(f"{_OVERLAID} UNION ALL SELECT stop_id, parent_station FROM ({_OTHER}) AS n WHERE location_type = 1")
def b1_station_overlay(t: Timetable, spark, sf_dir):
    return transfers.overlay(t.stops, _other(t))[0].select("stop_id", "parent_station")


@query(f"""SELECT o.stop_id AS rt_stop_id, min(w.stop_id) AS stop_id FROM ({_OTHER}) AS o JOIN (SELECT stop_id, stop_code FROM v_stops UNION ALL
    SELECT stop_id, stop_code FROM ({_OTHER}) AS n WHERE location_type = 1) AS w ON o.stop_code = w.stop_code GROUP BY o.stop_id""")
def b2_crosswalk(t: Timetable, spark, sf_dir):
    return transfers.overlay(t.stops, _other(t))[1]


_BOARD = """SELECT * FROM (SELECT st.stop_id, t.route_id, t.direction_id, t.trip_headsign AS headsign, st.dep, st.trip_id, st.stop_sequence AS board_seq,
    row_number() OVER (PARTITION BY st.stop_id, t.route_id, t.direction_id, t.trip_headsign ORDER BY st.dep, st.trip_id, st.stop_sequence) AS n
    FROM v_stop_times st JOIN v_trips t ON st.trip_id = t.trip_id WHERE t.service_id = 1 AND st.dep >= 20000 + (st.stop_id * 100) % 40000) AS b WHERE n = 1"""


def _boarded(t, spark, modes: list | None = None):
    """Every stop, each from a time of its own on."""
    marked = t.stops.select(F.lit(0).cast("long").alias("solve"), F.lit("d").alias("date"), "stop_id", (20000 + (F.col("stop_id") * 100) % 40000).alias("min_dep"))
    return routing.boardings(t, marked, spark.createDataFrame([("d", 1)], "date string, service_id long"), modes)


@query(f"SELECT stop_id, route_id, direction_id, headsign, dep, trip_id, board_seq FROM ({_BOARD}) AS x")
def j4_boardings(t: Timetable, spark, sf_dir):
    return _boarded(t, spark).select("stop_id", "route_id", "direction_id", "headsign", "dep", "trip_id", "board_seq")


@query(f"SELECT b.stop_id, b.trip_id, d.stop_id AS to_stop, d.stop_sequence AS seq, d.arr FROM ({_BOARD}) AS b JOIN v_stop_times d ON d.trip_id = b.trip_id AND d.stop_sequence > b.board_seq")
def j5_rides(t: Timetable, spark, sf_dir):
    return routing.rides(t, _boarded(t, spark)).select("stop_id", "trip_id", "to_stop", "seq", "arr")


@query(f"""SELECT w.to_stop_id AS stop_id, min(b.dep + w.min_walk_seconds) AS at FROM ({_BOARD}) AS b JOIN v_transfers w ON w.from_stop_id = b.stop_id WHERE w.type <> 'pathway' GROUP BY w.to_stop_id""")
def j7_footpaths(t: Timetable, spark, sf_dir):
    labels = _boarded(t, spark).select("stop_id", F.col("dep").alias("at"))
    return routing.best_walks(t, labels, [], ["at"]).select("stop_id", F.col("b.at").cast("int").alias("at"))


@query(f"""SELECT to_stop AS stop_id, min(arr) AS at FROM (SELECT b.stop_id, d.stop_id AS to_stop, d.arr FROM ({_BOARD}) AS b JOIN v_stop_times d ON d.trip_id = b.trip_id AND d.stop_sequence > b.board_seq) AS x GROUP BY to_stop""")
def a8_earliest_arrivals(t: Timetable, spark, sf_dir):
    return routing.rides(t, _boarded(t, spark)).groupBy(F.col("to_stop").alias("stop_id")).agg(F.min("arr").alias("at"))


def _ladder_sql(rounds: int = 3, midnight: int = WHEN - 28800, horizon: int = WHEN + 6 * 3600, service: int = 1) -> str:
    """The rounds of the search written out, each from what the round before improved."""
    parts = [f'marked1 AS MATERIALIZED (SELECT stop_id AS solve, stop_id, cast({WHEN} AS bigint) AS "at" FROM v_stops)', "best1 AS MATERIALIZED (SELECT * FROM marked1)"]
    for n in range(1, rounds + 1):
        parts += [
            f"""board{n} AS MATERIALIZED (SELECT solve, trip_id, board_seq FROM (SELECT m.solve, st.trip_id, st.stop_sequence AS board_seq,
            row_number() OVER (PARTITION BY m.solve, st.stop_id, t.route_id, t.direction_id, t.trip_headsign ORDER BY st.dep, st.trip_id, st.stop_sequence) AS n
            FROM marked{n} AS m JOIN v_stop_times st ON st.stop_id = m.stop_id JOIN v_trips t ON st.trip_id = t.trip_id
            WHERE t.service_id = {service} AND st.dep >= m."at" - {midnight}) AS x WHERE n = 1)""",
            f"""ride{n} AS MATERIALIZED (SELECT r.solve, r.stop_id, r."at" FROM (SELECT b.solve, d.stop_id, min({midnight} + d.arr) AS "at" FROM board{n} AS b
            JOIN v_stop_times d ON d.trip_id = b.trip_id AND d.stop_sequence > b.board_seq GROUP BY b.solve, d.stop_id) AS r
            LEFT JOIN best{n} AS k ON k.solve = r.solve AND k.stop_id = r.stop_id WHERE r."at" <= {horizon} AND (k."at" IS NULL OR r."at" < k."at"))""",
            f'seen{n} AS MATERIALIZED (SELECT solve, stop_id, min("at") AS "at" FROM (SELECT * FROM ride{n} UNION ALL SELECT * FROM best{n}) AS x GROUP BY solve, stop_id)',
            f"""walk{n} AS MATERIALIZED (SELECT w.solve, w.stop_id, w."at" FROM (SELECT r.solve, f.to_stop_id AS stop_id, min(r."at" + f.min_walk_seconds) AS "at" FROM ride{n} AS r
            JOIN v_transfers f ON f.from_stop_id = r.stop_id WHERE f.type <> 'pathway' GROUP BY r.solve, f.to_stop_id) AS w
            LEFT JOIN seen{n} AS k ON k.solve = w.solve AND k.stop_id = w.stop_id WHERE w."at" <= {horizon} AND (k."at" IS NULL OR w."at" < k."at"))""",
            f'marked{n + 1} AS MATERIALIZED (SELECT solve, stop_id, min("at") AS "at" FROM (SELECT * FROM ride{n} UNION ALL SELECT * FROM walk{n}) AS x GROUP BY solve, stop_id)',
            f'best{n + 1} AS MATERIALIZED (SELECT solve, stop_id, min("at") AS "at" FROM (SELECT * FROM best{n} UNION ALL SELECT * FROM marked{n + 1}) AS x GROUP BY solve, stop_id)',
        ]
    return ", ".join(parts) + f' SELECT solve, stop_id, cast("at" AS bigint) AS "at" FROM best{rounds + 1}'


@query("WITH_ROUNDS SELECT solve, stop_id, at FROM v_stops, v_trips, v_stop_times, v_transfers")
def q11_ladder(t: Timetable, spark, sf_dir):
    """Earliest arrivals from every stop at 08:00, two transfers; the stop is the solve.
    Within the horizon only 2026-07-24 counts, on which service 1 runs."""
    seeds = t.stops.select(F.col("stop_id").alias("solve"), "stop_id", F.lit(WHEN).cast("long").alias("at"))
    labels = routing.ladder(t, seeds, max_transfers=2)
    return labels.groupBy("solve", "stop_id").agg(F.min("at").alias("at"))


ORACLES["q11_ladder"] = ORACLES["q11_ladder"].split(" WITH_ROUNDS")[0].rstrip() + ", " + _ladder_sql()


#: The first and the last stop of every region: the origins of the trip plans.
_ORIGINS = """v_origins AS (SELECT DISTINCT stop AS origin FROM (SELECT n.n_regionkey, min(s.s_suppkey) AS lo, max(s.s_suppkey) AS hi FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY n.n_regionkey) AS x,
    LATERAL (VALUES (x.lo), (x.hi)) AS y(stop))"""


def _plan_sql(late: bool, wanted: int, transfers: int = 2, when: int = WHEN, horizon: int = 6 * 3600) -> str:
    """The same itineraries in plain SQL: rounds of rides and walks whose labels none
    betters, with the legs so far as text, over a span as long as any request can need;
    then one pick after another by recursion."""
    first, last, until = (when - horizon - 1200, when, when) if late else (when, when + 2 * horizon, 1 << 40)
    days = [x for x in _days_sql().split("VALUES ")[1].split(") AS t(")[0].replace("), (", ")|(").split("|")][:4]
    parts = [_ORIGINS, f"days AS (SELECT * FROM (VALUES {', '.join(days)}) AS t(service_id, midnight))",
             "calls AS MATERIALIZED (SELECT st.stop_id, st.trip_id, st.stop_sequence AS seq, st.dep, t.route_id, t.direction_id, t.trip_headsign, t.service_id FROM v_stop_times st JOIN v_trips t ON t.trip_id = st.trip_id)",
             "ways AS MATERIALIZED (SELECT * FROM v_transfers WHERE type <> 'pathway')", "downs AS MATERIALIZED (SELECT * FROM v_stop_times)"]
    known = []

    def kept(rows: str, name: str, new: str = "true", ties: str = "1") -> str:
        return f"""{name} AS MATERIALIZED (SELECT * EXCLUDE (earlier) FROM (SELECT *, min(till) OVER (PARTITION BY solve, stop_id ORDER BY start DESC, till, {ties} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
            FROM {rows}) AS x WHERE (earlier IS NULL OR till < earlier) AND {new})"""

    def old(*names: str) -> str:
        return "".join(f" UNION ALL BY NAME SELECT solve, stop_id, start, till, 0 AS new FROM {x}" for x in names)

    for n in range(1, transfers + 2):
        if n == 1:
            parts.append(f"""board1 AS MATERIALIZED (SELECT o.origin AS solve, c.stop_id AS board_stop, d.midnight + c.dep AS start, c.trip_id, c.seq AS board_seq, d.midnight, d.midnight + c.dep AS board_at, c.route_id, '' AS path,
                '' AS kind, d.midnight + c.dep AS first_board FROM v_origins AS o JOIN calls AS c ON c.stop_id = o.origin JOIN days AS d ON d.service_id = c.service_id WHERE d.midnight + c.dep BETWEEN {first} AND {last})""")
        else:
            parts += [
                f"""take{n} AS MATERIALIZED (SELECT solve, midnight, stop_id AS board_stop, trip_id, seq AS board_seq, dep, route_id, max(start) AS start FROM (SELECT l.solve, l.stop_id, l.start, d.midnight, c.trip_id, c.seq, c.dep, c.route_id,
                row_number() OVER (PARTITION BY l.solve, l.stop_id, l.start, d.midnight, c.route_id, c.direction_id, c.trip_headsign ORDER BY c.dep, c.trip_id, c.seq) AS k
                FROM label{n - 1} AS l JOIN calls AS c ON c.stop_id = l.stop_id JOIN days AS d ON d.service_id = c.service_id WHERE d.midnight + c.dep >= l.till AND d.midnight + c.dep <= l.start + {horizon}) AS x WHERE k = 1
                GROUP BY solve, midnight, stop_id, trip_id, seq, dep, route_id)""",
                f"""board{n} AS MATERIALIZED (SELECT b.solve, b.board_stop, b.start, b.trip_id, b.board_seq, b.midnight, b.midnight + b.dep AS board_at, b.route_id, l.path, l.kind, l.first_board
                FROM take{n} AS b JOIN label{n - 1} AS l ON l.solve = b.solve AND l.stop_id = b.board_stop AND l.start = b.start)""",
            ]
        parts += [
            f"""rode{n} AS MATERIALIZED (SELECT solve, stop_id, start, b.* FROM (SELECT b.solve, d.stop_id, b.start, min(struct_pack(till := b.midnight + d.arr, trip_id := b.trip_id, board_stop := b.board_stop, board_seq := b.board_seq, seq := d.stop_sequence,
            board_at := b.board_at, path := b.path || '|' || b.trip_id || ':' || b.board_stop || '@' || b.board_at || '>' || d.stop_id || '@' || (b.midnight + d.arr), kind := b.kind || '>' || b.route_id, first_board := b.first_board)) AS b
            FROM board{n} AS b JOIN downs AS d ON d.trip_id = b.trip_id AND d.stop_sequence > b.board_seq
            WHERE b.midnight + d.arr <= b.start + {horizon} AND b.midnight + d.arr <= {until} AND d.stop_id <> b.solve GROUP BY b.solve, d.stop_id, b.start) AS x)""",
            kept(f"(SELECT *, 1 AS new FROM rode{n}{old(*known)})", f"ride{n}", "new = 1", "new"),
            f"""foot{n} AS MATERIALIZED (SELECT solve, stop_id, start, b.* FROM (SELECT r.solve, w.to_stop_id AS stop_id, r.start, min(struct_pack(till := r.till + w.min_walk_seconds, walk := w.min_walk_seconds, trip_id := r.trip_id, board_stop := r.board_stop,
            board_seq := r.board_seq, seq := r.seq, board_at := r.board_at, path := r.path || '|walk:' || r.stop_id || '>' || w.to_stop_id || ':' || w.min_walk_seconds, kind := r.kind, first_board := r.first_board)) AS b
            FROM ride{n} AS r JOIN ways AS w ON w.from_stop_id = r.stop_id WHERE r.till + w.min_walk_seconds <= r.start + {horizon} AND r.till + w.min_walk_seconds <= {until} AND w.to_stop_id <> r.solve GROUP BY r.solve, w.to_stop_id, r.start) AS x)""",
            kept(f"(SELECT *, 1 AS new FROM foot{n}{old(*known, f'ride{n}')})", f"walk{n}", "new = 1", "new"),
            kept(f"(SELECT solve, stop_id, start, till, path, kind, first_board, 0 AS w FROM ride{n} UNION ALL SELECT solve, stop_id, start, till, path, kind, first_board, 1 FROM walk{n})", f"label{n}", ties="w"),
        ]
        known.append(f"label{n}")
    every = " UNION ALL ".join(f"SELECT *, {n} AS round FROM label{n}" for n in range(1, transfers + 2))
    parts += [
        f"(SELECT solve, stop_id, start, b.* FROM (SELECT solve, stop_id, start, min(struct_pack(till := till, round := round, path := path, kind := kind, first_board := first_board)) AS b FROM ({every}) AS e GROUP BY solve, stop_id, start) AS x)",
    ]
    parts[-1] = kept(parts[-1], "found")
    begin = f"""(SELECT solve, stop_id, {when} - (till - start) - 1200 AS since, start AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY solve, stop_id ORDER BY start) AS k FROM found WHERE start >= {when - horizon}) AS x WHERE k = 1)""" if late else f"(SELECT DISTINCT solve, stop_id, cast({when} AS BIGINT) AS since, cast(NULL AS BIGINT) AS anchor FROM found)"
    tries, stop = (4 * wanted + 8, "false") if late else (2 * wanted + 2, f"(CASE WHEN list_contains(p.kinds, f.kind) THEN p.repeats + 1 ELSE 0 END) >= 2 OR len(list_distinct(list_append(p.kinds, f.kind))) >= {wanted}")
    parts += [
        f"""pick AS (SELECT solve, stop_id, since - 1 AS board, 0 AS tries, 0 AS repeats, cast([] AS VARCHAR[]) AS kinds, cast([] AS BIGINT[]) AS picks, false AS done, anchor FROM {begin} AS s
        UNION ALL SELECT p.solve, p.stop_id, f.first_board, p.tries + 1, CASE WHEN list_contains(p.kinds, f.kind) THEN p.repeats + 1 ELSE 0 END, list_append(p.kinds, f.kind), list_append(p.picks, f.start),
        p.tries + 1 >= {tries} OR {stop}, p.anchor FROM pick AS p JOIN found AS f ON f.solve = p.solve AND f.stop_id = p.stop_id AND f.start > p.board
        WHERE NOT p.done AND f.till <= p.board + 1 + {horizon} AND NOT EXISTS (SELECT 1 FROM found AS g WHERE g.solve = f.solve AND g.stop_id = f.stop_id AND g.start > p.board AND g.start < f.start))""",
        "final AS (SELECT *, row_number() OVER (PARTITION BY solve, stop_id ORDER BY tries DESC) AS k FROM pick)",
        "chosen AS (SELECT f.* FROM final AS p JOIN found AS f ON f.solve = p.solve AND f.stop_id = p.stop_id AND (list_contains(p.picks, f.start) OR len(p.picks) = 0 AND f.start = p.anchor) WHERE p.k = 1)",
        f"one AS (SELECT *, row_number() OVER (PARTITION BY solve, stop_id, kind ORDER BY {'start DESC' if late else 'start'}) AS n FROM chosen)",
        f"told AS (SELECT *, row_number() OVER (PARTITION BY solve, stop_id ORDER BY {'start DESC' if late else 'till'}, till - start, start) AS k FROM one WHERE n = 1)",
    ]
    return ", ".join(parts) + f""" SELECT solve AS origin, stop_id AS stop, cast(k AS INT) AS k, cast(start AS BIGINT) AS depart, cast(till AS BIGINT) AS arrive, cast(len(string_split(kind, '>')) - 2 AS INT) AS transfers, path[2:] AS legs
        FROM told WHERE k <= {wanted}"""


def _plans(t: Timetable, spark, sf_dir, late: bool, wanted: int):
    """From each origin to every other stop, one search an origin."""
    regions = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey")
    ends = regions.agg(F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))
    origins = ends.select(F.explode(F.array(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("solve")).distinct()
    pairs = origins.join(t.stops.select("stop_id"), F.col("solve") != F.col("stop_id"))  # ten origins at most
    asked = pairs.select(F.xxhash64("solve", "stop_id").alias("request"), "solve", "stop_id", F.lit(WHEN).cast("long").alias("when"), F.lit(late).alias("arrive_by"), F.lit(wanted).alias("wanted"))
    found = itineraries.plan_trips(t, asked, origins.select("solve", F.col("solve").alias("stop_id"), F.lit(0).alias("walk")), asked.select("request", "stop_id", F.lit(0).alias("walk")), max_transfers=2)

    def text(leg):
        ride = F.concat_ws("", leg["trip_id"].cast("string"), F.lit(":"), leg["from_stop"], F.lit("@"), leg["depart"], F.lit(">"), leg["to_stop"], F.lit("@"), leg["arrive"])
        return F.when(leg["type"] == "transit", ride).otherwise(F.concat_ws("", F.lit("walk:"), leg["from_stop"], F.lit(">"), leg["to_stop"], F.lit(":"), leg["duration_seconds"]))

    named = found.join(asked.select("request", F.col("solve").alias("origin"), F.col("stop_id").alias("stop")), "request")
    return named.select("origin", "stop", F.col("k").cast("int").alias("k"), "depart", "arrive", "transfers", F.array_join(F.transform("legs", text), "|").alias("legs"))


@query("WITH_PLAN SELECT FROM v_stops, v_trips, v_stop_times, v_transfers")
def q11_plan_trip(t: Timetable, spark, sf_dir):
    """Two itineraries after 08:00 from ten origins to every stop."""
    return _plans(t, spark, sf_dir, False, 2)


@query("WITH_PLAN SELECT FROM v_stops, v_trips, v_stop_times, v_transfers")
def q11_arrive_by(t: Timetable, spark, sf_dir):
    """The two last ways to be at every stop by 08:00 from ten origins."""
    return _plans(t, spark, sf_dir, True, 2)


for _name, _late in (("q11_plan_trip", False), ("q11_arrive_by", True)):
    ORACLES[_name] = (ORACLES[_name].split(" WITH_PLAN")[0].rstrip() + ", " + _plan_sql(_late, 2)).replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT cast(count(*) AS bigint) AS n FROM v_trips")
def a4_count_trips(t: Timetable, spark, sf_dir):
    return catalog.count_trips(t)


@query("SELECT DISTINCT t.trip_id FROM events e JOIN v_trips t ON t.trip_id = e.event_id")
def j23_trips_existing(t: Timetable, spark, sf_dir):
    return catalog.trips_existing(t, _read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("trip_id")))


@query(f"""SELECT DISTINCT b.stop_id, b.route_id, b.trip_id, b.dep, r.route_short_name FROM ({_BOARD.replace("WHERE t.service_id", "JOIN v_routes q ON q.route_id = t.route_id WHERE q.route_type = 1 AND t.service_id")}) AS b
    JOIN v_routes r ON r.route_id = b.route_id""")
def j3_boardings_by_mode(t: Timetable, spark, sf_dir):
    """Boardings on subways alone (J3), with the routes' short names (J19)."""
    rows = _boarded(t, spark, ["subway"])
    return rows.join(t.routes.select("route_id", "route_short_name"), "route_id").select("stop_id", "route_id", "trip_id", "dep", "route_short_name")


@query(f"""SELECT st.stop_id, st.trip_id, st.dep, r.route_short_name FROM {_DEPARTURES} WHERE r.route_id = 3""")
def p7_departures_of_route(t: Timetable, spark, sf_dir):
    return schedule.departures(t, route_id=3).select("stop_id", "trip_id", "dep", "route_short_name")


@query("""SELECT event_id, cast(CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 30) * 3600 + (event_id % 60) * 60 + event_id % 60 END AS int) AS seconds FROM events""")
def f3_clock_seconds(t: Timetable, spark, sf_dir):
    """Hours past 24; two parts, letters and nulls are null."""
    events, n = _read(spark, sf_dir, "events"), F.col("event_id")
    text = F.format_string("%d:%02d:%02d", n % 30, n % 60, n % 60)
    broken = F.when(n % 15 == 0, F.lit(None)).when(n % 15 == 5, "12:30").otherwise("12:3x:00")
    return events.select("event_id", S.clock_seconds(F.when(n % 5 == 0, broken).otherwise(text)).alias("seconds"))


@query("""SELECT event_id, strftime(to_timestamp(s) AT TIME ZONE 'America/Toronto', '%Y-%m-%dT%H:%M:%S') || CASE WHEN o < 0 THEN '-' ELSE '+' END
    || lpad(cast(abs(o) // 3600 AS varchar), 2, '0') || ':' || lpad(cast(abs(o) // 60 % 60 AS varchar), 2, '0') AS local
    FROM (SELECT event_id, s, cast(epoch(to_timestamp(s) AT TIME ZONE 'America/Toronto') AS bigint) - s AS o
    FROM (SELECT event_id, cast(1700000000 + event_id * 3607 AS bigint) AS s FROM events) AS a) AS b""")
def f20_local_time(t: Timetable, spark, sf_dir):
    """Instants over years, so with both offsets."""
    return _read(spark, sf_dir, "events").select("event_id", S.iso_local(F.lit(1700000000) + F.col("event_id") * 3607).alias("local"))


#: Pathways along every fifth stop and its two neighbours, both ways or one, through a node that is no stop.
_PATHWAYS = """SELECT cast(stop_id AS varchar(20)) AS pathway_id, stop_id AS from_stop_id, cast(1000000 + stop_id AS bigint) AS to_stop_id, cast(1 AS int) AS pathway_mode, cast(1 AS int) AS is_bidirectional,
    cast(10 + stop_id % 7 AS int) AS traversal_time, cast(NULL AS double) AS length FROM v_stops WHERE stop_id % 5 = 1
    UNION ALL SELECT cast(-stop_id AS varchar(20)), cast(1000000 + stop_id AS bigint), stop_id + 1, cast(2 AS int), cast(CASE WHEN stop_id % 2 = 0 THEN 1 ELSE 0 END AS int), cast(20 + stop_id % 3 AS int), cast(NULL AS double) FROM v_stops WHERE stop_id % 5 = 1"""


@query("""SELECT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id, cast(10 + a.stop_id % 7 + 20 + a.stop_id % 3 AS int) AS min_walk_seconds, 'pathway' AS type FROM v_stops a JOIN v_stops b ON b.stop_id = a.stop_id + 1 WHERE a.stop_id % 5 = 1
    UNION ALL SELECT b.stop_id, a.stop_id, cast(10 + a.stop_id % 7 + 20 + a.stop_id % 3 AS int), 'pathway' FROM v_stops a JOIN v_stops b ON b.stop_id = a.stop_id + 1 WHERE a.stop_id % 5 = 1 AND a.stop_id % 2 = 0""")
def b4_pathway_transfers(t: Timetable, spark, sf_dir):
    ways = spark.sql(_PATHWAYS.replace("v_stops", "{stops}"), stops=t.stops)
    return transfers.pathway_transfers(t.stops, ways)


_CATEGORY = """CASE WHEN lower(text) LIKE '%elevator%' THEN 'elevator' WHEN lower(text) LIKE '%escalator%' THEN 'escalator' WHEN lower(text) LIKE '%planned%' THEN 'planned'
    WHEN lower(text) LIKE '%no service%' THEN 'no_service' WHEN lower(text) LIKE '%detour%' OR lower(text) LIKE '%bypass%' OR lower(text) LIKE '%not stopping%' THEN 'detour'
    WHEN lower(text) LIKE '%delay%' THEN 'delay' WHEN effect IN (1) THEN 'no_service' WHEN effect IN (4, 6, 9) THEN 'detour' WHEN effect IN (2, 3) THEN 'delay'
    WHEN effect = 11 THEN 'elevator' WHEN effect IN (5, 10) THEN 'planned' ELSE 'other' END"""
_WORDS = ("elevator out", "planned work", "no service", "bypass", "delays", "the")


@query(f"""SELECT id, {_CATEGORY} AS category FROM (SELECT doc_id AS id, cast(doc_id % 13 AS int) AS effect, CASE cast(doc_id % 8 AS int) WHEN 0 THEN '{_WORDS[0]}' WHEN 1 THEN '{_WORDS[1]}'
    WHEN 2 THEN '{_WORDS[2]}' WHEN 3 THEN '{_WORDS[3]}' WHEN 4 THEN '{_WORDS[4]}' ELSE '{_WORDS[5]}' END || ' ' || text AS text FROM documents) AS x""")
def q8_alert_categories(t: Timetable, spark, sf_dir):
    from ..schemas import EFFECTS

    docs = _read(spark, sf_dir, "documents")
    head = F.coalesce(F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("doc_id") % 8).cast("int")), F.lit(_WORDS[5]))
    return docs.select(F.col("doc_id").alias("id"), S.alert_category(S.name_of(F.col("doc_id") % 13, EFFECTS), head, F.col("text")).alias("category"))


_EVENTS = 'SELECT event_id, cast(event_id AS varchar(20)) AS trip, user_id % 120 + 1 AS stop, cast(floor(epoch(ts)) AS bigint) AS "at" FROM events'


@query(f"""SELECT asked, route, headsign, "at" FROM (SELECT e.stop AS asked, coalesce(t.route_id, 3) AS route, coalesce(t.trip_headsign, '') AS headsign, e."at",
    row_number() OVER (PARTITION BY e.stop ORDER BY e."at", e.trip) AS k FROM ({_EVENTS}) AS e JOIN v_stops s ON s.stop_id = e.stop LEFT JOIN v_trips t ON t.trip_id = e.event_id
    WHERE e."at" >= 1704412800) AS x WHERE k <= 4""")
def q7_predicted_arrivals(t: Timetable, spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    stop = F.struct((F.col("user_id") % 120 + 50001).cast("string").alias("stop_id"), at.alias("arrival"), F.lit(None).cast("long").alias("departure"))
    updates = events.select(F.col("event_id").cast("string").alias("trip_id"), F.lit("3").alias("route_id"), F.array(stop).alias("stops"))
    asked = t.stops.select(F.col("stop_id").alias("asked"), "stop_id")
    return realtime.predicted_arrivals(t, updates, asked, now=1704412800, limit=4).select("asked", "route", "headsign", "at")


_PLACE = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(43.7 AS double) END"


@query(f"""SELECT vehicle_id, route_id, lat, bearing, trip_id, occupancy_status, seconds, position, total > 50 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY position DESC) AS n, count(*) OVER () AS total
    FROM (SELECT cast(event_id AS varchar(20)) AS vehicle_id, event_type AS route_id, {_PLACE} AS lat, cast(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 360 END AS double) AS bearing,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(event_id AS varchar(20)) END AS trip_id, CASE event_id % 11 WHEN 0 THEN 'empty' WHEN 5 THEN 'full' ELSE NULL END AS occupancy_status,
    strftime(to_timestamp(1700000000) AT TIME ZONE 'America/Toronto', '%H:%M:%S') AS seconds, -event_id AS position FROM events WHERE event_type = 'click' AND event_id % 9 <> 0 AND event_id % 10 <> 0) AS x) AS y WHERE n > total - 50""")
def q9_vehicles_for_route(t: Timetable, spark, sf_dir):
    """The feed lists the greatest id first; ids, places, trips and times may be missing."""
    n = F.col("event_id")
    feed = _read(spark, sf_dir, "events").select(
        F.when(n % 10 != 0, n.cast("string")).alias("vehicle_id"), F.col("event_type").alias("route_id"), F.when(n % 3 == 0, "").otherwise(n.cast("string")).alias("trip_id"),
        F.when(n % 9 != 0, F.lit(43.7)).alias("lat"), F.lit(-79.4).alias("lon"), F.when(n % 4 != 0, n % 360).cast("double").alias("bearing"),
        F.when((n % 11 == 0) | (n % 11 == 5), n % 11).otherwise(99).cast("int").alias("occupancy"), F.when(n % 2 == 0, F.lit(1700000000)).cast("long").alias("timestamp"), (-n).alias("position"),
    )
    out = realtime.vehicles_for_route(feed, "click", now=1700000000)
    return out.select("vehicle_id", "route_id", "lat", "bearing", "trip_id", "occupancy_status", F.substring("timestamp", 12, 8).alias("seconds"), "position", "truncated")


_ALERT_FEED = f"""SELECT id, position, {_CATEGORY} AS category, header, description, severity, cause, effect_name, url, route, stop, own FROM (SELECT cast(doc_id AS varchar(20)) AS id, doc_id AS position, cast(doc_id % 13 AS int) AS effect,
    CASE cast(doc_id % 8 AS int) WHEN 0 THEN '{_WORDS[0]}' WHEN 1 THEN '{_WORDS[1]}' WHEN 2 THEN '{_WORDS[2]}' WHEN 3 THEN '{_WORDS[3]}' WHEN 4 THEN '{_WORDS[4]}' ELSE '' END AS header,
    CASE WHEN doc_id % 4 = 3 THEN NULL ELSE text END AS description, CASE cast(doc_id % 5 AS int) WHEN 1 THEN 'unknown_severity' WHEN 2 THEN 'info' WHEN 3 THEN 'warning' WHEN 4 THEN 'severe' END AS severity,
    CASE cast(doc_id % 3 AS int) WHEN 1 THEN 'unknown_cause' WHEN 2 THEN 'other_cause' END AS cause,
    CASE cast(doc_id % 13 AS int) WHEN 1 THEN 'no_service' WHEN 2 THEN 'reduced_service' WHEN 3 THEN 'significant_delays' WHEN 4 THEN 'detour' WHEN 5 THEN 'additional_service' WHEN 6 THEN 'modified_service' WHEN 7 THEN 'other_effect'
    WHEN 8 THEN 'unknown_effect' WHEN 9 THEN 'stop_moved' WHEN 10 THEN 'no_effect' WHEN 11 THEN 'accessibility_issue' END AS effect_name,
    CASE WHEN doc_id % 2 = 0 THEN 'https://x/' || cast(doc_id AS varchar(20)) END AS url, CASE WHEN doc_id % 3 <> 0 THEN cast(doc_id % 30 AS varchar(20)) END AS route, CASE WHEN doc_id % 5 <> 0 THEN cast(doc_id % 130 AS varchar(20)) END AS stop,
    CASE cast(doc_id % 6 AS int) WHEN 0 THEN 'streetcar' WHEN 1 THEN 'subway' WHEN 3 THEN 'bus' END AS own,
    coalesce(CASE cast(doc_id % 8 AS int) WHEN 0 THEN '{_WORDS[0]}' WHEN 1 THEN '{_WORDS[1]}' WHEN 2 THEN '{_WORDS[2]}' WHEN 3 THEN '{_WORDS[3]}' WHEN 4 THEN '{_WORDS[4]}' END, '') || ' ' || coalesce(CASE WHEN doc_id % 4 = 3 THEN NULL ELSE text END, '') AS text FROM documents) AS x"""
_ALERTS = f"""SELECT f.id, f.position, f.category, f.header, f.description, f.severity, f.cause, f.effect_name AS effect, f.url, coalesce(f.route, '') AS routes, coalesce(f.stop, '') AS stops,
    array_to_string(list_sort(list_distinct([f.own, r.mode, m.mode])), ',') AS modes FROM ({_ALERT_FEED}) AS f
    LEFT JOIN (SELECT cast(route_id AS varchar(20)) AS route, {_MODE} AS mode FROM v_routes) AS r ON r.route = f.route
    LEFT JOIN v_modes m ON cast(m.stop_id AS varchar(20)) = f.stop"""


def _alerts(t, spark, sf_dir):
    n = F.col("doc_id")
    head = F.get(F.array(*[F.lit(w) for w in _WORDS[:5]]), (n % 8).cast("int"))
    told = lambda text: F.when(text.isNotNull(), F.array(F.struct(text.alias("text"), F.lit("en").alias("language"))))
    informed = F.array(
        F.struct(F.when(n % 3 != 0, (n % 30).cast("string")).otherwise("").alias("route_id"), F.lit(None).cast("string").alias("stop_id"), F.lit(None).cast("int").alias("route_type")),
        F.struct(F.lit(None).cast("string").alias("route_id"), F.when(n % 5 != 0, (n % 130).cast("string")).alias("stop_id"), (n % 6).cast("int").alias("route_type")),
    )
    feed = _read(spark, sf_dir, "documents").select(
        n.cast("string").alias("id"), told(head).alias("header"), told(F.when(n % 4 != 3, F.col("text"))).alias("description"), told(F.when(n % 2 == 0, F.concat(F.lit("https://x/"), n.cast("string")))).alias("url"),
        (n % 3).cast("int").alias("cause"), (n % 13).cast("int").alias("effect"), (n % 5).cast("int").alias("severity"), informed.alias("informed"),
        F.lit(None).cast("array<struct<start: long, end: long>>").alias("active"), n.alias("position"),
    )
    return realtime.alerts(t, feed)


def _joined(found):
    return found.select(
        "id", "position", "category", "header", "description", "severity", "cause", "effect", "url",
        *[F.array_join(c, ",").alias(c) for c in ("routes", "stops", "modes")], *[c for c in found.columns if c == "truncated"],
    )


@query(f"SELECT * FROM ({_ALERTS}) AS a")
def q8_alerts(t: Timetable, spark, sf_dir):
    """Every alert of a feed made of the documents, all columns."""
    return _joined(_alerts(t, spark, sf_dir))


@query(f"""SELECT * EXCLUDE (total) FROM (SELECT *, total > 20 AS truncated FROM (SELECT *, count(*) OVER () AS total FROM ({_ALERTS}) AS a WHERE list_contains(string_split(modes, ','), 'bus') AND category = 'detour') AS b
    ORDER BY position LIMIT 20) AS c""")
def p11_matching_alerts(t: Timetable, spark, sf_dir):
    """The first twenty detours that concern buses, in the feed's order."""
    return _joined(realtime.matching_alerts(_alerts(t, spark, sf_dir), mode="bus", category="detour", limit=20))


_UPDATES = """SELECT event_id AS position, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'x' || cast(user_id AS varchar(20)) ELSE cast(event_id AS varchar(20)) END AS raw,
    CASE WHEN event_id % 13 <> 0 AND event_id % 7 <> 0 THEN event_id END AS number, event_id % 5 <> 0 AS has_route FROM events"""


@query(f"""WITH_UPDATES SELECT (SELECT cast(count(*) AS bigint) FROM v_trips) AS static_trip_count, *,
    floor(matched_trip_ids * 1000 / cast(distinct_rt_trip_ids AS double) + 0.5) / 10 AS overlap_pct, unmatched_updates - unmatched_updates_recovered AS unmatched_updates_unrecoverable
    FROM (SELECT cast(count(*) AS bigint) AS rt_trip_updates, cast(sum(CASE WHEN trip_id IS NULL THEN 1 ELSE 0 END) AS bigint) AS unmatched_updates,
    cast(sum(CASE WHEN trip_id IS NULL AND has_route THEN 1 ELSE 0 END) AS bigint) AS unmatched_updates_recovered, cast(count(DISTINCT CASE WHEN raw <> '' THEN raw END) AS bigint) AS distinct_rt_trip_ids,
    cast(count(DISTINCT number) AS bigint) AS numeric_trip_ids, cast(sum(CASE WHEN raw <> '' AND number IS NULL THEN 1 ELSE 0 END) AS bigint) AS non_numeric_trip_ids,
    cast(count(DISTINCT trip_id) AS bigint) AS matched_trip_ids, cast(count(DISTINCT CASE WHEN raw <> '' THEN raw END) - count(DISTINCT trip_id) AS bigint) AS unmatched_trip_ids FROM v_updates) AS counts,
    (SELECT array_to_string(list(raw ORDER BY position), ',') AS sample_unmatched_trip_ids FROM (SELECT raw, CASE WHEN number IS NULL THEN 1000000000000 ELSE 0 END + min(position) AS position FROM v_updates WHERE raw <> '' AND trip_id IS NULL GROUP BY raw, number IS NULL ORDER BY 2 LIMIT 10) AS a) AS s,
    (SELECT array_to_string(list(raw ORDER BY position), ',') AS sample_non_numeric_trip_ids FROM (SELECT raw, position FROM v_updates WHERE raw <> '' AND number IS NULL ORDER BY position LIMIT 10) AS a) AS u""")
def q17_join_report(t: Timetable, spark, sf_dir):
    """All thirteen numbers, over updates of which some have no id, no number or no route."""
    n = F.col("event_id")
    raw = F.when(n % 13 == 0, "").when(n % 7 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string"))).otherwise(n.cast("string"))
    updates = _read(spark, sf_dir, "events").select(raw.alias("trip_id"), F.when(n % 5 != 0, "900").otherwise(" ").alias("route_id"), n.alias("position"))
    out = realtime.join_report(t, updates)
    return out.withColumns({c: F.array_join(c, ",") for c in out.columns if c.startswith("sample")})


ORACLES["q17_join_report"] = ORACLES["q17_join_report"].replace(") WITH_UPDATES SELECT", f"), v_updates AS (SELECT u.*, t.trip_id FROM ({_UPDATES}) AS u LEFT JOIN v_trips t ON t.trip_id = u.number) SELECT", 1)


#: The fare category of a customer's market segment.
_CATEGORIES = {"AUTOMOBILE": "adult", "BUILDING": "adult", "FURNITURE": "senior", "HOUSEHOLD": "youth", "MACHINERY": "child"}


@query(f"""SELECT c.c_custkey, f.category, f.fare_type, f.price, f.currency FROM customer c JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _CATEGORIES.items())}) AS s(segment, category) ON s.segment = c.c_mktsegment
    JOIN (VALUES {", ".join(f"('{a}', '{b}', cast({p} AS double), '{c}')" for a, b, p, c in FARES)}) AS f(category, fare_type, price, currency) ON f.category = s.category""")
def q10_fares(t: Timetable, spark, sf_dir):
    """The fares open to every customer, by the category of their segment."""
    category = F.create_map(*[F.lit(x) for pair in _CATEGORIES.items() for x in pair])[F.col("c_mktsegment")]
    asked = _read(spark, sf_dir, "customer").select("c_custkey", category.alias("category"))
    return realtime.fares_of(spark, asked).select("c_custkey", "category", "fare_type", "price", "currency")


@query("SELECT s.stop_id, m.mode FROM v_stops s JOIN v_modes m ON s.stop_id = m.stop_id")
def q14_stop_modes(t: Timetable, spark, sf_dir):
    return catalog.stop_modes(t).join(t.stops, "stop_id", "left_semi")


@query("SELECT p.stop_id AS parent_id, c.stop_id AS child_id FROM v_stops c JOIN v_stops p ON c.parent_station = p.stop_id")
def j12_platforms(t: Timetable, spark, sf_dir):
    c = t.stops.where("parent_station is not null").select(F.col("stop_id").alias("child_id"), F.col("parent_station").alias("parent_id"))
    return c.join(t.stops.select(F.col("stop_id").alias("parent_id")), "parent_id", "left_semi").select("parent_id", "child_id")
