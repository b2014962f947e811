"""The fixtures' goldens: scalars, catalog, schedule, transfers, overlay, routing, realtime."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.api import Engine, QueryError
from tramline.functions import scalars as S
from tramline.operators import catalog, realtime, routing, schedule, transfers
from tramline.schemas import EFFECTS, TABLES
from tramline.sources import gtfs
from tramline.sources import realtime as rt
from tramline.timetable import Timetable, check_keys

DAILY = (1, 1, 1, 1, 1, 1, 1)


def at(text):
    return int(dt.datetime.fromisoformat(text).timestamp())


def clock(text):
    h, m = text.split(":")
    return int(h) * 3600 + int(m) * 60


@pytest.fixture(scope="module")
def city(spark):
    stops = [
        (9000, None, "Union Station", 43.645286, -79.380875, None, 1), (9001, None, "Union Station - Platform 1", 43.6453, -79.3809, 9000, 0),
        (9002, None, "Union Station - Front St Entrance", 43.6451, -79.3807, None, 2), (662, 662, "Danforth Rd at Kennedy Rd", 43.714379, -79.260939, None, None),
        (663, 663, "Kennedy Station Bus Bay", 43.73231, -79.26484, None, None),
    ]
    times = [(1, 9001, 1, 21600, 21600), (2, 662, 1, 22200, 22200), (2, 663, 2, 22800, 22800), (5, 9001, 1, 90600, 90600)]
    return Timetable.from_rows(
        spark, stops=stops, routes=[(1, "1", "Line 1 (Yonge-University)", 1, "D5C82B"), (900, "900", "Airport Express", 3, "")],
        calendar=[(1, *DAILY, 20260101, 20261231)], calendar_dates=[(1, 20260726, 2), (2, 20260725, 1)],
        trips=[(1, 1, 1, "Finch", 0, None), (2, 900, 1, "Airport", 0, None), (5, 1, 1, "Late", 0, None)], stop_times=times,
        rt_stop_crosswalk=[(50662, 662), (50663, 663)],
    )


@pytest.fixture(scope="module")
def network(spark):
    stops = [
        (101, "Distillery Loop", 43.650, -79.380), (102, "Midtown", 43.655, -79.380), (103, "Junction Interchange", 43.660, -79.380), (201, "Riverside", 43.6601, -79.3799),
        (202, "Eastgate", 43.665, -79.375), (203, "Broadview Station", 43.670, -79.370), (204, "Broadview Junction", 43.665, -79.370), (401, "Alpha Loop", 43.680, -79.400), (402, "Beta Loop", 43.685, -79.400),
    ]
    trips = [(100, 10, "Aend"), (101, 10, "Aend"), (102, 10, "Aend"), (110, 20, "Broadview Station"), (111, 20, "Broadview Junction"), (400, 40, "Beta"), (410, 41, "Beta")]
    runs = {
        100: "101 8:00, 102 8:05, 103 8:10", 101: "101 8:30, 102 8:35, 103 8:40", 102: "101 25:00, 102 25:05, 103 25:10", 110: "201 8:15, 202 8:20, 203 8:30",
        111: "201 8:17, 202 8:22, 204 8:32", 400: "401 10:00, 402 10:10", 410: "401 10:02, 402 10:15",
    }
    times = [(t, int(s), k, clock(c), clock(c)) for t, run in runs.items() for k, (s, c) in enumerate((x.split() for x in run.split(", ")), 1)]
    return Timetable.from_rows(
        spark, stops=[(i, i, n, x, y, None, None) for i, n, x, y in stops], routes=[(r, str(r), str(r), k, "") for r, k in ((10, 1), (20, 3), (40, 3), (41, 3))],
        calendar=[(1, *DAILY, 20260101, 20261231)], trips=[(t, r, 1, h, 0, None) for t, r, h in trips], stop_times=times,
        transfers=[(103, 201, 90, "street"), (201, 103, 90, "street"), (202, 203, 30, "pathway")],
    )


def test_scalars(spark):
    rows = [("12.7",), (" 5 ",), ("",), ("x",), ("Infinity",), ("1d",), ("6:32:00",), ("25:10:05",), ("24:00",)]
    got = spark.createDataFrame(rows, "x string").select("x", S.to_int(F.col("x")).alias("i"), S.clock_seconds(F.col("x")).alias("c")).collect()
    ints = {x["x"]: x["i"] for x in got}
    assert (ints["12.7"], ints[" 5 "], ints[""], ints["x"], ints["Infinity"], ints["1d"]) == (12, 5, None, None, None, None)
    times = {x["x"]: x["c"] for x in got}
    assert (times["6:32:00"], times["25:10:05"], times["24:00"]) == (23520, 90605, None)
    row = spark.range(1).select(S.iso_local(F.lit(at("2026-07-24T10:00:00-04:00"))).alias("a"), S.iso_local(F.lit(at("2026-01-24T10:00:00-05:00"))).alias("b"),
                                S.midnight(F.lit("2026-03-08").cast("date")).alias("c"), S.midnight(F.lit("2026-11-01").cast("date")).alias("d")).first()
    assert row["a"] == "2026-07-24T10:00:00-04:00" and row["b"] == "2026-01-24T10:00:00-05:00"
    assert row["c"] == at("2026-03-08T00:00:00-05:00") and row["d"] == at("2026-11-01T00:00:00-04:00")


def test_catalog(city):
    found = {x["stop_id"]: x for x in catalog.stop_summaries(city).collect()}
    assert set(found) == {662, 663, 9000, 9001} and found[9000]["mode"] == "subway" and found[9000]["is_station"]
    assert [x["stop_id"] for x in catalog.search_near(city, 43.714379, -79.260939, 500).collect()] == [662]
    assert [x["stop_id"] for x in catalog.search_near(city, 43.714379, -79.260939, 5000).orderBy("metres").collect()] == [662, 663]
    assert [x["stop_id"] for x in catalog.search_by_name(city, "union", "subway", 1).collect()] == [9000]
    detail = catalog.stop_detail(city, 9000).first()
    assert detail["platforms"] == [9001] and detail["routes"][0]["color"] == "D5C82B"
    assert catalog.stop_detail(city, 9002).first() is None


def test_schedule(city):
    engine = Engine(city)
    got = engine.next_departures(663, at("2026-07-24T10:00:00-04:00"), limit=1)
    assert got["departures"][0]["scheduled_time"] == "2026-07-25T06:20:00-04:00" and got["truncated"]
    got = engine.next_departures("9000", at("2026-07-24T00:00:00-04:00"))["departures"]
    late = [x for x in got if x["scheduled_time"] == "2026-07-25T01:10:00-04:00"]
    assert late and got[0]["platform_stop_id"] == "9001"
    days = {x["scheduled_time"][:10] for x in engine.next_departures(663, at("2026-07-25T10:00:00-04:00"))["departures"]}
    assert "2026-07-26" not in days and "2026-07-27" in days
    with pytest.raises(QueryError) as e:
        engine.stop("abc")
    assert e.value.code == "invalid_argument"
    with pytest.raises(QueryError) as e:
        engine.stop(1)
    assert e.value.code == "not_found"


def test_service_exceptions(city, spark):
    days = spark.sql("select explode(sequence(date'2026-07-24', date'2026-07-26')) as date")
    got = {(str(x["date"]), x["service_id"]) for x in schedule.active_services(city, days).collect()}
    assert got == {("2026-07-24", 1), ("2026-07-25", 1), ("2026-07-25", 2)}


def test_transfers(spark):
    stops = spark.createDataFrame([(1, 43.7, -79.4, None, None), (2, 43.7005, -79.4, None, None), (3, 43.8, -79.4, None, 0), (4, 43.7, -79.4, None, 1), (5, None, None, 9, 0), (6, None, None, 9, 0)],
                                  "stop_id long, stop_lat double, stop_lon double, parent_station long, location_type int")
    street = {(x[0], x[1]): x[2] for x in transfers.street_transfers(stops).collect()}
    assert set(street) == {(1, 2), (2, 1)} and 40 <= street[(1, 2)] <= 46
    assert {(x[0], x[1], x[2]) for x in transfers.station_transfers(stops).collect()} == {(5, 6, 60), (6, 5, 60)}
    ways = spark.createDataFrame([("a", 1, 77, 1, 1, 30, None), ("b", 77, 78, 1, 1, 45, None), ("c", 78, 2, 1, 1, 30, None), ("d", 5, 6, 1, 0, None, 130.0)], TABLES["pathways"])
    got = {(x[0], x[1]): x[2] for x in transfers.pathway_transfers(stops, ways).collect()}
    assert got == {(1, 2): 105, (2, 1): 105, (5, 6): 100}
    merged = transfers.merge_transfers(transfers.street_transfers(stops), spark.createDataFrame([(1, 2, 90, "pathway"), (2, 1, 60, "station")], transfers.TRANSFER)).collect()
    assert {(x[0], x[1]): x[3] for x in merged} == {(1, 2): "pathway", (2, 1): "station"}


def test_overlay(spark):
    a = spark.createDataFrame([(16073, 16073, "Eglinton EB Platform", 0.0, 0.0, None, None), (3765, 3765, "Islington Ave at Beaumonde", 0.0, 0.0, None, None)], TABLES["stops"])
    b = spark.createDataFrame([(99993, 16999, "E", 0.0, 0.0, None, 1), (16073, 16073, "P", 0.0, 0.0, 99993, 0), (3765, 90001, "Q", 0.0, 0.0, 99993, 0), (7988, 3765, "R", 0.0, 0.0, None, 0)], TABLES["stops"])
    stops, crosswalk = transfers.overlay(a, b)
    assert {(x["stop_id"], x["parent_station"]) for x in stops.collect()} == {(16073, 99993), (3765, None), (99993, None)}
    assert {tuple(x) for x in crosswalk.collect()} == {(7988, 3765), (16073, 16073), (99993, 99993)}


def test_ladder(network, spark):
    start = at("2026-08-04T08:00:00-04:00")
    seeds = spark.createDataFrame([(0, 101, start)], "solve long, stop_id long, at long")

    def best(**options):
        rows = routing.ladder(network, seeds, **options).groupBy("stop_id").agg(F.min("at").alias("at")).collect()
        return {x["stop_id"]: x["at"] - start for x in rows}

    got = best()
    assert (got[103], got[201], got[203]) == (600, 690, 1800)
    assert 203 not in best(max_transfers=0)
    got = best(modes=["subway"])
    assert got[201] == 690 and 203 not in got


def test_queries_of_every_stop(spark):
    import duckdb

    from tramline.plans.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for name in ("nation", "supplier", "orders", "lineitem"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    stops = {x[0] for x in base.sql("SELECT s_suppkey FROM supplier").fetchall()}
    for name in ("j4_boardings", "j5_rides", "j7_footpaths", "a8_earliest_arrivals"):
        rows = sorted(tuple(x) for x in QUERIES[name](spark, folder).collect())
        assert rows == sorted(base.sql(ORACLES[name]).fetchall())
        if name in ("j4_boardings", "j5_rides"):
            assert {x[0] for x in rows} == stops
    assert {x["solve"] for x in QUERIES["q11_ladder"](spark, folder).collect()} == stops


def test_plan(network):
    def plan(a, b, when, **options):
        return routing.plan_trip(network, a, b, dt.datetime.fromisoformat(when), **options)

    one = plan(101, 103, "2026-08-04T08:00:00-04:00", max_itineraries=1)["itineraries"][0]
    assert one["duration_seconds"] == 600 and one["legs"][0]["num_stops"] == 2
    two = plan("Distillery Loop", 203, "2026-08-04T08:00:00-04:00", max_itineraries=1)["itineraries"][0]
    assert [x["type"] for x in two["legs"]] == ["transit", "transfer", "transit"] and two["transfers"] == 1 and two["arrive"] == at("2026-08-04T08:30:00-04:00")
    assert routing.valid_times(two) and not routing.adjacent_walks(two)
    night = plan(101, 103, "2026-08-05T00:10:00-04:00", max_itineraries=1)["itineraries"][0]
    assert night["depart"] == at("2026-08-05T01:00:00-04:00")
    assert plan(203, 101, "2026-08-04T08:00:00-04:00") == {"error": "no_results"}
    assert plan("Broadview", 101, "2026-08-04T08:00:00-04:00")["endpoint"] == "from"
    ways = plan(401, 402, "2026-08-04T10:00:00-04:00", max_itineraries=3)["itineraries"]
    assert [routing.signature(x) for x in ways] == ["40", "41"]
    late = plan(401, 402, "2026-08-04T10:16:00-04:00", arrive_by=True, max_itineraries=2)["itineraries"]
    assert [routing.signature(x) for x in late] == ["41", "40"]
    late = plan(101, 103, "2026-08-04T08:45:00-04:00", arrive_by=True)["itineraries"][0]
    assert late["depart"] == at("2026-08-04T08:30:00-04:00")


def test_arrivals_and_alerts(city, spark):
    now = at("2026-07-24T10:00:00-04:00")
    updates = spark.createDataFrame([("999999", "900", [("50662", now + 60, None), ("50663", now - 5, None), ("1", now + 5, None)]), ("2", None, [("50662", None, now + 30)])], realtime.UPDATES)
    asked = spark.createDataFrame([(662, 662), (663, 663)], "asked long, stop_id long")
    got = realtime.predicted_arrivals(city, updates, asked, now).orderBy("at").collect()
    assert [(x["asked"], x["route"], x["headsign"]) for x in got] == [(662, 900, "Airport"), (662, 900, "")]
    feed = spark.createDataFrame([("a", [("Elevator out", "en")], None, None, 1, 1, None, [("1", None, None), (None, "662", None)], []), ("b", [], None, None, None, 9, 3, [], [])], realtime.ALERTS)
    found = {x["id"]: x for x in realtime.alerts(city, feed).collect()}
    assert found["a"]["category"] == "elevator" and found["a"]["modes"] == ["bus", "subway"] and found["b"]["category"] == "detour"
    assert [x["id"] for x in realtime.matching_alerts(realtime.alerts(city, feed), mode="bus").collect()] == ["a"]
    assert len(realtime.fares(spark, "senior").collect()) == 2 and EFFECTS[9] == "stop_moved"


def _message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3]) + _varint(value)
        else:
            out += bytes([number << 3 | 2]) + _varint(len(value)) + value
    return out


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_feed(spark):
    update = _message((1, _message((1, b"7"), (5, b"900"))), (2, _message((2, _message((2, 1700000000))), (4, b"50662"))))
    feed = _message((1, _message((1, b"2.0"))), (2, _message((1, b"e"), (3, update))))
    assert rt.decode(feed)["trips"] == [("7", "900", [("50662", 1700000000, None)])]
    rt.check_header(feed)
    calls, now = [], [0.0]
    client = rt.FeedClient(spark, "http://x", get=lambda u: calls.append(u) or feed, clock=lambda: now[0])
    assert client.snapshot("trips").count() == 1 and client.snapshot("trips").count() == 1 and len(calls) == 1
    now[0] = 30
    client.snapshot("trips")
    assert len(calls) == 2
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return b"ok"

    assert rt.fetch("u", get=flaky, sleep=lambda s: None) == b"ok"


def test_freshness(tmp_path):
    state = str(tmp_path / "state.json")
    assert rt.check_freshness(state, {"a": "1"}) and not rt.check_freshness(state, {"a": "1"}) and rt.check_freshness(state, {"a": "2"})
    assert rt.resource_stamp(json.dumps({"result": {"metadata_modified": "x"}})) == "x"
    with pytest.raises(ValueError):
        rt.resource_stamp(json.dumps({"success": False}))


def test_ingest(spark, tmp_path):
    first, second = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    files = {
        "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n1,1,1,1,1,1,1,1,20260101,20261231\n",
        "calendar_dates.txt": "service_id,date,exception_type\n1,20260726,2\n", "routes.txt": "﻿route_id,route_short_name,route_long_name,route_type,route_color\n1,1,One,1,\n",
        "stops.txt": "stop_id,stop_code,stop_name,stop_lat,stop_lon\n10,10,A,43.7,-79.4\n11,11,B,43.7005,-79.4\n", "trips.txt": "trip_id,route_id,service_id,trip_headsign,direction_id,shape_id\n5,1,1,,0,\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n5,25:00:00,25:00:30,10,1\n5,,,11,2\n",
    }
    with zipfile.ZipFile(first, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    with zipfile.ZipFile(second, "w") as z:
        z.writestr("levels.txt", "level_id,level_index,level_name\nL,0,Street\n")
        z.writestr("pathways.txt", "pathway_id,from_stop_id,to_stop_id,pathway_mode,is_bidirectional,traversal_time,length\np,10,11,1,0,30,\n")
        z.writestr("stops.txt", "stop_id,stop_code,stop_name,stop_lat,stop_lon,parent_station,location_type\n900,,S,43.7,-79.4,,1\n")
    counts = gtfs.ingest(spark, first, second, str(tmp_path / "out"))
    assert counts["stops"] == 3 and counts["stop_times"] == 2 and counts["transfers"] == 2
    t = Timetable.read(spark, str(tmp_path / "out"))
    assert t.stop_times.where("stop_id = 10").first()["dep"] == 90030 and t.trips.first()["trip_headsign"] == ""
    with pytest.raises(FileNotFoundError):
        gtfs.extract(first, "none.txt", str(tmp_path))
    with pytest.raises(ValueError):
        check_keys("stops", t.stops.unionByName(t.stops))


def test_stream(spark, tmp_path):
    from tramline.streaming.feeds import newest_rows, read_latest

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "vehicle_id string, timestamp long, x int").write.parquet(source)
    stream = spark.readStream.schema("vehicle_id string, timestamp long, x int").parquet(source)
    newest_rows(stream, str(tmp_path / "out"), "vehicle_id", str(tmp_path / "cp")).awaitTermination()
    assert {tuple(x) for x in read_latest(spark, str(tmp_path / "out")).select("vehicle_id", "x").collect()} == {("a", 20), ("b", 5)}


def test_streets_by_place(spark):
    """Stops that share a place, and more of one place than are paired at a time, against
    every pair one by one; no pair comes twice."""
    places = [(43.7, -79.4), (43.7005, -79.4), (43.701, -79.4), (43.7, -79.398)]
    rows = [(k, k, "", *places[0 if k < 300 else k % 4], 1000 + k // 3 if k % 7 else None, 0) for k in range(330)]
    stops = spark.createDataFrame([*rows, (900, 900, "", *places[0], None, 1), (901, 901, "", None, None, None, 0)], TABLES["stops"])
    plain = stops.where("location_type = 0 and stop_lat is not null").select("stop_id", "stop_lat", "stop_lon")
    other = plain.toDF("to", "lat", "lon")
    metres = S.metres_between(F.col("stop_lat"), F.col("stop_lon"), F.col("lat"), F.col("lon"))
    want = sorted(map(tuple, plain.crossJoin(other).where(F.col("stop_id") != F.col("to")).withColumn("m", metres).where("m <= 90").select("stop_id", "to", S.walk_seconds(F.col("m"))).collect()))
    assert sorted((x[0], x[1], x[2]) for x in transfers.street_transfers(stops, 90).collect()) == want
    merged = transfers.merge_transfers(transfers.station_transfers(stops), transfers.street_transfers(stops, 90))
    assert sorted(map(tuple, transfers.merged_walks(stops, 90).collect())) == sorted(map(tuple, merged.collect()))


def test_walks_by_place(spark):
    """The best walk to every stop by places is the best of all pairs, with its origin."""
    rows = [(k, k, "", 43.7 + 0.0005 * (k % 3), -79.4, 1000 + k // 4 if k % 5 else None, 0) for k in range(40)]
    stops = spark.createDataFrame([*rows, (901, 901, "", None, None, 1000, 0)], TABLES["stops"])
    plain = Timetable(*[None] * 6, transfers.merged_walks(stops, 90), None)
    spots = transfers.stop_spots(stops)
    by_place = Timetable(*[None] * 8, spots=spots, spot_ways=transfers.spot_ways(spots, 90))
    labels = spark.range(40).where("id % 4 <> 1").selectExpr("id % 2 AS solve", "id AS stop_id", "explode(array(id % 5, id % 3 + 3)) AS at", "100 - at AS start")
    for keys in ([], ["solve"]):
        got, want = (sorted(map(tuple, routing.best_walks(t, labels, keys, ["at", "walk", "from_stop"]).collect())) for t in (by_place, plain))
        assert got == want and got
    # of starts those that none betters
    keys, found = ["solve", "start"], []
    for t in (by_place, plain):
        every = routing.best_walks(t, labels.dropDuplicates(["solve", "stop_id", "start"]), keys, ["at", "walk", "from_stop"]).select(*keys, "stop_id", "b.*").collect()
        better = lambda x, y: (x.solve, x.stop_id) == (y.solve, y.stop_id) and y.start > x.start and y.at <= x.at
        found.append(sorted(tuple(x) for x in every if not any(better(x, y) for y in every)))
    assert found[0] == found[1] and found[0]
