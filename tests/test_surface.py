"""The query surface, lookups, stored tables, and sources' failures."""

import datetime as dt
import io
import json
import re
import threading
import urllib.error

import pytest
from pyspark.sql import functions as F

from tests.test_timetable import _message, at, city, network  # noqa: F401
from tramline.api import Engine, QueryError
from tramline.functions import scalars as S
from tramline.operators import catalog, realtime, routing, schedule, transfers
from tramline.sources import gtfs
from tramline.sources import realtime as rt
from tramline.schemas import TABLES
from tramline.timetable import Conflict, Timetable

NOW = at("2026-07-24T06:00:00-04:00")


class Feeds:
    def __init__(self, spark, **rows):
        self.spark, self.rows, self.asked = spark, rows, []

    def snapshot(self, name):
        self.asked.append(name)
        if name not in self.rows:
            raise OSError("down")
        return self.spark.createDataFrame([(*x, k) for k, x in enumerate(self.rows[name])], f"{rt.SCHEMAS[name]}, position long")


def test_arrivals_policy(city, spark):  # noqa: F811
    # a subway station is scheduled, whatever the feed has
    feeds = Feeds(spark, trips=[("9", "1", [("50662", NOW + 60, None)])])
    engine = Engine(city, feeds, clock=lambda: NOW - 3600)
    got = engine.arrivals(9000)
    assert feeds.asked == [] and not got["realtime_available"] and got["stop"]["mode"] == "subway"
    assert {x["source"] for x in got["arrivals"]} == {"scheduled"} and all(not x["realtime"] for x in got["arrivals"])
    # predicted where there is a prediction
    engine = Engine(city, feeds, clock=lambda: NOW)
    got = engine.arrivals(662)
    assert got["realtime_available"] and [x["source"] for x in got["arrivals"]] == ["predicted"] and got["arrivals"][0]["time"].startswith("2026-07-24T06:01:00-04:00")
    # another route's prediction, none at all and a feed that fails fall back
    assert not engine.arrivals(662, route_id=900)["realtime_available"]
    assert [x["route_id"] for x in engine.arrivals(662, route_id=900)["arrivals"]][:1] == ["900"]
    assert not Engine(city, Feeds(spark, trips=[]), clock=lambda: NOW).arrivals(662)["realtime_available"]
    assert not Engine(city, Feeds(spark), clock=lambda: NOW).arrivals(662)["realtime_available"]
    assert not Engine(city, None, clock=lambda: NOW).arrivals(662)["realtime_available"]
    for bad in (lambda: engine.arrivals("x"), lambda: engine.arrivals(662, limit=0)):
        with pytest.raises(QueryError) as e:
            bad()
        assert e.value.code == "invalid_argument"
    with pytest.raises(QueryError) as e:
        engine.arrivals(5)
    assert e.value.code == "not_found"


def test_vehicles_and_alerts_in_the_feeds_order(city, spark):  # noqa: F811
    vehicles = [(f"v{9 - k}", "900", "", 43.7, -79.4, None, 1, None) for k in range(5)] + [(None, "900", "", 43.7, -79.4, None, None, None), ("w", "", "", 43.7, -79.4, None, None, None)]
    alerts = [(f"a{9 - k}", [("Delay", "en")], None, None, None, None, None, [("900", None, None)], []) for k in range(4)]
    engine = Engine(city, Feeds(spark, vehicles=vehicles, alerts=alerts), clock=lambda: NOW)
    got = engine.vehicles(900, limit=3)
    assert [x["vehicle_id"] for x in got["vehicles"]] == ["v9", "v8", "v7"] and got["truncated"] and got["realtime_available"]
    assert not engine.vehicles(900, limit=5)["truncated"]
    assert engine.vehicles(1) == {"route_id": "1", "vehicles": [], "realtime_available": False, "truncated": False, "note": "Subway trains have no positions in the feed."}
    got = engine.alerts(route_id=900, limit=2)
    assert [x["id"] for x in got["alerts"]] == ["a9", "a8"] and got["truncated"] and got["alerts"][0]["category"] == "delay"
    assert not engine.alerts(mode="bus", limit=4)["truncated"] and engine.alerts(stop_id=1) == {"alerts": [], "truncated": False}
    with pytest.raises(QueryError) as e:
        Engine(city, Feeds(spark)).vehicles(900)
    assert e.value.code == "upstream_unavailable"


def test_fares_and_resources(city):  # noqa: F811
    engine = Engine(city)
    got = engine.fares("adult", "cash")
    assert [x["price"] for x in got["fares"]] == [3.35] and got["transfer"]["window_minutes"] == 120 and got["notes"] and got["source_url"].startswith("https://")
    assert json.loads(engine.resource("fares")) == engine.fares()
    assert [x["stop_id"] for x in json.loads(engine.resource("stops"))] == sorted((str(x["stop_id"]) for x in catalog.stop_summaries(city).collect()), key=int)
    assert json.loads(engine.resource("routes")) == engine.routes()
    with pytest.raises(QueryError):
        engine.resource("trains")


def test_join_report(city, spark):  # noqa: F811
    rows = [("77", "900"), ("1", "1"), (None, "900"), ("", None), ("x1", "900"), ("x1", " "), ("1", "1"), (" 2 ", ""), ("78", None)]
    updates = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "trip_id string, route_id string, position long")
    got = realtime.join_report(city, updates).first().asDict()
    assert got == {
        "static_trip_count": 3, "rt_trip_updates": 9, "distinct_rt_trip_ids": 5, "numeric_trip_ids": 4, "non_numeric_trip_ids": 2, "matched_trip_ids": 2, "unmatched_trip_ids": 3,
        "overlap_pct": 40.0, "unmatched_updates": 6, "unmatched_updates_recovered": 3, "unmatched_updates_unrecoverable": 3,
        "sample_unmatched_trip_ids": ["77", "78", "x1"], "sample_non_numeric_trip_ids": ["x1", "x1"],
    }
    empty = realtime.join_report(city, updates.limit(0)).first().asDict()
    assert empty["overlap_pct"] == 0.0 and empty["sample_unmatched_trip_ids"] == [] and empty["static_trip_count"] == 3


def test_trip_lookups(city, spark):  # noqa: F811
    assert catalog.count_trips(city).first()["n"] == 3
    asked = spark.createDataFrame([(1,), (1,), (77,), (None,)], "trip_id long")
    assert [x["trip_id"] for x in catalog.trips_existing(city, asked).collect()] == [1]


def test_departures_rank_once_for_whole_days(city, spark):  # noqa: F811
    """The same as with every day's departures written out."""
    t = city
    for when in (NOW, at("2026-07-24T23:59:00-04:00"), at("2026-07-25T02:00:00-04:00")):
        asked = spark.createDataFrame([(7, 9000, when), (8, 662, when), (9, 5, when)], "request_id long, stop_id long, when long")
        for limit in (1, 2, 4):
            got = [(x["request_id"], x["k"], x["at"], x["truncated"]) for x in schedule.next_departures(t, asked, limit).orderBy("request_id", "k").collect()]
            want = []
            for request, stop in ((7, 9001), (8, 662)):
                days = spark.range(-1, 15).select(F.date_add(S.service_date(F.lit(when)), F.col("id").cast("int")).alias("date"))
                active = schedule.active_services(t, days).withColumn("midnight", S.midnight(F.col("date")))
                rows = schedule.departures(t).where(F.col("stop_id") == stop).join(active, "service_id")
                every = sorted(x["a"] for x in rows.select((F.col("midnight") + F.col("dep")).alias("a")).collect() if x["a"] >= when)
                want += [(request, k + 1, a, len(every) > limit) for k, a in enumerate(every[:limit])]
            assert got == want
    assert schedule.next_departures(t, asked, 3, route_id=900).select("route_id").distinct().collect()[0][0] == 900


def test_load_is_replaced_whole(city, spark, tmp_path):  # noqa: F811
    folder = str(tmp_path / "t")
    city.write(folder)
    first = Timetable.read(spark, folder)
    assert sorted(map(tuple, first.served.collect())) == sorted(map(tuple, catalog.served_routes(city).collect()))
    assert sorted(map(tuple, first.canonical.collect())) == sorted(map(tuple, catalog.canonical_trips(city).collect()))
    assert catalog.stop_detail(first, 9000).first().asDict(recursive=True) == catalog.stop_detail(city, 9000).first().asDict(recursive=True)
    # a stop's detail and a search read no stop times
    for df in (catalog.stop_detail(first, 9000), catalog.search_by_name(first, "union"), catalog.search_near(first, 43.65, -79.38), catalog.list_routes(first)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "stop_times" not in plan and "dep#" not in plan
    # a load that fails leaves the one in use as it was
    broken = Timetable(**{k: getattr(city, k) for k in ("stops", "routes", "calendar", "calendar_dates", "trips", "stop_times", "rt_stop_crosswalk")}, transfers=city.transfers.select(F.raise_error(F.lit("no")).alias("x")).union(spark.sql("select raise_error('no')")))
    with pytest.raises(Exception):
        broken.write(folder)
    assert Timetable.read(spark, folder).stops.count() == city.stops.count()
    assert not any(x.name.startswith("load-") and x.name not in first.stops.inputFiles()[0] for x in (tmp_path / "t").iterdir())


def test_versions(city, spark, tmp_path):  # noqa: F811
    """Readers keep the load they opened; replaced ones go after the time of grace; of two
    writers that begin from the same version one wins."""
    folder = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        Timetable.read(spark, folder)
    assert city.write(folder) == 0
    early = Timetable.read(spark, folder)
    fewer = Timetable.read(spark, folder)
    fewer.trips, fewer.served, fewer.canonical, fewer.boards, fewer.runs = fewer.trips.where("trip_id <> 5"), None, None, None, None
    assert fewer.write(folder) == 1
    assert early.trips.count() == 3 and early.runs.count() == early.stop_times.count()
    assert Timetable.read(spark, folder).trips.count() == 2 and Timetable.read(spark, folder, 0).trips.count() == 3

    class Slow(Timetable):
        """Another writer is done while this one writes."""

        def _write_load(self, place):
            if not place.endswith("done"):
                city.write(folder)
            return super()._write_load(place)

    loads = lambda: {x.name for x in (tmp_path / "t").iterdir() if x.name.startswith("load-")}
    slow = Slow(**{k: getattr(city, k) for k in TABLES})
    with pytest.raises(Conflict):
        slow.write(folder)
    assert Timetable.read(spark, folder).trips.count() == 3 and len(loads()) == 3
    assert city.write(folder, grace=0) == 3 and len(loads()) == 1
    with pytest.raises(FileNotFoundError):
        Timetable.read(spark, folder, 0)


def test_stored_stop_times_join_in_place(city, spark, tmp_path):  # noqa: F811
    """Rides and trips' departures exchange no stop times; a boarding reads one row a pattern."""
    city.write(str(tmp_path / "t"))
    stored = Timetable.read(spark, str(tmp_path / "t"))
    boarded = spark.createDataFrame([(2, 1), (1, 0)], "trip_id long, board_seq int").hint("merge")
    plan = routing.rides(stored, boarded)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin") :]
    scan = below[: below.index("tramline_runs")]
    assert scan.count("Exchange hashpartitioning") == 1, plan  # the boarded side's
    assert sorted(map(tuple, routing.rides(stored, boarded).select("trip_id", "to_stop", "arr").collect())) == sorted(map(tuple, routing.rides(city, boarded).select("trip_id", "to_stop", "arr").collect()))
    packed = stored.boards.groupBy("stop_id").count().collect()
    patterns = city.stop_times.join(city.trips, "trip_id").select("stop_id", "route_id", "direction_id", "trip_headsign").distinct().groupBy("stop_id").count().collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, patterns))


def test_first_departure_by_halving(spark):
    """The same as a search through all departures, at every time."""
    times = [5, 5, 9, 12, 30]
    rows = [([(d, k, 0) for k, d in enumerate(times[:n])], at) for n in range(1, 6) for at in range(0, 35)]
    df = spark.createDataFrame(rows, "d array<struct<dep: int, trip_id: long, seq: int>>, at int")
    df = df.withColumn("m", F.create_map(F.lit(1), F.col("d"))).withColumn("s", F.array(F.lit(1), F.lit(2)))
    for x in df.select("d", "at", schedule.departures_before(F.col("d"), F.col("at")).alias("n"), schedule.first_departure(F.col("m"), F.col("s"), F.col("at")).alias("b")).collect():
        assert x["n"] == sum(y["dep"] < x["at"] for y in x["d"])
        assert x["b"] == next((y for y in x["d"] if y["dep"] >= x["at"]), None)


def test_itinerary_validators(network):  # noqa: F811
    got = routing.plan_trip(network, "101", "203", dt.datetime.fromisoformat("2026-07-24T07:55:00-04:00"))
    for x in got["itineraries"]:
        assert routing.valid_times(x) and not routing.adjacent_walks(x) and 0 < routing.furthest_walk(network, x) < 250
    assert routing.furthest_walk(network, {"legs": [{"type": "transfer", "from_stop": None, "to_stop": 101}]}) == 0.0


def test_route_types_and_signature(spark):
    row = spark.range(1).select(
        S.type_of_mode(F.lit("subway")).alias("a"), S.type_of_mode(F.lit("ferry")).alias("b"),
        S.route_signature(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(r).cast("int").alias("route_id")) for k, r in (("transit", 5), ("transfer", None), ("transit", 7))])).alias("c"),
    )
    got = row.first()
    assert got["a"] == 1 and got["b"] is None and got["c"] == routing.signature({"legs": [{"type": "transit", "route_id": 5}, {"type": "transfer"}, {"type": "transit", "route_id": 7}]})
    with pytest.raises(Exception, match="unknown route_type"):
        spark.range(1).select(S.mode(F.lit(12))).collect()


def test_decode_vehicles_and_alerts(spark):
    import struct

    def fixed(number, value):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)

    trip = _message((1, b"7"), (5, b"900"))
    place = fixed(1, 43.5) + fixed(2, -79.25) + fixed(3, 90.0)
    vehicle = _message((1, trip), (2, place), (8, _message((1, b"4001"))), (5, 1700000000), (9, 5))
    text = _message((1, _message((1, b"Delay"), (2, b"en"))))
    alert = _message((1, _message((1, 5), (2, 9))), (5, _message((2, b"900"), (3, 3))), (5, _message((5, b"662"))), (6, 2), (7, 4), (10, text), (14, 3))
    feed = _message((1, _message((1, b"2.0"))), (2, _message((1, b"e"), (4, vehicle))), (2, _message((1, b"f"), (5, alert))))
    got = rt.decode(feed)
    assert got["vehicles"] == [("4001", "900", "7", 43.5, -79.25, 90.0, 5, 1700000000)]
    assert got["alerts"] == [("f", [("Delay", "en")], [], [], 2, 4, 3, [("900", None, 3), (None, "662", None)], [(5, 9)])]


def test_fetch_is_shared(spark):
    feed = _message((1, _message((1, b"2.0"))), (2, _message((1, b"e"))))
    calls, gate = [], threading.Event()

    def get(url):
        calls.append(url)
        gate.wait(5)
        return feed

    client = rt.FeedClient(spark, "http://x", get=get, clock=lambda: 0.0)
    threads = [threading.Thread(target=client.snapshot, args=("trips",)) for _ in range(4)]
    for x in threads:
        x.start()
    gate.set()
    for x in threads:
        x.join()
    assert len(calls) == 1
    # what cannot be decoded is not kept
    client = rt.FeedClient(spark, "http://x", get=lambda u: b"\x12\x7f", clock=lambda: 0.0)
    with pytest.raises(Exception):
        client.snapshot("trips")
    assert client.kept == {}


def test_smoke_checks():
    def answer(body):
        return lambda url: json.dumps(body).encode()

    def status(code):
        def get(url):
            raise urllib.error.HTTPError(url, code, "no", None, io.BytesIO())

        return get

    whole = {"success": True, "result": {"resources": [{"id": "other"}, {"id": "r", "url": "https://x/feed.zip", "last_modified": None, "metadata_modified": "2026-01-02"}]}}
    assert rt.fetch_stamp("https://c/show", "p", "r", answer(whole)) == "2026-01-02"
    assert rt.check_static("https://c/show", "p", "r", answer(whole)) == {"name": "static feed", "domain": "c", "ok": True, "detail": "resource at https://x/feed.zip"}
    for get, said in ((status(503), "503"), (answer({"success": False}), "failure"), (answer({"success": True, "result": {"resources": []}}), "no resource r"), (answer({"success": True, "result": {"resources": [{"id": "r"}]}}), "no ")):
        with pytest.raises(ValueError, match=said):
            rt.fetch_stamp("https://c/show", "p", "r", get)
        got = rt.check_static("https://c/show", "p", "r", get)
        assert not got["ok"] and said in got["detail"]
    feed = _message((1, _message((1, b"2.0"))), (2, _message((1, b"e"))))
    assert rt.check_realtime("https://b/feeds", lambda u: feed)["ok"] and not rt.check_realtime("https://b/feeds", lambda u: b"")["ok"]
    assert not rt.check_realtime("https://b/feeds", status(404))["ok"]


def test_download(tmp_path):
    source = tmp_path / "a.zip"
    source.write_bytes(b"zip" * 1000)
    with open(gtfs.download(source.as_uri()), "rb") as f:
        assert f.read() == b"zip" * 1000
    with pytest.raises(OSError):
        gtfs.download((tmp_path / "none.zip").as_uri())


def test_csv_is_split_unless_a_text_goes_over_a_line(spark, tmp_path):
    plain, odd = tmp_path / "plain.csv", tmp_path / "odd.csv"
    plain.write_text('a,b\n1,"x, ""y"""\n2,z\n')
    odd.write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(x) for x in gtfs.read_csv(spark, str(plain)).collect()] == [("1", 'x, "y"'), ("2", "z")]
    assert [tuple(x) for x in gtfs.read_csv(spark, str(odd)).collect()] == [("1", "x\ny"), ("2", "z")]


def test_pathways_beside_other_transfers(spark):
    stops = spark.createDataFrame([(1, None), (2, None), (3, None)], "stop_id long, parent_station long")
    rows = [("a", 1, 50, 1, 1, 10, None), ("b", 50, 2, 1, 0, 5, None), ("c", 1, 2, 1, 1, 99, None)]
    ways = spark.createDataFrame(rows, "pathway_id string, from_stop_id long, to_stop_id long, pathway_mode int, is_bidirectional int, traversal_time int, length double")
    assert sorted(map(tuple, transfers.pathway_transfers(stops, ways).collect())) == [(1, 2, 15, "pathway"), (2, 1, 99, "pathway")]


def _many_stops(spark):
    """A grid of named stops, each served by one trip."""
    names = ["Union Station", "union st", "100% Road", "a_b", "back\\slash", "Ää Straße", "", "xy", "KING ST WEST", "King_St"]
    n = 4000
    stops = spark.range(n).select(
        F.col("id").alias("stop_id"), F.col("id").alias("stop_code"), F.concat(F.get(F.array(*[F.lit(x) for x in names]), F.col("id") % 10), F.when(F.col("id") % 10 > 7, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("id").cast("string")))).alias("stop_name"),
        (43.0 + F.floor(F.col("id") / 64) * 0.01).alias("stop_lat"), (-80.0 + F.col("id") % 64 * 0.01).alias("stop_lon"), F.lit(None).cast("long").alias("parent_station"), F.lit(0).alias("location_type"),
    )
    t = Timetable.from_rows(spark, routes=[(1, "1", "One", 3, "")], trips=[(1, 1, 1, "x", 0, None)], calendar=[(1, 1, 1, 1, 1, 1, 1, 1, 20260101, 20261231)])
    t.stops = stops
    t.stop_times = stops.select(F.lit(1).cast("long").alias("trip_id"), "stop_id", F.col("stop_id").cast("int").alias("stop_sequence"), F.col("stop_id").cast("int").alias("arr"), F.col("stop_id").cast("int").alias("dep"))
    return t


def test_names_by_triples_and_places_by_cells(spark, tmp_path):
    """The same as a scan, for random pieces of names with and without wildcards, and for
    random boxes; a search near a place reads few of the stops."""
    import random

    plain = _many_stops(spark)
    plain.write(str(tmp_path / "t"))
    stored = Timetable.read(spark, str(tmp_path / "t"))
    names = {x["stop_id"]: x["stop_name"] for x in plain.stops.collect()}
    r, queries = random.Random(4), ["union", "UNION ST", "0%", "_b", "back\\", "Straße", "ä", "on%st", "K_ng", "", "%", "xyz", "g_St", "king st", "%%39_"]
    for _ in range(6):
        name = r.choice(list(names.values()))
        at = r.randrange(max(1, len(name) - 4))
        queries.append(name[at : at + 5].swapcase())
    for query in queries:
        for wildcards in (False, True):
            low = query.lower()
            pattern = ".*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) if wildcards else re.escape(c) for c in low) + ".*"
            want = {k for k, x in names.items() if re.fullmatch(pattern, x.lower(), re.S)}
            assert {x["stop_id"] for x in catalog._named(stored, query, wildcards).select("stop_id").collect()} == want, (query, wildcards)
    assert [x["name"] for x in catalog.search_by_name(stored, "king_st", wildcards=True, limit=2).collect()] == ["KING ST WEST", "KING ST WEST"]
    for _ in range(6):
        lat, lon, radius = r.uniform(42.9, 43.7), r.uniform(-80.1, -79.3), r.choice((500, 3000, 20_000))
        got, want = ([tuple(x) for x in catalog.search_near(x, lat, lon, radius).select("stop_id", "metres").collect()] for x in (stored, plain))
        assert got == want
    ranges = catalog.cell_ranges((43.3, -79.7), (43.31, -79.69))
    found = stored.places.where(" or ".join(f"cell between {a} and {b}" for a, b in ranges))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    while scan.children().size():
        scan = scan.children().head()
    assert 1 <= scan.metrics().apply("numOutputRows").value() <= 1000 < len(names)


def test_resources_are_written_by_tasks(city, spark, tmp_path):  # noqa: F811
    engine = Engine(city)
    engine.write_resource("stops", str(tmp_path / "stops"))
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "stops")).collect()]
    assert sorted(lines, key=lambda x: int(x["stop_id"])) == json.loads(engine.resource("stops")) and len(lines) == 4
    first = json.loads(engine.resource("stops"))[0]
    assert first == {"stop_id": "662", "stop_code": 662, "name": "Danforth Rd at Kennedy Rd", "mode": "bus", "is_station": False, "lat": 43.714379, "lon": -79.260939}
    assert "color" not in json.loads(engine.resource("routes"))[1] and json.loads(engine.resource("fares"))["fares"]
    with pytest.raises(QueryError):
        engine.resource("none")


def test_parts_of_the_views_on_demand(spark, tmp_path):
    """A query on stops alone neither stores stop times nor pairs stops."""
    from tramline.plans import queries
    from tramline.sources.testviews import timetable

    for name in ("nation", "supplier", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    made = lambda: {k for k in vars(timetable(spark, str(tmp_path))) if not k.startswith("_")}
    assert queries.QUERIES["b2_crosswalk"](spark, str(tmp_path)).count() and made() == {"stops"}
    queries.QUERIES["a8_earliest_arrivals"](spark, str(tmp_path)).collect()
    assert "runs" in made() and not made() & {"transfers", "spots", "spot_ways"}
    queries.QUERIES["j7_footpaths"](spark, str(tmp_path)).collect()
    assert "spot_ways" in made() and "transfers" not in made()
