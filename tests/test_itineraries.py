"""Itineraries of many requests, against a plain search through all journeys."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_timetable import DAILY, at
from tramline.operators import itineraries, routing
from tramline.timetable import Timetable

DAY = at("2026-08-04T00:00:00-04:00")
HOUR = 3600


def _network(spark, folder, seed, stops=9, trips=40, span=(7, 12)):
    """Random trips, no two of a pattern overtaking each other, and a few footpaths; stored."""
    r = random.Random(seed)
    paths = {k: r.sample(range(1, stops + 1), r.randint(2, 5)) for k in range(6)}
    rows, times = [], []
    for trip in range(1, trips + 1):
        route = r.choice(list(paths))
        start = r.randrange(span[0] * 60, span[1] * 60) * 60 + r.choice((0, 0, 7))
        rows.append((trip, route, 1, None if route == 0 else f"H{route}", 0, None))
        times += [(trip, s, k + 1, start + 420 * k, start + 420 * k + 60) for k, s in enumerate(paths[route])]
    walks = [(a, b, r.randrange(60, 600), "street") for a, b in {tuple(r.sample(range(1, stops + 1), 2)) for _ in range(5)}]
    t = Timetable.from_rows(
        spark, stops=[(k, k, f"S{k}", 43.6 + k / 100, -79.4, None, None) for k in range(1, stops + 1)], routes=[(k, f"R{k}", "", 3, "") for k in paths],
        calendar=[(1, *DAILY, 20260101, 20261231)], trips=rows, stop_times=times, transfers=walks,
    )
    t.write(str(folder))
    return Timetable.read(spark, str(folder)), {x[0]: x for x in rows}, times, walks


def _journeys(trips, times, walks, access, egress, most, day=DAY):
    """(start, at, rides, kind, first board) of every way there is."""
    runs = {}
    for trip, stop, seq, arr, dep in sorted(times, key=lambda x: (x[0], x[2])):
        runs.setdefault(trip, []).append((stop, day + arr, day + dep))
    out = []

    def ride(stop, now, start, first, kind):
        for trip, run in runs.items():
            for i, (s, _, dep) in enumerate(run):
                if s != stop or (dep < now if start is not None else False):
                    continue
                begun = start if start is not None else dep - now
                for s2, arr, _ in run[i + 1 :]:
                    kinds = [*kind, str(trips[trip][1])]
                    board = dep if first is None else first
                    if arr >= begun + access.get(s2, 10**9):
                        continue  # one who starts then and walks is there no later
                    for end, later in [(s2, arr), *((b, arr + w) for a, b, w, _ in walks if a == s2)]:
                        if later >= begun + access.get(end, 10**9):
                            continue
                        if end in egress:
                            out.append((begun, later + egress[end], len(kinds), ">".join(kinds), board))
                        if len(kinds) <= most:
                            ride(end, later, begun, board, kinds)

    for stop, walk in access.items():
        ride(stop, walk, None, None, [])
    return out


def _solve(journeys, depart, direct):
    """Earliest arrival of who leaves at ``depart`` or later; of those the last start."""
    ways = [x for x in journeys if x[0] >= depart and x[1] <= depart + 6 * HOUR]
    if not ways:
        return None
    start, end = max((x[:2] for x in ways if x[1] == min(y[1] for y in ways)), key=lambda x: x[0])
    if direct is not None and depart + direct <= end:
        return None
    rides = min(x[2] for x in ways if x[:2] == (start, end))
    return start, end, rides, {(x[3], x[4]) for x in ways if x[:3] == (start, end, rides)}


def _repeated(journeys, when, late, wanted, direct):
    """The alternates as one search after another finds them; None where ways equal in
    times and rides differ in what decides how it goes on."""
    found, kinds, repeats = [], [], 0
    depart, tries = when, 2 * wanted + 2
    if late:
        anchor = _solve(journeys, when - 6 * HOUR, direct)
        if anchor is None or anchor[1] > when:
            return []
        depart, tries = when - (anchor[1] - anchor[0]) - 20 * 60, 4 * wanted + 8
    for _ in range(tries):
        x = _solve(journeys, depart, direct)
        if x is None or late and x[1] > when:
            break
        if len(x[3]) > 1:
            return None
        ((kind, board),) = x[3]
        repeats = repeats + 1 if kind in kinds else 0
        found.append((*x[:3], kind))
        kinds.append(kind)
        depart = board + 1
        if not late and (repeats >= 2 or len(set(kinds)) >= wanted):
            break
    if late and not found:
        if len(anchor[3]) > 1:
            return None
        found = [(*anchor[:3], next(iter(anchor[3]))[0])]
    ordered = sorted(found, key=lambda x: -x[0]) if late else found
    kept = {}
    for x in ordered:
        kept.setdefault(x[3], x)
    return sorted(kept.values(), key=lambda x: (-x[0], x[1] - x[0]) if late else (x[1], x[1] - x[0]))[:wanted]


def _well_formed(x, access, egress, times, walks):
    """Legs follow each other in place and time."""
    calls = {(t, s): (a, d) for t, s, _, a, d in times}
    here, now, legs = None, x["depart"], x["legs"]
    for k, leg in enumerate(legs):
        assert here is None or leg["from_stop"] == here
        if leg["type"] == "transit":
            assert DAY + calls[leg["trip_id"], leg["from_stop"]][1] == leg["depart"] >= now and DAY + calls[leg["trip_id"], leg["to_stop"]][0] == leg["arrive"]
            assert leg["route_short_name"] == f"R{leg['route_id']}" and leg["num_stops"] > 0
            now = leg["arrive"]
        else:
            assert not k or legs[k - 1]["type"] == "transit"
            now += leg["duration_seconds"]
        here = leg["to_stop"]
    assert now == x["arrive"] and (legs[0]["from_stop"] in access or legs[0]["from_stop"] is None) and (here is None or here in egress)


@pytest.mark.parametrize("seed", [2])
def test_like_repeated_searches(spark, tmp_path, seed):
    t, trips, times, walks = _network(spark, tmp_path / "t", seed)
    r, requests, access, egress, want = random.Random(seed), [], [], [], {}
    for request in range(60):
        a, b = r.sample(range(1, 10), 2)
        start, end = {a: 0} | ({r.randint(1, 9): 240} if r.random() < 0.4 else {}), {b: 0} | ({r.randint(1, 9): 300} if r.random() < 0.4 else {})
        when, late, wanted = DAY + r.randrange(6 * 60, 13 * 60) * 60, request % 3 == 0, r.randint(1, 4)
        direct = min((start[s] + end[s] for s in start if s in end), default=None)
        want[request] = _repeated(_journeys(trips, times, walks, start, end, 2), when, late, wanted, direct), start, end
        requests.append((request, when, late, wanted))
        access += [(request, s, w) for s, w in start.items()]
        egress += [(request, s, w) for s, w in end.items()]
    asked = spark.createDataFrame(requests, "request long, when long, arrive_by boolean, wanted int")
    ends = [spark.createDataFrame(x, "request long, stop_id long, walk int") for x in (access, egress)]
    got = {}
    for x in itineraries.plan_trips(t, asked, *ends, max_transfers=2).orderBy("request", "k").collect():
        got.setdefault(x["request"], []).append(x)
    compared = 0
    for request, (plain, start, end) in want.items():
        for x in got.get(request, []):
            _well_formed(x, start, end, times, walks)
        if plain is None:
            continue
        compared += bool(plain)
        kinds = lambda x: ">".join(str(leg["route_id"]) for leg in x["legs"] if leg["type"] == "transit")
        assert [(x["depart"], x["arrive"], x["transfers"] + 1, kinds(x)) for x in got.get(request, [])] == plain, request
        assert [x["k"] for x in got.get(request, [])] == list(range(1, len(plain) + 1))
    assert compared >= 20


def test_requests_share_a_search(spark, tmp_path):
    """Requests of one origin and time, searched once, have what each has alone."""
    t, *_ = _network(spark, tmp_path / "t", 5)
    when = DAY + 7 * HOUR
    requests = [(k, 77, when, False, 2) for k in range(2, 10)]
    asked = spark.createDataFrame(requests, "request long, solve long, when long, arrive_by boolean, wanted int")
    egress = spark.createDataFrame([(k, k, 0) for k in range(2, 10)], "request long, stop_id long, walk int")
    shared = itineraries.plan_trips(t, asked, spark.createDataFrame([(77, 1, 0)], "solve long, stop_id long, walk int"), egress)
    alone = itineraries.plan_trips(t, asked.drop("solve"), spark.createDataFrame([(k, 1, 0) for k in range(2, 10)], "request long, stop_id long, walk int"), egress)
    rows = lambda df: sorted((tuple(x) for x in df.select("request", "k", "depart", "arrive", "legs").collect()), key=repr)
    assert rows(shared) == rows(alone) and rows(shared)


def test_later_starts_are_searched_when_needed(spark):
    """Few departures a day: the second way leaves hours after the span that is searched first.
    Arriving by a time, what the fastest way needs and twenty minutes are tried, and the
    first way there is stands in where that has none."""
    times = [(k, s, n, h * HOUR + n * 600, h * HOUR + n * 600) for k, h in ((1, 8), (2, 13), (3, 18)) for n, s in ((1, 1), (2, 2))]
    t = Timetable.from_rows(
        spark, stops=[(1, 1, "a", 0.0, 0.0, None, None), (2, 2, "b", 0.0, 0.0, None, None)], routes=[(k, str(k), "", 3, "") for k in (1, 2, 3)], calendar=[(1, *DAILY, 20260101, 20261231)],
        trips=[(k, k, 1, "", 0, None) for k in (1, 2, 3)], stop_times=times,
    )
    asked = spark.createDataFrame([(0, DAY + 7 * HOUR, False, 3), (1, DAY + 20 * HOUR, False, 3), (2, DAY + 14 * HOUR, True, 3)], "request long, when long, arrive_by boolean, wanted int")
    ends = [spark.createDataFrame([(k, s, 0) for k in range(3)], "request long, stop_id long, walk int") for s in (1, 2)]
    got = itineraries.plan_trips(t, asked, *ends).orderBy("request", "k").collect()
    assert [(x["request"], (x["depart"] - DAY) / HOUR) for x in got] == [(0, 8 + 1 / 6), (0, 13 + 1 / 6), (0, 18 + 1 / 6), (2, 8 + 1 / 6)]


def test_walks_are_merged(spark):
    def leg(kind, a, b, seconds=None):
        return {"type": kind, "from_stop": a, "to_stop": b, "trip_id": None, "route_id": None, "headsign": None, "depart": None, "arrive": None, "num_stops": None, "duration_seconds": seconds}

    legs = [leg("transfer", None, 1, 5), leg("transit", 1, 2), leg("transfer", 2, 3, 7), leg("transfer", 3, None, 8), leg("transfer", None, 2, 1), leg("transit", 2, 4), leg("transfer", 4, 5, 9), leg("transfer", 5, 4, 9)]
    df = spark.createDataFrame([([], ), (legs,)], f"legs array<{itineraries.LEG}>").select(itineraries.merged_walks(F.col("legs")).alias("m"))
    got = [[(x["type"], x["from_stop"], x["to_stop"], x["duration_seconds"]) for x in row["m"]] for row in df.collect()]
    # the three walks after the first ride lead back to where it ended, and so does the last
    assert got == [[], [("transfer", None, 1, 5), ("transit", 1, 2, None), ("transit", 2, 4, None)]]
    assert routing.adjacent_walks({"legs": legs})


def test_no_requests_and_no_ways(spark, tmp_path):
    t, *_ = _network(spark, tmp_path / "t", 5)
    asked = spark.createDataFrame([], "request long, when long, arrive_by boolean, wanted int")
    nothing = spark.createDataFrame([], "request long, stop_id long, walk int")
    assert itineraries.plan_trips(t, asked, nothing, nothing).count() == 0
    asked = spark.createDataFrame([(0, DAY + 7 * HOUR, False, 1), (1, DAY + 7 * HOUR, True, 1)], "request long, when long, arrive_by boolean, wanted int")
    assert itineraries.plan_trips(t, asked, nothing, nothing).count() == 0
