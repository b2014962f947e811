"""Itineraries of many requests at once, by a search over a range of departures.

A label says that a stop is reached at a time by one who starts at another: (solve, round,
stop_id, start, at). Per stop, those are kept of which none is bettered by one that starts
no earlier and arrives no later. One search so holds the answers for every time of
departure in its span, and a request's alternates, or the last ways to arrive by a time,
are picked out of its few answers instead of being solved for one after another.

A label is a ride, or a ride and a walk, and names where the ride was boarded; the label it
goes on from has the same start there, one round earlier. Legs are put together by one
join a round, for the answers alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import materialize
from ..functions import scalars as S
from ..schemas import HORIZON_HOURS, MAX_TRANSFERS
from . import routing, schedule

HORIZON = HORIZON_HOURS * 3600
#: Seconds of departures that are searched first; a request that needs later ones gets
#: another search, over as much more at least.
SPAN = 2 * 3600
#: Seconds by which the search for a latest departure begins earlier than the fastest
#: way needs.
SLACK = 20 * 60
RIDE = ["walk", "trip_id", "board_stop", "board_seq", "seq", "board_at", "ride_stop", "ride_at", "route_id", "headsign"]
LEG = "struct<type: string, from_stop: long, to_stop: long, trip_id: long, route_id: long, headsign: string, depart: long, arrive: long, num_stops: int, duration_seconds: int>"


def _not_bettered(rows: DataFrame, keys: list, *ties: str) -> DataFrame:
    """Rows (start, at) that no other of the same keys betters; of equal ones the first in
    order of ``ties``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("start"), "at", *ties)
    earlier = F.min("at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_earlier", earlier).where("_earlier is null or at < _earlier").drop("_earlier")


def _first_rides(boards: DataFrame, access: DataFrame, spans: DataFrame, days: DataFrame) -> DataFrame:
    """Every departure at an access stop that one who starts within the span can take."""
    asked = access.join(spans.select("solve", "first", "last"), "solve").join(days, "solve")
    rows = boards.join(asked, "stop_id").withColumn("start", F.col("midnight") + F.col("dep") - F.col("walk"))
    return _boarded(rows.where("start between first and last and array_contains(midnights, midnight)"))


def _next_rides(boards: DataFrame, labels: DataFrame, days: DataFrame) -> DataFrame:
    """From every label the first departure of each pattern, each service day apart. Of
    those who board the same trip at a stop the one who started last counts, so each
    departure meets a solve's labels at its stop once, and finds the last that is there."""
    lists = labels.groupBy("solve", "stop_id").agg(F.collect_list(F.struct("at", "start")).alias("there")).join(days, "solve")
    rows = boards.join(lists, "stop_id").where("array_contains(midnights, midnight)")
    rows = rows.withColumn("there", F.expr("array_max(filter(there, x -> x.at <= midnight + dep))")).select("*", "there.at", "there.start")
    first = F.col("before").isNull() | (F.col("midnight") + F.col("before") < F.col("at"))
    return _boarded(rows.where(F.col("start").isNotNull() & first & (F.col("midnight") + F.col("dep") <= F.col("start") + HORIZON)))


def _boarded(rows: DataFrame) -> DataFrame:
    return rows.select(
        "solve", "midnight", "start", F.col("stop_id").alias("board_stop"), "trip_id", F.col("seq").alias("board_seq"),
        (F.col("midnight") + F.col("dep")).alias("board_at"), "route_id", "headsign",
    )


def range_labels(t, access: DataFrame, spans: DataFrame, max_transfers: int = MAX_TRANSFERS, modes: list | None = None, targets: DataFrame | None = None) -> list:
    """The stored labels of each round. ``access`` (solve, stop_id, walk): where a solve's
    first rides begin; ``spans`` (solve, first, last, until): the starts searched, and the
    time after which nothing may arrive, if any. ``targets`` (solve, stop_id, walk): a
    solve's labels that cannot better what its targets have are left out."""
    spans = materialize(spans, "spans")
    last = F.col("last") + HORIZON
    days = routing.service_days(t, spans.select("solve", "first", F.coalesce(F.least(last, "until"), last).alias("last")))
    days = materialize(days, "days")
    near = spans.agg(F.min("first").alias("first"), F.max(F.coalesce(F.least(last, "until"), last)).alias("last"))
    boards = schedule.day_departures(t, days.select("midnight", "service_id").distinct(), modes).crossJoin(F.broadcast(near))  # one row
    boards = materialize(boards.where("midnight + dep between first and last").drop("first", "last"), "day-boards")
    days = days.groupBy("solve").agg(F.collect_set("midnight").alias("midnights"))
    walked = access.groupBy("solve", "stop_id").agg(F.min("walk").alias("walk"))
    rounds: list = []
    for n in range(1, max_transfers + 2):
        boarded = _next_rides(boards, rounds[-1], days) if rounds else _first_rides(boards, walked, spans, days)
        rode = routing.rides(t, boarded).select(
            "solve", F.col("to_stop").alias("stop_id"), "start", (F.col("midnight") + F.col("arr")).alias("at"), F.lit(None).cast("int").alias("walk"),
            "trip_id", "board_stop", "board_seq", "seq", "board_at", F.col("to_stop").alias("ride_stop"), (F.col("midnight") + F.col("arr")).alias("ride_at"), "route_id", "headsign",
        )
        known = [x.select("solve", "stop_id", "start", "at") for x in rounds]
        reached = _profile(rounds, targets) if targets is not None and rounds else None
        by_ride = materialize(_improved(rode, known, walked, spans, reached), "range-rides")
        on_foot = routing.best_walks(t, by_ride, ["solve", "start"], ["at", *RIDE]).select("solve", "stop_id", "start", "b.*")
        best = _improved(on_foot, [*known, by_ride.select("solve", "stop_id", "start", "at")], walked, spans, reached)
        both = _not_bettered(by_ride.unionByName(best), ["solve", "stop_id"], F.col("walk").asc_nulls_first())
        labels = materialize(both.withColumn("round", F.lit(n)), "range-labels")
        if labels.isEmpty():
            break
        rounds.append(labels)
    return rounds


def _improved(found: DataFrame, known: list, walked: DataFrame, spans: DataFrame, reached: DataFrame | None) -> DataFrame:
    """What of ``found`` arrives in time and is not bettered: by itself, by what is known,
    by walking to the stop at first, or by what the targets have."""
    rows = found.join(spans.select("solve", "until"), "solve").where((F.col("at") <= F.col("start") + HORIZON) & (F.col("until").isNull() | (F.col("at") <= F.col("until")))).drop("until")
    if reached is not None:
        rows = rows.join(reached, "solve", "left").where(F.coalesce(~F.exists("reached", lambda x: (x["start"] >= F.col("start")) & (x["at"] <= F.col("at"))), F.lit(True))).drop("reached")
    rows = rows.groupBy("solve", "stop_id", "start").agg(F.min(F.struct("at", *RIDE)).alias("b")).select("solve", "stop_id", "start", "b.*")
    rows = rows.join(walked.withColumnRenamed("walk", "_walk"), ["solve", "stop_id"], "left").where(F.col("_walk").isNull() | (F.col("at") < F.col("start") + F.col("_walk"))).drop("_walk")
    rows = rows.withColumn("new", F.lit(1))
    for old in known:
        rows = rows.unionByName(old.withColumn("new", F.lit(0)), allowMissingColumns=True)
    return _not_bettered(rows, ["solve", "stop_id"], "new").where("new = 1").drop("new")


def _profile(rounds: list, targets: DataFrame) -> DataFrame:
    """(solve, reached): the targets' answers so far, an array of (start, at) a solve."""
    every = reduce(DataFrame.unionByName, [x.select("solve", "stop_id", "start", "at") for x in rounds])
    ends = every.join(targets, ["solve", "stop_id"]).select("solve", "start", (F.col("at") + F.col("walk")).alias("at"))
    return _not_bettered(ends, ["solve"]).groupBy("solve").agg(F.collect_list(F.struct("start", "at")).alias("reached"))


def answers(rounds: list, requests: DataFrame, egress: DataFrame) -> DataFrame:
    """(request, start, at, first_board, legs) that none of the request betters; ``requests``
    (request, solve), ``egress`` (request, stop_id, walk). Equal ones: fewest rides."""
    every = reduce(DataFrame.unionByName, [x.select("solve", "round", "stop_id", "start", "at") for x in rounds])
    ways = egress.groupBy("request", "stop_id").agg(F.min("walk").alias("egress")).join(requests.select("request", "solve"), "request")
    ends = every.join(ways, ["solve", "stop_id"]).groupBy("request", "solve", "start").agg(F.min(F.struct((F.col("at") + F.col("egress")).alias("at"), "round", "stop_id", "egress")).alias("b"))
    found = _not_bettered(ends.select("request", "solve", "start", "b.*"), ["request"])
    out = F.struct(*_leg(type=F.lit("transfer"), from_stop=F.col("stop_id"), duration_seconds=F.col("egress")))
    legs = F.when(F.col("egress") > 0, F.array(out)).otherwise(F.array().cast(f"array<{LEG}>"))
    rows = found.select("request", "solve", "start", "at", "round", "stop_id", F.lit(None).cast("long").alias("first_board"), legs.alias("legs"))
    for n in range(len(rounds), 0, -1):
        ride = F.struct(*_leg(type=F.lit("transit"), from_stop=F.col("board_stop"), to_stop=F.col("ride_stop"), trip_id=F.col("trip_id"), route_id=F.col("route_id"), headsign=F.col("headsign"),
                              depart=F.col("board_at"), arrive=F.col("ride_at"), num_stops=F.col("seq") - F.col("board_seq")))
        walk = F.struct(*_leg(type=F.lit("transfer"), from_stop=F.col("ride_stop"), to_stop=F.col("stop_id"), duration_seconds=F.col("walk")))
        steps = F.when(F.col("walk").isNull(), F.array(ride)).otherwise(F.array(ride, walk))
        here = rows.where(F.col("round") == n).join(rounds[n - 1].select("solve", "stop_id", "start", *RIDE), ["solve", "stop_id", "start"])
        here = here.select("request", "solve", "start", "at", F.lit(n - 1).alias("round"), F.col("board_stop").alias("stop_id"), F.col("board_at").alias("first_board"), F.concat(steps, "legs").alias("legs"))
        rows = rows.where(F.col("round") != n).unionByName(here)
    lead = F.col("first_board") - F.col("start")
    to = F.struct(*_leg(type=F.lit("transfer"), to_stop=F.col("stop_id"), duration_seconds=lead.cast("int")))
    legs = F.when(lead > 0, F.concat(F.array(to), "legs")).otherwise(F.col("legs"))
    return rows.select("request", "start", "at", "first_board", merged_walks(legs).alias("legs"))


def _leg(**have) -> list:
    names = [x.split(": ") for x in LEG.removeprefix("struct<").removesuffix(">").split(", ")]
    return [have.get(n, F.lit(None)).cast(k).alias(n) for n, k in names]


def merged_walks(legs):
    """Runs of transfer legs as one leg each, but for those that lead back to their stop."""

    def join(done, leg):
        before = F.try_element_at(done, F.lit(-1))
        one = before.withField("to_stop", leg["to_stop"]).withField("duration_seconds", before["duration_seconds"] + leg["duration_seconds"])
        both = (before["type"] == "transfer") & (leg["type"] == "transfer")
        return F.when(F.coalesce(both, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(leg)))

    merged = F.aggregate(legs, F.array().cast(f"array<{LEG}>"), join)
    return F.filter(merged, lambda leg: F.coalesce((leg["type"] != "transfer") | (leg["from_stop"] != leg["to_stop"]), F.lit(True)))


#: One answer after another, in order of their starts: the first that starts after the
#: boarding of the one before is what a search from then on would find. It ends the
#: picking if it comes too late, or if walking all the way is as fast. Starts later than
#: those searched may have a better one if it is there after the last of them; ``need`` is
#: then the time up to which starts must be known to tell.
_AGAIN = "IF(array_contains(a.kinds, x.kind), a.repeats + 1, 0)"
_KINDS = "array_union(a.kinds, array(x.kind))"


def _state(**new: str) -> str:
    """The picking's state ``a`` with some of it changed."""
    return "named_struct(" + ", ".join(f"'{k}', {new.get(k, f'a.{k}')}" for k in ("board", "tries", "repeats", "kinds", "picks", "done", "need")) + ")"


_START = _state(board="since - 1", tries="0", repeats="0", kinds="cast(array() AS array<string>)", picks="cast(array() AS array<bigint>)", done="since IS NULL", need="cast(NULL AS bigint)")
_PICK = f"""aggregate(found, {_START}, (a, x) -> CASE WHEN a.done OR x.start <= a.board THEN a
    WHEN NOT arrive_by AND least(x.at, a.board + 1 + direct, a.board + 1 + {HORIZON}) > last THEN {_state(done="true", need=f"least(x.at, a.board + 1 + direct, a.board + 1 + {HORIZON})")}
    WHEN x.at > a.board + 1 + {HORIZON} OR a.board + 1 + coalesce(direct, {HORIZON} * 9) <= x.at THEN {_state(done="true")}
    ELSE {_state(
        board="x.first_board", tries="a.tries + 1", repeats=_AGAIN, kinds=_KINDS, picks="array_append(a.picks, x.start)",
        done=f"a.tries + 1 >= IF(arrive_by, 4 * wanted + 8, 2 * wanted + 2) OR NOT arrive_by AND ({_AGAIN} >= 2 OR size({_KINDS}) >= wanted)",
    )} END,
    a -> named_struct('picks', a.picks, 'need', IF(NOT a.done AND NOT arrive_by AND least(a.board + 1 + direct, a.board + 1 + {HORIZON}) > last, least(a.board + 1 + direct, a.board + 1 + {HORIZON}), a.need)))"""  # fmt: skip


def _picked(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requests with the starts of those answers that are picked, and ``need``."""
    lists = found.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("start", "at", "first_board", S.route_signature(F.col("legs")).alias("kind")))).alias("found"))
    rows = requests.join(lists, "request", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start: long, at: long, first_board: long, kind: string>>")))
    earliest = F.col("when") - HORIZON
    anchor = F.get(F.filter("found", lambda x: x["start"] >= earliest), F.lit(0))
    reachable = anchor.isNotNull() & (F.col("direct").isNull() | (earliest + F.col("direct") > anchor["at"]))
    late = F.when(reachable, F.col("when") - (anchor["at"] - anchor["start"]) - SLACK)
    rows = rows.withColumn("since", F.when(F.col("arrive_by"), late).otherwise(F.col("when"))).withColumn("p", F.expr(_PICK))
    picks = F.when(F.col("arrive_by") & reachable & (F.size("p.picks") == 0), F.array(anchor["start"])).otherwise(F.col("p.picks"))
    return rows.select(*requests.columns, picks.alias("picks"), F.col("p.need").alias("need"))


def plan_trips(t, requests: DataFrame, access: DataFrame, egress: DataFrame, max_transfers: int = MAX_TRANSFERS, modes: list | None = None) -> DataFrame:
    """(request, k, depart, arrive, duration_seconds, transfers, legs): the itineraries of
    every request (request, when, arrive_by, wanted), best first.

    ``access`` and ``egress``: (request, stop_id, walk). Requests that have a column
    ``solve`` in common share a search: they have the same time, direction and access,
    which is then (solve, stop_id, walk). Of ways that arrive at the same time the one that
    starts last is told. ``legs`` are an array of ``LEG`` with the route's short name; a
    place that is no stop is null. A request without a way has no row."""
    if "solve" not in requests.columns:
        requests, access = requests.withColumn("solve", F.col("request")), access.withColumnRenamed("request", "solve")
    access, egress = (materialize(x, name) for x, name in ((access, "access"), (egress, "egress")))
    common = access.withColumnRenamed("walk", "_walk").join(requests.select("request", "solve"), "solve").join(egress, ["request", "stop_id"])
    direct = common.groupBy("request").agg(F.min(F.col("walk") + F.col("_walk")).alias("direct"))
    when, late = F.col("when"), F.col("arrive_by")
    # of many requests that share a search some need later starts
    shared = F.count("*").over(Window.partitionBy("solve")) > 1
    first, last = F.when(late, when - HORIZON - SLACK).otherwise(when), F.when(late, when).otherwise(when + F.when(shared, HORIZON).otherwise(SPAN))
    asked = requests.select("request", "solve", "when", "arrive_by", "wanted", first.alias("first"), last.alias("last"), F.when(late, when).alias("until"))
    asked = materialize(asked.join(direct, "request", "left"), "requests")
    found, settled = None, []
    while True:
        alone = asked.groupBy("solve").agg(F.count("*").alias("n"), F.min("request").alias("request")).where("n = 1").select("solve", "request")
        spans = asked.select("solve", "first", "last", "until").dropDuplicates(["solve"])
        rounds = range_labels(t, access.join(spans.select("solve"), "solve", "left_semi"), spans, max_transfers, modes, egress.join(alone, "request").select("solve", "stop_id", "walk"))
        if rounds:
            new = answers(rounds, asked, egress)
            new = new if found is None else _not_bettered(found.join(asked, "request", "left_semi").unionByName(new), ["request"])
            found = materialize(new, "answers")
        if found is None:
            need = F.when(~F.col("arrive_by") & (F.col("last") < F.col("when") + HORIZON), F.col("when") + HORIZON)
            picked = asked.select(*asked.columns, F.array().cast("array<long>").alias("picks"), need.alias("need"))
        else:
            picked = _picked(asked, found)
        picked = materialize(picked, "picked")
        if found is not None:
            chosen = found.join(picked.where("need is null").select("request", "arrive_by", "wanted", "picks"), "request").where(F.array_contains("picks", F.col("start")))
            settled.append(chosen.select("request", "arrive_by", "wanted", "start", "at", "legs"))
        left = picked.where("need is not null")
        if left.isEmpty():
            break
        further = left.groupBy("solve").agg(F.greatest(F.max("need"), F.max("last") + SPAN).alias("further"))
        asked = left.drop("picks", "need").join(further, "solve").withColumn("first", F.col("last") + 1).withColumn("last", F.col("further")).drop("further")
    if not settled:
        return _ranked(t, t.stops.sparkSession.createDataFrame([], f"request long, arrive_by boolean, wanted int, start long, at long, legs array<{LEG}>"))
    return _ranked(t, reduce(DataFrame.unionByName, settled))


def _ranked(t, chosen: DataFrame) -> DataFrame:
    """One itinerary of each signature, the first found, in the order they are told."""
    kind, late = S.route_signature(F.col("legs")), F.col("arrive_by")
    one = Window.partitionBy("request", "kind").orderBy(F.when(late, -F.col("start")).otherwise(F.col("start")))
    best = Window.partitionBy("request").orderBy(F.when(late, -F.col("start")).otherwise(F.col("at")), F.col("at") - F.col("start"), "start")
    rows = chosen.withColumn("kind", kind).withColumn("n", F.row_number().over(one)).where("n = 1").withColumn("k", F.row_number().over(best)).where("k <= wanted")
    names = rows.select("request", "k", F.posexplode("legs").alias("i", "leg")).join(t.routes.select(F.col("route_id").alias("_route"), "route_short_name"), F.col("leg.route_id") == F.col("_route"), "left")
    legs = names.groupBy("request", "k").agg(F.array_sort(F.collect_list(F.struct("i", F.col("leg").withField("route_short_name", F.col("route_short_name")).alias("leg")))).alias("legs"))
    rides = F.size(F.filter("legs", lambda leg: leg["type"] == "transit"))
    told = rows.select("request", "k", F.col("start").alias("depart"), F.col("at").alias("arrive"), (F.col("at") - F.col("start")).alias("duration_seconds"), (rides - 1).alias("transfers"))
    return told.join(legs.select("request", "k", F.col("legs.leg").alias("legs")), ["request", "k"])
