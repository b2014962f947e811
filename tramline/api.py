"""The query surface: arguments checked, answers as plain values or JSON."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import catalog, realtime, routing, schedule
from .schemas import FARES_NOTE, FARES_PAGE, TRANSFER_RULE, TRANSFER_WINDOW_MINUTES


class QueryError(Exception):
    """``code``: invalid_argument, not_found, no_results or upstream_unavailable."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _id(value, name: str) -> int:
    text = str(value).strip()
    if not text.lstrip("-").isdigit():
        raise QueryError("invalid_argument", f"{name} must be a whole number")
    return int(text)


def _limit(value: int, top: int) -> int:
    if not 1 <= value <= top:
        raise QueryError("invalid_argument", f"limit must be from 1 to {top}")
    return value


def present(row: dict) -> dict:
    """Without what is null or empty text; ids as strings."""
    return {k: str(v) if k.endswith("_id") else v for k, v in row.items() if v is not None and v != ""}


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


class Engine:
    def __init__(self, timetable, feeds=None, clock=lambda: int(dt.datetime.now(dt.timezone.utc).timestamp())):
        self.t, self.feeds, self.clock = timetable, feeds, clock
        self.spark = timetable.stops.sparkSession

    def _snapshot(self, name: str):
        if self.feeds is None:
            raise QueryError("upstream_unavailable", "no realtime feed")
        try:
            return self.feeds.snapshot(name)
        except Exception as e:
            raise QueryError("upstream_unavailable", str(e)) from e

    def search_stops(self, query: str | None = None, near=None, radius: float = 500, mode: str | None = None, limit: int = 20, wildcards: bool = False) -> dict:
        """By name if given, else by place."""
        _limit(limit, 20)
        if query:
            found = catalog.search_by_name(self.t, query, mode, limit, wildcards)
        elif near:
            found = catalog.search_near(self.t, near[0], near[1], radius, mode, limit).drop("metres")
        else:
            raise QueryError("invalid_argument", "query or near is needed")
        rows = [x.asDict() for x in found.collect()]
        return {"stops": [present({k: v for k, v in x.items() if k != "truncated"}) for x in rows], "truncated": any(x["truncated"] for x in rows)}

    def stop(self, stop_id) -> dict:
        row = catalog.stop_detail(self.t, _id(stop_id, "stop_id")).first()
        if row is None:
            raise QueryError("not_found", f"no stop {stop_id}")
        return present(row.asDict(recursive=True))

    def routes(self, mode: str | None = None) -> list:
        return [present(x.asDict()) for x in catalog.list_routes(self.t, mode).collect()]

    def route(self, route_id, cap: int = 50) -> dict:
        number = _id(route_id, "route_id")
        row = catalog.list_routes(self.t).where(F.col("route_id") == number).first()
        if row is None:
            raise QueryError("not_found", f"no route {route_id}")
        stops = [x.asDict() for x in catalog.route_stops(self.t, cap).where(F.col("route_id") == number).orderBy("direction_id", "position").collect()]
        ways = [x.asDict() for x in catalog.route_directions(self.t).where(F.col("route_id") == number).orderBy("direction_id").collect()]
        return present(row.asDict()) | {"directions": ways, "stops_by_direction": stops, "truncated": any(x["truncated"] for x in stops)}

    def next_departures(self, stop_id, when: int | None = None, route_id=None, limit: int = 20) -> dict:
        stop = self.stop(stop_id)
        route = None if route_id is None else _id(route_id, "route_id")
        asked = self.spark.createDataFrame([(0, int(stop["stop_id"]), self.clock() if when is None else when)], "request_id long, stop_id long, when long")
        rows = [x.asDict() for x in schedule.next_departures(self.t, asked, _limit(limit, 20), route).orderBy("k").collect()]
        hint = schedule.schedule_hint(rows, route is not None)
        names = ("route_id", "route_short_name", "headsign", "direction_id", "scheduled_time", "platform_stop_id")
        out = {"departures": [{"headsign": x["headsign"]} | present({k: x[k] for k in names}) for x in rows], "truncated": bool(rows and rows[0]["truncated"])}
        return out | ({"hint": hint} if hint else {})

    def arrivals(self, stop_id, route_id=None, limit: int = 20) -> dict:
        """Predicted where the feed has any for the stop, else scheduled; a subway
        station has no predictions, and a feed that fails is no error here."""
        stop = self.stop(stop_id)
        if stop["mode"] != "subway":
            try:
                ids = stop["platforms"] if stop["is_station"] else [int(stop["stop_id"])]
                ids = ids or [int(stop["stop_id"])]
                asked = self.spark.createDataFrame([(ids[0], i) for i in ids], "asked long, stop_id long")
                route = None if route_id is None else str(_id(route_id, "route_id"))
                found = realtime.predicted_arrivals(self.t, self._snapshot("trips"), asked, self.clock(), route, _limit(limit, 20)).orderBy("at", "n").collect()
                if found:
                    names = ("route", "route_short_name", "headsign", "direction_id", "time", "realtime", "source")
                    rows = [{("route_id" if k == "route" else k): x[k] for k in names} for x in found]
                    return {"stop": stop, "arrivals": [{"headsign": x["headsign"]} | present(x) for x in rows], "realtime_available": True, "truncated": found[0]["truncated"]}
            except QueryError as e:
                if e.code != "upstream_unavailable":
                    raise
        plan = self.next_departures(stop_id, None, route_id, limit)
        names = ("route_id", "route_short_name", "headsign", "direction_id")
        rows = [{k: x[k] for k in names if k in x} | {"time": x["scheduled_time"], "realtime": False, "source": "scheduled"} for x in plan["departures"]]
        return {"stop": stop, "arrivals": rows, "realtime_available": False, "truncated": plan["truncated"]} | ({"hint": plan["hint"]} if "hint" in plan else {})

    def vehicles(self, route_id, limit: int = 50) -> dict:
        route = self.route(_id(route_id, "route_id"))
        if route["mode"] == "subway":
            return {"route_id": str(route_id), "vehicles": [], "realtime_available": False, "truncated": False, "note": "Subway trains have no positions in the feed."}
        found = realtime.vehicles_for_route(self._snapshot("vehicles"), str(route_id), self.clock(), _limit(limit, 50))
        return {"route_id": str(route_id), "realtime_available": True} | self._in_order(found, "vehicles")

    def alerts(self, mode=None, route_id=None, stop_id=None, category=None, limit: int = 50) -> dict:
        found = realtime.alerts(self.t, self._snapshot("alerts"))
        return self._in_order(realtime.matching_alerts(found, mode, route_id, stop_id, category, _limit(limit, 50)), "alerts")

    @staticmethod
    def _in_order(found, name: str) -> dict:
        rows = [x.asDict(recursive=True) for x in found.orderBy("position").collect()]
        return {name: [present({k: v for k, v in x.items() if k not in ("position", "truncated")}) for x in rows], "truncated": any(x["truncated"] for x in rows)}

    def fares(self, category=None, fare_type=None) -> dict:
        rows = [x.asDict() for x in realtime.fares(self.spark, category, fare_type).collect()]
        return {"fares": rows, "transfer": {"window_minutes": TRANSFER_WINDOW_MINUTES, "rules": TRANSFER_RULE}, "notes": FARES_NOTE, "source_url": FARES_PAGE}

    def _catalog(self, name: str):
        known = {"stops": lambda: catalog.stop_summaries(self.t).orderBy("stop_id"), "routes": lambda: catalog.list_routes(self.t), "fares": lambda: realtime.fares(self.spark)}
        if name not in known:
            raise QueryError("not_found", f"no resource {name}")
        return catalog.as_json(known[name]())

    def write_resource(self, name: str, folder: str) -> None:
        """The whole catalog of stops or routes, or the fares, as files of a JSON object a
        line, written where it is worked out."""
        self._catalog(name).write.text(folder)

    def resource(self, name: str) -> str:
        """The same as one JSON text, which an answer must be: rows are made JSON where they
        are and come a partition at a time."""
        if name == "fares":
            return to_json(self.fares())
        return f"[{', '.join(x['value'] for x in self._catalog(name).toLocalIterator())}]"

    def plan_trip(self, origin, destination, when: dt.datetime, **options) -> dict:
        got = routing.plan_trip(self.t, origin, destination, when, **options)
        if got.get("error"):
            raise QueryError(got["error"], f"nothing found ({got.get('endpoint', 'trip')})")
        return got


__all__ = ["Engine", "QueryError", "present", "to_json", "S"]
