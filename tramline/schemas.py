"""Declared schemas of the timetable tables, and constants."""

from __future__ import annotations

TABLES = {
    "stops": "stop_id long, stop_code long, stop_name string, stop_lat double, stop_lon double, parent_station long, location_type int",
    "routes": "route_id long, route_short_name string, route_long_name string, route_type int, route_color string",
    "calendar": "service_id long, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date int, end_date int",
    "calendar_dates": "service_id long, date int, exception_type int",
    "trips": "trip_id long, route_id long, service_id long, trip_headsign string, direction_id int, shape_id long",
    "stop_times": "trip_id long, stop_id long, stop_sequence int, arr int, dep int",
    "levels": "level_id string, level_index double, level_name string",
    "pathways": "pathway_id string, from_stop_id long, to_stop_id long, pathway_mode int, is_bidirectional int, traversal_time int, length double",
    "transfers": "from_stop_id long, to_stop_id long, min_walk_seconds int, type string",
    "rt_stop_crosswalk": "rt_stop_id long, stop_id long",
}
#: Tables that the load works out once, so that a search or a stop's detail does not go
#: through all stop times.
DERIVED = {
    "served": "stop_id long, route_id long, route_type int",
    "canonical": "route_id long, direction_id int, trip_id long, stop_count long",
    "grams": "gram string, stop_id long",
    "places": "cell long, " + TABLES["stops"],
    "boards": "stop_id long, route_id long, direction_id int, trip_headsign string, route_type int, departures map<long, array<struct<dep: int, trip_id: long, seq: int>>>",
}
#: Keys that must be there and, where ``unique``, once.
KEYS = {
    "stops": (("stop_id",), True), "routes": (("route_id",), True), "calendar": (("service_id",), True),
    "calendar_dates": (("service_id", "date", "exception_type"), False), "trips": (("trip_id",), True),
    "stop_times": (("trip_id", "stop_id", "stop_sequence"), False), "levels": (("level_id",), True),
    "pathways": (("from_stop_id", "to_stop_id"), False),
}

TIME_ZONE = "America/Toronto"
#: Best first, as a station's mode is the best of those that serve it.
MODES = ("subway", "streetcar", "bus")
MODE_OF_TYPE = {0: "streetcar", 1: "subway", 3: "bus"}
WALK_METRES_PER_SECOND = 1.3
EARTH_RADIUS = 6_371_000
STREET_RADIUS = 250
SEARCH_CAP, SEARCH_LIMIT, SCHEDULE_LIMIT, ARRIVALS_LIMIT = 200, 20, 20, 20
STOPS_PER_DIRECTION, FEED_LIMIT = 50, 50
MAX_TRANSFERS, MAX_ITINERARIES, DEFAULT_ITINERARIES, ACCESS_FAN_OUT = 3, 5, 3, 8
HORIZON_HOURS, SERVICE_DAY_HOURS = 6, 30
LOOKAHEAD_DAYS = 14

#: Fixed values of the public GTFS-realtime enumerations, by number.
CAUSES = {
    1: "unknown_cause", 2: "other_cause", 3: "technical_problem", 4: "strike", 5: "demonstration", 6: "accident",
    7: "holiday", 8: "weather", 9: "maintenance", 10: "construction", 11: "police_activity", 12: "medical_emergency",
}
EFFECTS = {
    1: "no_service", 2: "reduced_service", 3: "significant_delays", 4: "detour", 5: "additional_service",
    6: "modified_service", 7: "other_effect", 8: "unknown_effect", 9: "stop_moved", 10: "no_effect", 11: "accessibility_issue",
}
SEVERITIES = {1: "unknown_severity", 2: "info", 3: "warning", 4: "severe"}
OCCUPANCIES = {
    0: "empty", 1: "many_seats_available", 2: "few_seats_available", 3: "standing_room_only",
    4: "crushed_standing_room_only", 5: "full", 6: "not_accepting_passengers", 7: "no_data_available", 8: "not_boardable",
}
#: Category, fare type, price, currency.
FARES = [
    ("adult", "presto", 3.35, "CAD"), ("adult", "cash", 3.35, "CAD"), ("adult", "day_pass", 13.5, "CAD"),
    ("adult", "monthly", 156.0, "CAD"), ("senior", "presto", 2.3, "CAD"), ("senior", "monthly", 128.15, "CAD"),
    ("youth", "presto", 2.3, "CAD"), ("youth", "monthly", 128.15, "CAD"), ("child", "presto", 0.0, "CAD"),
]
#: What goes with every answer on fares.
TRANSFER_WINDOW_MINUTES = 120
TRANSFER_RULE = "One fare covers unlimited transfers across subway, streetcar, and bus for 2 hours from first tap (PRESTO or contactless)."
FARES_PAGE = "https://www.ttc.ca/fares-and-passes"
FARES_NOTE = "The table is kept by hand, as no machine-readable one is published, and fares change from time to time: see the official page."
