"""Zipped timetable feeds: members to typed tables, and the whole ingest."""

from __future__ import annotations

import os
import tempfile
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import materialize
from ..functions import scalars as S
from ..operators.transfers import merge_transfers, overlay, pathway_transfers, station_transfers, street_transfers
from ..schemas import TABLES
from ..timetable import Timetable, check_keys
from . import feedsource

#: table -> (member, {column: column of the file}); stop_times last, as the largest.
FIRST_FEED = {
    "calendar": ("calendar.txt", {}), "calendar_dates": ("calendar_dates.txt", {}), "routes": ("routes.txt", {}), "stops": ("stops.txt", {}),
    "trips": ("trips.txt", {}), "stop_times": ("stop_times.txt", {"arr": "arrival_time", "dep": "departure_time"}),
}
SECOND_FEED = {"levels": ("levels.txt", {}), "pathways": ("pathways.txt", {})}


def download(url: str) -> str:
    """A local copy of a feed; any answer but success raises."""
    with urllib.request.urlopen(url, timeout=60) as got:
        handle, path = tempfile.mkstemp(suffix=".zip")
        with os.fdopen(handle, "wb") as out:
            while block := got.read(1 << 20):
                out.write(block)
    return path


def extract(zip_path: str, member: str, folder: str) -> str:
    """Put one member into ``folder``, which executors must see; missing raises."""
    with zipfile.ZipFile(zip_path) as z:
        if member not in z.namelist():
            raise FileNotFoundError(f"{member} is not in {zip_path}")
        return z.extract(member, folder)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-keyed, all strings; empty lines and a byte order mark are dropped. Records
    are lines, so that a large file is split, unless a quoted text goes over a line end:
    a first pass counts lines with an odd number of quotes."""
    odd = spark.read.text(path).where(F.length("value") % 2 != F.length(F.replace("value", F.lit('"'), F.lit(""))) % 2)
    return spark.read.option("header", True).option("multiLine", not odd.isEmpty()).option("escape", '"').csv(path)


def typed(raw: DataFrame, table: str, names: dict) -> DataFrame:
    """The declared columns of a table. A column the file has not is null, except a
    stop's name, which is empty; a blank text cell is empty, a blank number null."""
    out = []
    for part in TABLES[table].split(", "):
        name, kind = part.split()
        source = names.get(name, name)
        if source not in raw.columns:
            out.append((F.lit("") if name == "stop_name" else F.lit(None)).cast(kind).alias(name))
            continue
        x = F.col(f"`{source}`")
        if kind == "string":
            value = F.coalesce(x, F.lit(""))
        elif name in ("arr", "dep"):
            value = S.clock_seconds(x)
        else:
            value = (S.to_real(x) if kind == "double" else S.to_int(x)).cast(kind)
        out.append(value.alias(name))
    return raw.select(*out)


def read_member(spark: SparkSession, zip_path: str, member: str) -> DataFrame:
    """A member of a zip file, inflated by the task that reads it; see ``feedsource.ZipSource``."""
    feedsource.register(spark)
    return spark.read.format(feedsource.ZIP).options(path=zip_path, member=member).load()


def read_feed(spark: SparkSession, zip_path: str, tables: dict) -> dict:
    """The typed tables of a feed, each inflated once and stored."""
    out = {}
    for table, (member, names) in tables.items():
        df = materialize(typed(read_member(spark, zip_path, member), table, names), f"feed-{table}")
        check_keys(table, df)
        out[table] = df
    return out


def ingest(spark: SparkSession, first_zip: str, second_zip: str, target: str) -> dict:
    """Rebuild every table under ``target``; returns rows by table. The zip files lie where
    driver and executors see them, as a folder that both share."""
    a = read_feed(spark, first_zip, FIRST_FEED)
    b = read_feed(spark, second_zip, SECOND_FEED | {"stops": ("stops.txt", {})})
    stops, crosswalk = overlay(a["stops"], b["stops"])
    every = merge_transfers(station_transfers(stops), pathway_transfers(stops, b["pathways"]), street_transfers(stops))
    t = Timetable(stops, a["routes"], a["calendar"], a["calendar_dates"], a["trips"], a["stop_times"], every, crosswalk, b["levels"], b["pathways"])
    t.write(target)
    kept = Timetable.read(spark, target)
    return {name: getattr(kept, name).count() for name in TABLES}
