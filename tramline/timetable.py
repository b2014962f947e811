"""The static side: a bundle of DataFrames, and where it is stored.

A folder holds loads, each a set of tables that nothing changes any more, and numbered
versions, each a small file that names a load. A version is put in place by a rename that
fails if the number is taken, so readers find either all of a load or none of it, and of
two writers one wins. A reader's DataFrames are bound to its load's files; a load goes
only when it was replaced longer ago than a time of grace.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DERIVED, KEYS, TABLES

#: Seconds that a replaced load stays for those who read it.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer put its load in place meanwhile."""


@dataclass
class Timetable:
    stops: DataFrame
    routes: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    transfers: DataFrame
    rt_stop_crosswalk: DataFrame
    levels: DataFrame | None = None
    pathways: DataFrame | None = None
    #: What ``write`` stores besides, so that reading it back goes through stop times no
    #: more: the routes a stop is served by, platforms' for their station; the longest
    #: trip of every direction; the letter triples of stops' names; stops in order of
    #: their cells; each stop's departures, packed; and stop times again, bucketed by
    #: trip. None: worked out where it is needed, or done without.
    served: DataFrame | None = None
    canonical: DataFrame | None = None
    grams: DataFrame | None = None
    places: DataFrame | None = None
    boards: DataFrame | None = None
    runs: DataFrame | None = None
    #: Where walks are known by place: stops with their places (``transfers.stop_spots``) and
    #: the ways between places (``transfers.spot_ways``), instead of ``transfers``.
    spots: DataFrame | None = None
    spot_ways: DataFrame | None = None

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows) -> Timetable:
        """From lists of tuples, absent tables empty."""
        return cls(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()})

    @classmethod
    def read(cls, spark: SparkSession, folder: str, version: int | None = None) -> Timetable:
        """The load of a version, of the newest if none is given."""
        files = _Files(spark, folder)
        numbers = files.versions()
        if not numbers or version is not None and version not in numbers:
            raise FileNotFoundError(f"{folder} has no {'version' if version is None else f'version {version}'}")
        entry = files.entry(numbers[-1] if version is None else version)
        place = f"{folder}/{entry['load']}"
        tables = {name: spark.read.schema(schema).parquet(f"{place}/{name}") for name, schema in (TABLES | DERIVED).items()}
        return cls(**tables, runs=bucketed_runs(spark, place, entry["buckets"]))

    def write(self, folder: str, grace: float = GRACE) -> int:
        """Write a new load and return the number of the version that names it. A load that
        fails, or that another writer forestalled (``Conflict``), is removed and changes
        nothing. Stop times are clustered by stop and departure, packed departures and
        served routes by stop, so that row groups' bounds prune a stop's rows."""
        spark = self.stops.sparkSession
        files = _Files(spark, folder)
        number, load = max(files.versions(), default=-1) + 1, f"load-{uuid.uuid4().hex}"
        try:
            buckets = self._write_load(f"{folder}/{load}")
            if not files.put(number, {"load": load, "buckets": buckets}):
                raise Conflict(f"version {number} of {folder} is there already")
        except BaseException:
            files.delete(load)
            raise
        files.clean(number, grace)
        return number

    def _write_load(self, place: str) -> int:
        from .operators import catalog, schedule

        spark = self.stops.sparkSession
        # as many files as the session has tasks for a shuffle, however small they are
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def base(name: str) -> None:
            df = getattr(self, name)
            df = spark.createDataFrame([], TABLES[name]) if df is None else df
            if name == "stop_times":
                df = df.repartitionByRange(buckets, "stop_id", "dep").sortWithinPartitions("stop_id", "dep")
            df.write.parquet(f"{place}/{name}")

        _at_once([lambda name=name: base(name) for name in TABLES])
        stored = Timetable(**{name: spark.read.schema(schema).parquet(f"{place}/{name}") for name, schema in TABLES.items()})

        def served() -> None:
            catalog.served_routes(stored).repartitionByRange("stop_id").sortWithinPartitions("stop_id").write.parquet(f"{place}/served")

        def canonical() -> None:
            catalog.canonical_trips(stored).coalesce(1).write.parquet(f"{place}/canonical")

        def grams() -> None:
            catalog.name_grams(stored).repartitionByRange("gram", "stop_id").sortWithinPartitions("gram", "stop_id").write.parquet(f"{place}/grams")

        def places() -> None:
            # small pages, so that a search reads those that its ranges of cells touch
            rows = catalog.placed_stops(stored).repartitionByRange("cell", "stop_id").sortWithinPartitions("cell", "stop_id")
            rows.write.option("parquet.page.row.count.limit", 500).option("parquet.block.size", 1 << 20).parquet(f"{place}/places")

        def boards() -> None:
            rows = schedule.packed_departures(stored).select("stop_id", "route_id", "direction_id", "trip_headsign", "route_type", "departures")
            rows.repartitionByRange(buckets, "stop_id").sortWithinPartitions("stop_id", "route_id").write.parquet(f"{place}/boards")

        def runs() -> None:
            store_runs(stored.stop_times.repartition(buckets, "trip_id"), place, buckets)

        _at_once([boards, served, canonical, runs, grams, places])
        return buckets


def _at_once(jobs: list) -> None:
    """Runs jobs that wait for the cluster side by side; the first failure is raised."""
    with ThreadPoolExecutor(4) as pool:
        for x in [pool.submit(job) for job in jobs]:
            x.result()


def _table_name(place: str) -> str:
    return f"tramline_runs_{place.rsplit('-', 1)[1]}"


def store_runs(stop_times: DataFrame, place: str, buckets: int) -> None:
    """Stop times, dealt by trip to as many tasks, as a bucketed table of the load's files."""
    writer = stop_times.write.bucketBy(buckets, "trip_id").sortBy("trip_id", "stop_sequence")
    writer.format("parquet").option("path", f"{place}/runs").saveAsTable(_table_name(place))


def bucketed_runs(spark: SparkSession, place: str, buckets: int) -> DataFrame:
    """Stop times by trip. The session's catalog knows of the buckets, whose rows join
    and group by trip without an exchange; the files are the load's own."""
    name = _table_name(place)
    if not spark.catalog.tableExists(name):
        try:
            spark.sql(f"CREATE TABLE {name} ({TABLES['stop_times']}) USING parquet CLUSTERED BY (trip_id) SORTED BY (trip_id, stop_sequence) INTO {int(buckets)} BUCKETS LOCATION '{place}/runs'")
        except AnalysisException as e:  # another thread of this session was first
            if "ALREADY_EXISTS" not in str(e):
                raise
    return spark.table(name)


class _Files:
    """A folder's versions, through the file system that Spark has for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.hadoop, self.folder = spark, spark._jvm.org.apache.hadoop.fs, folder
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.hadoop.Path(folder).getFileSystem(self.conf)

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join((self.folder, *parts)))

    def _listed(self, path) -> list:
        return list(self.system.listStatus(path)) if self.system.exists(path) else []

    def versions(self) -> list:
        names = [x.getPath().getName() for x in self._listed(self._path("versions"))]
        return sorted(int(x) for x in names if x.isdigit())

    def entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(str(self._path("versions", f"{number:08d}")), wholetext=True).first()[0])

    def put(self, number: int, entry: dict) -> bool:
        """Whether the version's file is now ours."""
        draft, place = self._path("versions", f"draft-{uuid.uuid4().hex}"), self._path("versions", f"{number:08d}")
        out = self.system.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.hadoop.FileContext.getFileContext(self.system.getUri(), self.conf)
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(place), options)
        except Exception as e:
            self.system.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, load: str) -> None:
        self.system.delete(self._path(load), True)
        self.spark.sql(f"DROP TABLE IF EXISTS {_table_name(load)}")

    def clean(self, newest: int, grace: float) -> None:
        """Removes versions replaced more than ``grace`` seconds ago, and their loads. When
        a version was replaced is the time of the next one's file."""
        numbers = [n for n in self.versions() if n <= newest]
        times = {n: self.system.getFileStatus(self._path("versions", f"{n:08d}")).getModificationTime() / 1000 for n in numbers}
        now = max(times.values(), default=0)
        for number, following in zip(numbers, numbers[1:]):
            if now - times[following] >= grace:
                entry = self.entry(number)
                self.system.delete(self._path("versions", f"{number:08d}"), False)
                self.delete(entry["load"])


def check_keys(name: str, df: DataFrame) -> None:
    """Fail the load on a null or doubled key, as the tables declare them."""
    columns, unique = KEYS[name]
    null = df.where(" or ".join(f"{c} is null" for c in columns))
    if not null.isEmpty():
        raise ValueError(f"{name}: null in {', '.join(columns)}")
    if unique and not df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{name}: {', '.join(columns)} is not unique")

