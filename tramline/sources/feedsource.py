"""Data sources: realtime snapshots, decoded where they are read, and members of zip files.

``spark.dataSource.register`` makes them known to a session; ``register`` does it for both.
"""

from __future__ import annotations

import csv
import io
import re
import time
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from . import realtime

FEED, ZIP = "tramline_feed", "tramline_zip"
_NUMBERED = re.compile(r"(\d+)\.pb$")


def register(spark: SparkSession) -> None:
    for source in (FeedSource, ZipSource):
        spark.dataSource.register(source)


def _place(path: str):
    """(file system, path in it) of an address or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _snapshots(folder: str) -> list:
    """The numbers of the recorded snapshots, ascending."""
    from pyarrow import fs

    system, root = _place(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m[1]) for x in found if (m := _NUMBERED.search(x.path)))


def record(folder: str, data: bytes) -> int:
    """Put a snapshot beside those recorded, under the next number, and return it. It comes
    in place whole, and one that cannot be read to its end is refused."""
    realtime.decode(data)
    system, root = _place(folder)
    number = max(_snapshots(folder), default=-1) + 1
    draft = f"{root}/.draft-{uuid.uuid4().hex}"
    system.create_dir(root, recursive=True)
    with system.open_output_stream(draft, compression=None) as out:
        out.write(data)
    system.move(draft, f"{root}/{number:08d}.pb")
    return number


class _Numbers(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Address(InputPartition):
    pass


def _rows(data: bytes, entity: str, number: int, width: int):
    """An entity a row in the feed's order, and before them one that stands for the
    snapshot itself, with null columns and position -1, so that an empty one is seen."""
    header = dict(realtime.fields(next((v for n, v in realtime.fields(data) if n == 1), b"")))
    yield (*[None] * width, -1, number, header.get(3))
    for k, row in enumerate(realtime.decode(data)[entity]):
        yield (*row, k, number, header.get(3))


class FeedSource(DataSource):
    """Entities of a feed: options ``entity`` (vehicles, trips, alerts), ``folder`` of
    recorded snapshots, ``url`` of a live one.

    Read as a batch it gives the newest recorded snapshot (``snapshots``: all), or, without
    a folder, one that a task fetches. Read as a stream it gives every recorded snapshot
    once; with a url too, the driver records one each ``ttl`` seconds, so a batch that is
    run again reads the same. What cannot be fetched, or is cut off, is not recorded, and
    the next trigger tries again. Columns: the entity's, ``position``, ``snapshot``, and the
    header's time ``made_at``; each snapshot has a row of its own with position -1."""

    @classmethod
    def name(cls) -> str:
        return FEED

    def schema(self) -> str:
        return f"{realtime.SCHEMAS[self.options['entity']]}, position long, snapshot long, made_at long"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options, len(schema.fields) - 3)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _FeedStream(self.options, len(schema.fields) - 3)


class _FeedReader(DataSourceReader):
    def __init__(self, options, width: int):
        self.entity, self.folder, self.url, self.width = options["entity"], options.get("folder"), options.get("url"), width
        self.every = options.get("snapshots") == "all"

    def partitions(self):
        if self.folder is None:
            return [_Address(self.url)]
        numbers = _snapshots(self.folder)
        return [_Numbers(n) for n in (numbers if self.every else numbers[-1:])]

    def read(self, partition):
        if isinstance(partition, _Address):
            yield from _rows(realtime.fetch(partition.value), self.entity, 0, self.width)
        elif partition is not None:  # as it is where there are none
            yield from _read_number(self.folder, self.entity, partition.number, self.width)


def _read_number(folder: str, entity: str, number: int, width: int):
    system, root = _place(folder)
    with system.open_input_stream(f"{root}/{number:08d}.pb", compression=None) as f:
        yield from _rows(f.read(), entity, number, width)


class _FeedStream(DataSourceStreamReader):
    def __init__(self, options, width: int):
        self.entity, self.folder, self.url, self.width = options["entity"], options["folder"], options.get("url"), width
        self.ttl, self.asked = float(options.get("ttl", 25)), None

    def initialOffset(self):  # noqa: N802
        return {"next": 0}

    def latestOffset(self):  # noqa: N802
        if self.url and (self.asked is None or time.monotonic() - self.asked >= self.ttl):
            self.asked = time.monotonic()
            try:
                record(self.folder, realtime.fetch(self.url))
            except (OSError, ValueError, IndexError):
                pass  # no snapshot this time
        return {"next": max(_snapshots(self.folder), default=-1) + 1}

    def partitions(self, start, end):
        return [_Numbers(n) for n in _snapshots(self.folder) if start["next"] <= n < end["next"]]

    def read(self, partition):
        yield from _read_number(self.folder, self.entity, partition.number, self.width)


class ZipSource(DataSource):
    """Rows of a member of a zip file: options ``path``, ``member``. A table of texts, named by
    its first line; empty lines and a byte order mark are dropped, a missing or empty cell
    is null. The driver reads the directory and the first line, a task inflates the member
    and hands on its rows as they come; nothing is put into a folder. A deflated member
    can't be split, so it is one task's."""

    @classmethod
    def name(cls) -> str:
        return ZIP

    def schema(self) -> StructType:
        with _member(self.options["path"], self.options["member"]) as lines:
            return StructType([StructField(x, StringType()) for x in next(csv.reader(lines), [])])

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"], self.options["member"], len(schema.fields))


class _member:  # noqa: N801
    """The member's lines, inflated as they are read."""

    def __init__(self, path: str, member: str):
        self.path, self.member = path, member

    def __enter__(self):
        system, root = _place(self.path)
        self.file = system.open_input_file(root)
        self.zip = zipfile.ZipFile(self.file)
        if self.member not in self.zip.namelist():
            self.__exit__()
            raise FileNotFoundError(f"{self.member} is not in {self.path}")
        return io.TextIOWrapper(self.zip.open(self.member), encoding="utf-8-sig", newline="")

    def __exit__(self, *_):
        self.zip.close()
        self.file.close()


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, member: str, width: int):
        self.path, self.member, self.width = path, member, width

    def read(self, partition):
        with _member(self.path, self.member) as lines:
            rows = csv.reader(lines)
            next(rows, None)
            for row in rows:
                if row:
                    cells = [x if x != "" else None for x in row[: self.width]]
                    yield tuple(cells + [None] * (self.width - len(cells)))
