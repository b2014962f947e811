"""Data sources for snapshots and zip members, whole snapshots in a stream."""

import struct
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tests.test_timetable import _message
from tramline.sources import feedsource, gtfs
from tramline.sources import realtime as rt
from tramline.streaming.feeds import current_entities, read_latest


def _vehicle(number, lat, when):
    place = bytes([1 << 3 | 5]) + struct.pack("<f", lat) + bytes([2 << 3 | 5]) + struct.pack("<f", -79.25)
    return _message((1, str(number).encode()), (4, _message((1, _message((1, b"7"), (5, b"900"))), (2, place), (5, when), (8, _message((1, str(number).encode()))))))


def _snapshot(made, *vehicles):
    return _message((1, _message((1, b"2.0"), (3, made))), *[(2, _vehicle(*v)) for v in vehicles])


@pytest.fixture(scope="module")
def sources(spark):
    feedsource.register(spark)
    return spark


@pytest.fixture
def server():
    """Answers one after another; a number is a status."""
    answers, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            x = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(x if isinstance(x, int) else 200)
            self.end_headers()
            if not isinstance(x, int):
                self.wfile.write(x)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/vehicles", answers, asked
    http.shutdown()


def _read(spark, **options):
    return spark.read.format(feedsource.FEED).options(entity="vehicles", **options).load()


def test_recorded_snapshots(sources, tmp_path):
    folder = str(tmp_path / "feed")
    for k in range(3):
        assert feedsource.record(folder, _snapshot(100 + k, *[(v, 43.0 + k, 90 + k) for v in range(k)])) == k
    rows = _read(sources, folder=folder).orderBy("position").collect()
    assert [(x["position"], x["vehicle_id"], x["lat"], x["timestamp"], x["snapshot"], x["made_at"]) for x in rows] == [(-1, None, None, None, 2, 102), (0, "0", 45.0, 92, 2, 102), (1, "1", 45.0, 92, 2, 102)]
    assert _read(sources, folder=folder, snapshots="all").where("position >= 0").count() == 3
    assert sources.read.format(feedsource.FEED).options(entity="alerts", folder=folder).load().where("position >= 0").count() == 0
    # a message that is cut off is refused
    with pytest.raises((ValueError, IndexError)):
        feedsource.record(folder, _snapshot(1, (1, 43.0, 1))[:-5])
    assert _read(sources, folder=folder).count() == 3 and _read(sources, folder=str(tmp_path / "none")).count() == 0


def test_live_feed_read_by_a_task(sources, server):
    url, answers, asked = server
    answers += [503, _snapshot(5, (1, 43.5, 1))]
    assert [x["vehicle_id"] for x in _read(sources, url=url).where("position >= 0").collect()] == ["1"] and len(asked) == 2
    answers[:] = [429]
    with pytest.raises(Exception, match="429"):
        _read(sources, url=url).collect()
    assert len(asked) == 3  # too many requests are not answered by more


def _follow(spark, folder, out, **options):
    stream = spark.readStream.format(feedsource.FEED).options(entity="vehicles", folder=folder, **options).load()
    current_entities(stream, f"{out}/now", "vehicle_id", f"{out}/checkpoint", limit=60).awaitTermination()
    rows = {x["vehicle_id"]: (x["lat"], x["since"]) for x in read_latest(spark, f"{out}/now").collect()}
    return rows, {(x["vehicle_id"], x["change"]) for x in read_latest(spark, f"{out}/now-changes").collect()}


def test_a_vehicle_goes(sources, tmp_path):
    """Three whole snapshots, the second without a vehicle, the third with a late one; then
    an empty one; the stream goes on where it was."""
    folder, out = str(tmp_path / "feed"), str(tmp_path / "out")
    feedsource.record(folder, _snapshot(100, ("a", 43.5, 100), ("b", 43.5, 100), ("b", 44.0, 100)))
    assert _follow(sources, folder, out) == ({"a": (43.5, 0), "b": (43.5, 0)}, {("a", "new"), ("b", "new")})
    feedsource.record(folder, _snapshot(130, ("b", 45.0, 130), ("c", 43.5, 130)))
    assert _follow(sources, folder, out) == ({"b": (45.0, 0), "c": (43.5, 1)}, {("a", "gone"), ("b", "changed"), ("c", "new")})
    feedsource.record(folder, _snapshot(200, ("a", 43.5, 200), ("b", 45.0, 130), ("c", 43.5, 190)))
    assert _follow(sources, folder, out) == ({"a": (43.5, 2), "c": (43.5, 1)}, {("a", "new"), ("b", "gone"), ("c", "changed")})
    feedsource.record(folder, _snapshot(230))
    assert _follow(sources, folder, out) == ({}, {("a", "gone"), ("c", "gone")})


def test_live_stream_records_what_it_read(sources, server, tmp_path):
    url, answers, _ = server
    folder, out = str(tmp_path / "feed"), str(tmp_path / "out")
    answers.append(_snapshot(10, ("a", 43.5, 10)))
    assert _follow(sources, folder, out, url=url)[0] == {"a": (43.5, 0)}
    answers[:] = [_snapshot(20, ("z", 43.5, 20))[:-3]]  # cut off: what is known stays
    assert _follow(sources, folder, out, url=url)[0] == {"a": (43.5, 0)}
    answers[:] = [_snapshot(30, ("z", 43.5, 30))]
    assert _follow(sources, folder, out, url=url)[0] == {"z": (43.5, 1)} and feedsource._snapshots(folder) == [0, 1]


def test_zip_members(sources, tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "﻿a,b,c\r\n1,\"x, \"\"y\"\"\",\r\n\r\n2,\"two\nlines\"\r\n3,é,z,more\r\n")
        z.writestr("empty.txt", "")
        z.writestr("big.txt", "k,v\n" + "".join(f"{k},{k * k}\n" for k in range(100_000)))
    got = gtfs.read_member(sources, path, "x.txt")
    assert got.columns == ["a", "b", "c"] and [tuple(x) for x in got.collect()] == [("1", 'x, "y"', None), ("2", "two\nlines", None), ("3", "é", "z")]
    assert gtfs.read_member(sources, path, "big.txt").selectExpr("sum(cast(v as long))").first()[0] == sum(k * k for k in range(100_000))
    assert gtfs.read_member(sources, path, "empty.txt").count() == 0
    with pytest.raises(Exception, match="none.txt is not in"):
        gtfs.read_member(sources, path, "none.txt").count()
    assert rt.SCHEMAS.keys() == {"vehicles", "trips", "alerts"}
