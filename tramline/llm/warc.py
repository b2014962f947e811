"""WARC archives, written by a deterministic sharded writer.

Records stand in order of page id. The order is cut into shards at bounds that a sample
chosen by hash of the rows themselves gives, weighted by their bytes, so the same rows
make the same files on any cluster. A task streams one shard and starts another file when
the compressed bytes of the one at hand reach ``roll_bytes``. Headers, record ids and
digests are made anew from the row; every record is a gzip member of its own without a
time stamp. Files are written under temporary names; when all are there they get their
own names, and at last a manifest does, which readers go by.

Of rows with equal payloads of at least ``least_bytes`` the one that comes first is a
response and the others are revisits that name it. Which page that is comes from an
aggregation over digests; it reaches the writer as short rows that are sorted in front of
the page's own, so payloads are shuffled once and joined with nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, evaluated_once, fresh_path, materialize, tasks_for

#: Stands for a null id in the order of records: null ids come last.
LAST = (1 << 63) - 1
#: Rows of the sample that the shards' bounds come from, about so many.
SAMPLE_ROWS = 50_000
MOST_SHARDS = 8192
_NAMESPACE = uuid.UUID("6d1f3c1e-5a3b-5c52-9a55-0f2b7f5f3a11")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_MANIFEST = "path string, shard long, number long, first_page long, last_page long, records long, bytes long, sha256 string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _uri(text: str) -> str:
    """The text as a header's value: control characters and spaces by their codes."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record_id(page_id: int | None, url: str | None, digest: str, number: int) -> str:
    """The id of a page's record; ``number`` counts rows equal in id, url and payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, json.dumps([page_id, url, digest, number]))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, number: int, date: str, first: tuple | None = None) -> bytes:
    """A record as it is before compression; ``first`` (page id, url) makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest, number)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if first:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(*first, digest, 0)}")
        if first[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(first[1])}")
        lines.append(f"WARC-Refers-To-Date: {date}")
        if first[0] is not None:
            lines.append(f"X-Refers-To-Page-Id: {first[0]}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _shard_bounds(keys: DataFrame, shard_bytes: int) -> tuple[list, list]:
    """The first (id, hash) of every shard but the first. A row is in the sample when the
    hash of its key is below a share that grows with its bytes, so bounds lie about as
    many bytes apart, and depend on the rows alone."""
    n, total = keys.agg(F.count("*"), F.sum("size")).first()
    shards = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return [], []
    share = F.col("size") * (SAMPLE_ROWS / total) * float(1 << 63)
    drawn = keys.where(F.shiftrightunsigned(F.xxhash64("place", "hash", F.lit(7)), 1) < share)
    rows = sorted((x["place"], x["hash"]) for x in drawn.select("place", "hash").distinct().collect())  # SAMPLE_ROWS, about
    bounds = sorted({rows[k * len(rows) // shards] for k in range(1, shards)}) if rows else []
    return [x[0] for x in bounds], [x[1] for x in bounds]


def _shard_of(places: list, hashes: list):
    """A column function: the shard of a row's (place, hash)."""
    first, pairs = np.array(places, dtype=np.int64), list(zip(places, hashes))

    @F.pandas_udf("int")
    def shard(place: pd.Series, hashed: pd.Series) -> pd.Series:
        at = place.to_numpy()
        low, out = np.searchsorted(first, at, "left"), np.searchsorted(first, at, "right")
        for k in np.flatnonzero(low < out).tolist():  # a bound has this very id
            out[k] = bisect.bisect_right(pairs, (int(at[k]), int(hashed.iloc[k])))
        return pd.Series(out.astype(np.int32))

    return evaluated_once(shard)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 100,
    shard_bytes: int = 64 << 20,
    roll_bytes: int = 256 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Write one record a row and return the folder.

    Null payloads are empty, null urls have no target header, null ids come last and are
    a response only where no row with an id has the payload. Rows that share an id are
    ordered by hash of the payload and url; rows equal in id and payload are one response
    and revisits of it. An empty table gives a manifest without files. Other columns are
    not written. A folder that has a manifest is not written to. Shards are of
    ``shard_bytes`` of payload, or an 8192nd of all of it if that is more.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    files, root = _filesystem(folder)
    if files.get_file_info(f"{root}/manifest.jsonl").type.name != "NotFound":
        raise FileExistsError(f"{folder} has a manifest")
    payload = F.coalesce(F.col(f"`{payload_column}`").cast("string"), F.lit("")).cast("binary")
    own = F.col(f"`{id_column}`").cast("long")
    rows = bounded_batches(pages).select(F.coalesce(own, F.lit(LAST)).alias("place"), own.isNull().alias("none"), F.col(f"`{url_column}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("hash", F.xxhash64("payload"))
    keys = materialize(rows.select("place", "none", "url", "hash", F.length("payload").cast("long").alias("size"), F.unhex(F.sha2("payload", 256)).alias("digest")), "warc-keys")
    long = keys.where(F.col("size") >= least_bytes)
    firsts = long.groupBy("digest").agg(F.min(F.struct("place", "none", F.col("url").isNotNull().alias("told"), "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    verdicts = long.select("place", "none", "hash", "digest").join(firsts.select("digest", "first"), "digest")
    nothing = F.lit(None)
    both = rows.select("place", "none", "hash", F.lit(1).alias("kind"), "url", "payload", nothing.cast("binary").alias("digest"), F.lit(0).cast("long").alias("to_place"), F.lit(False).alias("to_none"), nothing.cast("string").alias("to_url"))
    both = both.unionByName(verdicts.select("place", "none", "hash", F.lit(0).alias("kind"), nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest",
                                            F.col("first.place").alias("to_place"), F.col("first.none").alias("to_none"), F.col("first.url").alias("to_url")))
    places, hashes = _shard_bounds(keys, shard_bytes)
    dealt = both.withColumn("shard", _shard_of(places, hashes)("place", "hash") if places else F.lit(0))
    dealt = dealt.repartitionById(len(places) + 1, F.col("shard")).sortWithinPartitions("shard", "place", "none", "hash", "kind", "url", "payload")

    def write(batches):
        made, out, state = [], None, {}
        at, firsts, seen = None, {}, {}

        def close():
            nonlocal out
            out.close()
            made.append((state["path"], state["temporary"], state["shard"], state["number"], state["first"], state["last"], state["records"], state["bytes"], state["hash"].hexdigest()))
            out = None

        def add(data):
            out.write(data)
            state["bytes"] += len(data)
            state["hash"].update(data)

        filesystem, top = _filesystem(folder)
        for batch in batches:
            for shard, place, none, hashed, kind, url, body, digest, *first in batch.itertuples(index=False, name=None):
                if (place, none, hashed) != at:
                    at, firsts, seen = (place, none, hashed), {}, {}
                if not kind:
                    firsts[digest.hex()] = first
                    continue
                if out is not None and (state["shard"] != shard or state["bytes"] >= roll_bytes):
                    close()
                if out is None:
                    number = state["number"] + 1 if state.get("shard") == shard else 0
                    name = f"{shard:06d}-{number:05d}.warc.gz"
                    state = {"shard": shard, "number": number, "path": name, "temporary": f"_temporary/{name}-{uuid.uuid4().hex}", "first": place, "records": 0, "bytes": 0, "hash": hashlib.sha256()}
                    filesystem.create_dir(f"{top}/_temporary", recursive=True)
                    out = filesystem.open_output_stream(f"{top}/{state['temporary']}", compression=None)
                    about = f"format: WARC File Format 1.1\r\nsoftware: tramline\r\nisPartOf: {name}\r\n".encode()
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
                    add(_member(info.encode() + about + b"\r\n\r\n"))
                told, page_id = hashlib.sha256(body).hexdigest(), None if none else place
                to, number = firsts.get(told), seen.get((told, url), 0)
                # the first of its payload is the response, and so is what has no other like it
                again = to is not None and ((to[0], bool(to[1])) != (place, bool(none)) or (told, None, "met") in seen)
                seen[(told, url)] = number + 1
                seen[(told, None, "met")] = 1
                add(_member(record(page_id, url, body, told, number, date, (None if to[1] else int(to[0]), to[2]) if again else None)))
                state["last"] = place
                state["records"] += 1
        if out is not None:
            close()
        names = ["path", "temporary", "shard", "number", "first_page", "last_page", "records", "bytes", "sha256"]
        yield pd.DataFrame(made, columns=names).astype({x: "int64" for x in ("shard", "number", "first_page", "last_page", "records", "bytes")})

    columns = ["shard", "place", "none", "hash", "kind", "url", "payload", "digest", "to_place", "to_none", "to_url"]
    # what the finished attempt of every task wrote: a row a file, as in the manifest
    written = dealt.select(*columns).mapInPandas(write, "path string, temporary string," + _MANIFEST.removeprefix("path string,")).collect()
    written.sort(key=lambda x: x["path"])
    if written:
        spark.createDataFrame(written).repartition(min(len(written), tasks_for(spark))).foreachPartition(_put_in_place(folder))
    files.create_dir(root, recursive=True)
    temporary = f"{root}/_manifest-{uuid.uuid4().hex}"
    with files.open_output_stream(temporary, compression=None) as out:
        for x in written:
            out.write((json.dumps({k: v for k, v in x.asDict().items() if k != "temporary"}) + "\n").encode())
    files.move(temporary, f"{root}/manifest.jsonl")
    return folder


def _put_in_place(folder: str):
    """Gives finished files their names; a task that is run again finds it done."""

    def rename(rows):
        filesystem, root = _filesystem(folder)
        for x in rows:
            there = filesystem.get_file_info(f"{root}/{x['temporary']}").type.name != "NotFound"
            if there:
                filesystem.move(f"{root}/{x['temporary']}", f"{root}/{x['path']}")
            elif filesystem.get_file_info(f"{root}/{x['path']}").size != x["bytes"]:
                raise FileNotFoundError(f"{folder}/{x['path']}")

    return rename


def _members(stream):
    """What each gzip member of a stream holds."""
    rest, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("archive ends within a record")
            return
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        else:
            rest = b""


def parse(data: bytes) -> tuple[dict, bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not as its header says")
    return headers, rest[:size]


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for every response and revisit in the files of the manifest: page_id,
    record_type, refers_to (a revisit's response), target_uri, payload_bytes,
    payload_digest and, if asked for, payload (a revisit's is null). A response whose
    digests are not those of its bytes is an error."""
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest.jsonl")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * with_payload

    def read(batches):
        filesystem, root = _filesystem(folder)
        for batch in batches:
            for path in batch["path"]:
                out, held = [], 0
                with filesystem.open_input_stream(f"{root}/{path}", compression=None) as f:
                    for data in _members(f):
                        headers, block = parse(data)
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{path}: {headers['warc-record-id']} is not what its digests say")
                        page, to = (None if (v := headers.get(k)) is None else int(v) for k in ("x-page-id", "x-refers-to-page-id"))
                        out.append((page, size, digest, kind, to, headers.get("warc-target-uri"), *[payload if kind == "response" else None] * with_payload))
                        held += len(payload) * with_payload + 200
                        if held > 4 << 20:
                            yield _frame(out, names)
                            out, held = [], 0
                if out:
                    yield _frame(out, names)

    spread = manifest.select("path").repartition(max(1, tasks_for(spark)), "path")
    return spread.mapInPandas(read, schema + ", payload binary" * with_payload)


def _frame(rows: list, names: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
