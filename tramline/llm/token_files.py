"""Token-id files with Elias-Fano document boundaries.

One file holds the ids of a run of documents, concatenated, and the end offset of
every document. Offsets only grow, so each is split: its low bits stand side by
side, its high bits are written in unary (one set bit per document, at high part +
rank), about two bits plus the low bits per document in all. Every
``SAMPLE``-th set bit's place is kept too, so select(k) looks at a few bytes of
the bit vector and no table of 64-bit offsets is needed.

Layout, little-endian: magic, version, id width in bytes, low bits, documents,
ids, bytes of the four sections (doc_ids, samples, high bits, low bits), then these
sections and the ids. Ids take two bytes where the vocabulary allows, else four.
Doc ids are stored as first id, and gaps in the least width that holds them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, bounded_batches, fresh_path, id_in, id_out, tasks_for
from .units import as_texts, library_tokenizer, library_units

MAGIC = b"TLEF0001"
HEAD = struct.Struct("<8sIIQQQQQQ")
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers, with select."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, dtype=np.uint8)
        marks[at] = 1
        high = np.packbits(marks, bitorder="little").tobytes()
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, bits, low.tobytes(), high, at[::SAMPLE].astype("<u8"))

    def select(self, k: int) -> int:
        """The k-th value."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7) << (at & 7)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first = k * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        low = chunk >> (first & 7) & ((1 << self.low_bits) - 1)
        return (place - k) << self.low_bits | low


def write_shard(doc_ids: np.ndarray, ends: np.ndarray, ids: bytes, width: int) -> list:
    """The bytes of one file, in parts."""
    index = EliasFano.build(ends)
    gaps = np.diff(doc_ids.astype(np.int64), prepend=doc_ids[:1].astype(np.int64))
    size = next(w for w in (1, 2, 4, 8) if not len(gaps) or int(gaps.max()) < 1 << (8 * w - (w == 8)))
    first = int(doc_ids[0]) if len(doc_ids) else 0
    names = struct.pack("<qB", first, size) + gaps.astype(f"<u{size}").tobytes()
    sections = [names, index.samples.tobytes(), index.high, index.low]
    head = HEAD.pack(MAGIC, width, index.low_bits, len(doc_ids), int(ends[-1]) if len(ends) else 0, *map(len, sections))
    return [head, *sections, ids]


@dataclass
class Shard:
    doc_ids: np.ndarray
    index: EliasFano
    ids: np.ndarray

    def bounds(self, k: int) -> tuple:
        """Where the k-th document's ids begin and end, by two selects."""
        return self.index.select(k - 1) if k else 0, self.index.select(k)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        first, last = self.bounds(k)
        return self.ids[first:last]


def read_shard(data: bytes) -> Shard:
    magic, width, bits, docs, total, *sizes = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at, parts = HEAD.size, []
    for n in sizes:
        parts.append(data[at : at + n])
        at += n
    first, size = struct.unpack_from("<qB", parts[0])
    gaps = np.frombuffer(parts[0], dtype=f"<u{size}", offset=9).astype(np.int64)
    index = EliasFano(docs, bits, parts[3], parts[2], np.frombuffer(parts[1], dtype="<u8"))
    return Shard(first + np.cumsum(gaps), index, np.frombuffer(data, dtype=f"<u{width}", count=total, offset=at))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, str]:
    """Encode whole texts, append ``end_id`` and write files in ascending id order.

    Returns the manifest (shard, path, start, n_docs, n_tokens) and the folder. The
    rows are range-partitioned by id and a hash of the text, so a hot source, group of
    copies or id does not matter, and each task streams its own files of bounded size.
    A retried task writes under a new name and only the finished task's names reach the
    manifest. Null text is empty; rows with a null id come before the others, in files
    of their own; rows that repeat an id stand next to each other, in order of the
    hash. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    width = 2 if library_tokenizer(tokenizer_path).get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else 4
    text = F.col(f"`{text_column}`").cast("string")
    rows = bounded_batches(docs).select(id_in(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    ordered = rows.repartitionByRange(tasks_for(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    limit = 64 << 20

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = library_units(tokenizer_path, True)
        end = np.array([end_id], dtype="<u4").tobytes()
        names, ends, parts, held, number = [], [], [], 0, 0
        filesystem, root = _open(folder)

        def flush():
            nonlocal names, ends, parts, held, number
            path = f"{root}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
            filesystem.create_dir(root, recursive=True)
            with filesystem.open_output_stream(path, compression=None) as out:
                for x in write_shard(np.array(names), np.array(ends), b"".join(parts), width):
                    out.write(x)
            row = (part, number, path, names[0], len(names), ends[-1])
            names, ends, parts, held, number = [], [], [], 0, number + 1
            return row

        made = []
        for batch in batches:
            for doc_id, values in zip(batch["doc_id"].tolist(), encoder.texts(as_texts(batch["text"]))):
                if names and (names[0] == NULL_ID) != (doc_id == NULL_ID):
                    made.append(flush())
                ids = np.frombuffer(b"".join(values) + end, dtype="<u4").astype(f"<u{width}").tobytes()
                names.append(doc_id)
                ends.append((ends[-1] if ends else 0) + len(ids) // width)
                parts.append(ids)
                held += len(ids)
                if held >= limit:
                    made.append(flush())
        if names:
            made.append(flush())
        yield pd.DataFrame(made, columns=["part", "number", "path", "first_doc", "n_docs", "n_tokens"]).astype(
            {"part": "int64", "number": "int64", "first_doc": "int64", "n_docs": "int64", "n_tokens": "int64"}
        )

    schema = "part long, number long, path string, first_doc long, n_docs long, n_tokens long"
    # a row per file of 64 MB of ids: the one table of files a reader needs anyway
    written = ordered.mapInPandas(write, schema).collect()
    start, manifest = 0, []
    for k, x in enumerate(sorted(written, key=lambda x: (x["part"], x["number"]))):
        manifest.append((k, x["path"], start, x["n_docs"], x["n_tokens"]))
        start += x["n_tokens"]
    return (
        spark.createDataFrame(manifest, "shard long, path string, start long, n_docs long, n_tokens long"),
        folder,
    )


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, found by
    select on the files' boundaries."""

    def read(batches):
        filesystem, _ = _open(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"].tolist()):
                with filesystem.open_input_stream(path, compression=None) as f:
                    shard = read_shard(f.read())
                out = []
                for k, doc_id in enumerate(shard.doc_ids.tolist()):
                    first, last = shard.bounds(k)
                    out.append((doc_id, start + first, last - first, zlib.crc32(shard.ids[first:last].astype("<u4").tobytes())))
                    if len(out) == 20_000 or k + 1 == len(shard.doc_ids):
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype("int64")
                        out = []

    spread = manifest.repartition(max(1, tasks_for(manifest.sparkSession)), "shard")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", id_out("doc_id"))
