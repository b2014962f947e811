"""Quartile bucket digests of documents.

Every window of five bytes gives six triplets, each hashed into one of 128
buckets. A digest holds the byte length on a logarithmic scale, two ratios of the
bucket counts' quartiles and, per bucket, the quartile its count lies in: 35
bytes, written in hex. Texts of fewer than five bytes are padded with zero bytes.

Two digests' difference adds up the steps between the buckets' quartiles (three
steps apart count six) and the length and ratio steps; ``likeness`` maps it to 1
for equal digests and 0 from ``DIFFERENCE_BOUND`` on.

Triplet counts add up over parts of a text, so the digest of a text whose tail is
replaced shares the counts of the head.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, bounded_batches, id_in, id_out, tasks_for
from .units import as_texts

BUCKETS = 128
WINDOW = 5
#: Positions of the triplets' second and third byte behind the first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
DIFFERENCE_BOUND = 256
_STEP = np.array([0, 1, 2, 6])
#: Bytes hashed at a time, and texts whose counts are held at a time.
_BLOCK, _TEXTS = 1 << 21, 4096


def _buckets(data: np.ndarray, k: int) -> np.ndarray:
    """Bucket of the k-th triplet at every window of ``data``."""
    i, j = TRIPLETS[k]
    n = len(data) - WINDOW + 1
    h = data[:n].astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= data[i : i + n].astype(np.uint32) * np.uint32(0x85EBCA77)
    h += data[j : j + n].astype(np.uint32) * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(25)


def triplet_counts(texts: list) -> np.ndarray:
    """Bucket counts, one row per text (bytes). Long texts go through in blocks."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) + WINDOW <= _BLOCK):
            size += len(texts[to]) + WINDOW
            to += 1
        if to == at + 1 and size > _BLOCK:
            one = np.frombuffer(texts[at], dtype=np.uint8)
            for b in range(0, len(one) - WINDOW + 1, _BLOCK):
                part = one[b : b + _BLOCK + WINDOW - 1]
                for k in range(len(TRIPLETS)):
                    out[at] += np.bincount(_buckets(part, k), minlength=BUCKETS)
        else:
            group = texts[at:to]
            lengths = np.array([len(t) for t in group], dtype=np.int64)
            data = np.frombuffer(b"".join(group), dtype=np.uint8)
            if len(data) >= WINDOW:
                owner = np.repeat(np.arange(len(group), dtype=np.uint32), lengths)
                n = len(data) - WINDOW + 1
                inside = owner[:n] == owner[WINDOW - 1 :]
                base = owner[:n][inside] * np.uint32(BUCKETS)
                total = np.zeros(len(group) * BUCKETS, dtype=np.int64)
                for k in range(len(TRIPLETS)):
                    total += np.bincount(base + _buckets(data, k)[inside], minlength=len(total))
                out[at:to] = total.reshape(-1, BUCKETS)
        at = to
    return out


def digests(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """35 bytes per text: length, ratios, quartiles of the buckets."""
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * i // 4 - 1][:, None] for i in (1, 2, 3))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6).astype(np.uint8)
    scale = np.minimum(255, np.round(8 * np.log2(np.asarray(lengths, dtype=np.float64) + 1)))
    top = np.maximum(q3[:, 0], 1)
    ratios = np.stack([q1[:, 0] * 63 // top, q2[:, 0] * 63 // top], axis=1)
    return np.concatenate([scale[:, None].astype(np.uint8), ratios.astype(np.uint8), packed], axis=1)


def fingerprints(texts: list) -> np.ndarray:
    """Digests of byte strings."""
    padded = [t if len(t) >= WINDOW else t.ljust(WINDOW, b"\0") for t in texts]
    return digests(triplet_counts(padded), np.array([len(t) for t in texts]))


def _quartiles(digest: np.ndarray) -> np.ndarray:
    packed = digest[:, 3:]
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(packed), BUCKETS)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between digests row by row; 0 for equal ones."""
    x, y = _quartiles(a).astype(np.int64), _quartiles(b).astype(np.int64)
    buckets = _STEP[np.abs(x - y)].sum(axis=1)
    head = np.abs(a[:, :3].astype(np.int64) - b[:, :3].astype(np.int64))
    return buckets + head[:, 0] + (head[:, 1] + head[:, 2]) // 4


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.minimum(difference(a, b), DIFFERENCE_BOUND) / DIFFERENCE_BOUND


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of whole texts; null text is empty, a null id stays
    null, repeated rows are kept. Other columns are not read."""
    rows = bounded_batches(docs).select(id_in(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            made = fingerprints([t.encode() for t in as_texts(batch["text"])])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [x.tobytes().hex() for x in made]})

    return rows.mapInPandas(run, "doc_id long, fingerprint string").withColumn("doc_id", id_out("doc_id"))


def with_next_text(docs: DataFrame, function, schema: str, id_column: str = "doc_id", text_column: str = "text"):
    """Run ``function(ids, texts, next_texts)`` over all rows in ascending
    (id, text) order, each with the text of the row after it; after the last
    comes the first.

    The ids' quantiles cut the rows into blocks; a block's first text is sent to
    the block before it as well, so that no block is ever put together with
    another, and a task streams its blocks in order. Texts travel compressed.
    """
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(id_in(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    tasks = tasks_for(spark)
    blocks = 4 * tasks
    ids = docs.select(id_in(f"`{id_column}`").alias("id")).where(F.col("id") != NULL_ID)
    cuts = ids.approxQuantile("id", [i / blocks for i in range(1, blocks)], 0.25 / blocks)
    cuts = sorted({int(c) for c in cuts})
    bound = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    def block_of(values):
        return np.searchsorted(bound.value, values, side="right")

    def least(batches):
        best: dict = {}
        for batch in batches:
            block = block_of(batch["id"].to_numpy())
            for b, i in zip(block.tolist(), batch["id"].tolist()):
                if b not in best or i < best[b]:
                    best[b] = i
        yield pd.DataFrame({"block": list(best), "id": list(best.values())}).astype("int64")

    heads = rows.select("id").mapInPandas(least, "block long, id long").groupBy("block").agg(F.min("id").alias("id"))
    # one row per block, as many as there are tasks times four
    first = {x["block"]: x["id"] for x in heads.collect()}
    order = sorted(first)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the first follows the last
    head_of = spark.sparkContext.broadcast((first, before))

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        heads, previous = head_of.value
        for batch in batches:
            block = block_of(batch["id"].to_numpy()).tolist()
            out = []
            for b, i, t in zip(block, batch["id"].tolist(), batch["text"]):
                z = squeeze(t.encode())
                out.append((b, 0, i, z))
                if heads[b] == i:
                    out.append((previous[b], 1, i, z))
            yield pd.DataFrame(out, columns=["block", "late", "id", "z"]).astype({"block": "int64", "late": "int32", "id": "int64"})

    dealt = rows.mapInPandas(deal, "block long, late int, id long, z binary")
    dealt = dealt.repartition(tasks, "block").sortWithinPartitions("block", "late", "id", "z")

    def walk(batches):
        expand = zstandard.ZstdDecompressor().decompress

        def sequence():
            for batch in batches:
                yield from zip(batch["block"].tolist(), batch["late"].tolist(), batch["id"].tolist(), batch["z"])

        held, size, last, closed = [], 0, None, None
        for b, late, i, z in sequence():
            if late and closed == b:
                continue  # rows that repeat the first id of the next block
            text = expand(z).decode()
            if last is not None:
                held.append((last[0], last[1], text))
                size += len(last[1])
                if len(held) >= 2000 or size >= 1 << 23:
                    yield function(*map(list, zip(*held)))
                    held, size = [], 0
            last, closed = (None, b) if late else ((i, text), None)
        if held:
            yield function(*map(list, zip(*held)))

    return dealt.mapInPandas(walk, schema)


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text: the last
    floor(n_chars / 2) code points replaced by the first as many of the next
    document's (or all it has). Null text is empty; null ids come first in the
    order and stay null; of rows that repeat an id the order is by compressed
    text; a single document is its own next. Other columns are not read."""

    def run(ids, texts, next_texts):
        size = [len(t) for t in texts]
        raw = [t.encode() for t in texts]
        edited = [(t[: n - n // 2] + x[: n // 2]).encode() for t, n, x in zip(texts, size, next_texts)]
        own = fingerprints(raw)
        # mostly the next document is the following row here
        after = np.roll(own, -1, axis=0)
        other = [k for k, x in enumerate(next_texts) if k + 1 == len(ids) or x is not texts[k + 1]]
        after[other] = fingerprints([next_texts[k].encode() for k in other])
        changed = fingerprints(edited)
        return pd.DataFrame(
            {
                "doc_id": ids,
                "n_chars": size,
                "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited],
                "fingerprint": [x.tobytes().hex() for x in own],
                "edited_fingerprint": [x.tobytes().hex() for x in changed],
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, after),
            }
        )

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return with_next_text(docs, run, schema, id_column, text_column).withColumn("doc_id", id_out("doc_id"))
