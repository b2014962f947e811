"""Vector best-fit packing of token pieces into training sequences.

An item is a piece of a document; its vector is (tokens, documents, attention
cost) = (length, 1, length squared), so it depends on its length alone. A bin is a
sequence with a capacity in each dimension. Items are taken longest first; among
the open bins in which the item fits under every constraint the one with the
least weighted residual norm (or the largest weighted dot product of item and
residual) takes it.

There are at most ``max_tokens`` kinds of item however large the corpus is, so the
driver packs counts: all bins with the same content are one class, and a step
places as many equal items as there are bins in the chosen class. Each piece then
looks up its place by its rank among the pieces of its length, which is computed
from salted ranks and per-salt offsets, so that one very common length does not
land in one task.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, id_in, id_out, materialize, tasks_for
from .units import as_texts, library_units


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. ``rule``: "norm" or "dot"; weights are per
    dimension, in units of its capacity."""

    max_tokens: int = 2048
    max_docs: int = 2048
    max_cost: int = 2048 * 2048
    weights: tuple = (1.0, 0.25, 0.25)
    rule: str = "norm"


def plan_bins(counts: dict, capacity: Capacity) -> list:
    """[(lengths with multiplicity as [(length, times), ...], number of bins)].

    ``counts``: number of pieces by length, 1 to ``max_tokens``.
    """
    full = np.array([capacity.max_tokens, capacity.max_docs, capacity.max_cost], dtype=np.int64)
    weights = np.array(capacity.weights, dtype=np.float64)
    bins_of: dict = {}  # content of open bins -> their number
    rest_of: dict = {}  # content -> what is left in each dimension
    closed: dict = {}
    smallest = min(counts, default=1)

    def worth(rest: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Least first."""
        if capacity.rule == "dot":
            return -((item / full) * (rest / full) * weights).sum(axis=-1)
        return (((rest - item) / full) ** 2 * weights).sum(axis=-1)

    def put(content: tuple, n: int, rest: np.ndarray) -> None:
        if rest[0] < smallest or rest[1] < 1 or rest[2] < smallest * smallest:
            closed[content] = closed.get(content, 0) + n
        else:
            bins_of[content] = bins_of.get(content, 0) + n
            rest_of[content] = rest

    def grown(content: tuple, length: int, k: int) -> tuple:
        if content and content[-1][0] == length:
            return (*content[:-1], (length, content[-1][1] + k))
        return (*content, (length, k))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        item = np.array([length, 1, length * length], dtype=np.int64)
        if length < 1 or (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        contents = list(rest_of)
        rests = np.array([rest_of[c] for c in contents], dtype=np.int64).reshape(-1, 3)
        open_ = np.flatnonzero((rests >= item).all(axis=1))
        fits = [(w, contents[i]) for w, i in zip(worth(rests[open_], item).tolist(), open_.tolist())]
        heapq.heapify(fits)
        while left:
            if fits:
                _, content = heapq.heappop(fits)
                rest, bins = rest_of.pop(content), bins_of.pop(content)
            else:  # new bins
                content, rest, bins = (), full, left
            # by residual norm a bin that got an item is the best for the next as well
            times = int((rest // item).min()) if capacity.rule == "norm" or not content else 1
            whole, over = divmod(left, times)
            moves = [(min(bins, whole), times)]
            if over and whole < bins:
                moves.append((1, over))
            for n, k in moves:
                if n:
                    new = grown(content, length, k)
                    put(new, n, rest - item * k)
                    left -= n * k
                    bins -= n
                    if capacity.rule == "dot" and new in rest_of and (rest_of[new] >= item).all():
                        heapq.heappush(fits, (float(worth(rest_of[new], item)), new))
            if content and bins:
                put(content, bins, rest)
                if left:
                    raise AssertionError("a bin that fits was passed over")
    for content, n in bins_of.items():
        closed[content] = closed.get(content, 0) + n
    return sorted(closed.items())


def slot_table(plan: list) -> dict:
    """length -> arrays (first rank, bins, first sequence, offset, times): ranks
    first + k * bins + b go to the k-th of ``times`` places of bin b."""
    table: dict = {}
    sequence = 0
    for content, bins in plan:
        offset = 0
        for length, times in content:
            rows = table.setdefault(length, [])
            first = rows[-1][0] + rows[-1][1] * rows[-1][4] if rows else 0
            rows.append((first, bins, sequence, offset, times))
            offset += length * times
        sequence += bins
    return {k: np.array(v, dtype=np.int64).T for k, v in table.items()}


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    max_tokens: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
    room: int = 6,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``,
    cut only where it is longer than ``max_tokens``. Null text is empty, so that a
    document has one token at least; a null id stays null; repeated rows are
    documents of their own. Other columns are not read."""
    rows = bounded_batches(docs).select(id_in(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def cut(batches):
        encoder = library_units(tokenizer_path, False, room)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, values in zip(batch["doc_id"].tolist(), encoder.texts(as_texts(batch["text"]))):
                ids = b"".join(values) + end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    made = rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", id_out("doc_id"))


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces with sequence_id and offset; in every sequence the pieces lie
    gapless from 0 and all capacities hold. ``pieces`` needs a column length; its
    other columns are kept. Empty input gives empty output."""
    spark = pieces.sparkSession
    # with at most max_tokens lengths, the table of counts by length and salt is bounded
    salts = min(1024, max(16, tasks_for(spark)))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # equal pieces may swap places, so the salt only has to spread one length evenly
    keyed = pieces.select(*columns, F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int").alias("_salt"))
    keyed = materialize(keyed, "pieces")
    per_salt = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    per_salt = materialize(per_salt, "piece-counts")
    # one row per length, at most max_tokens of them
    counts = {x["length"]: x["n"] for x in per_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = slot_table(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy(*columns)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_salt"])
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_before")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ids = [c for c, kind in ranked.dtypes if kind == "bigint" and c not in ("sequence_id", "offset", "length")]
    ranked = ranked.withColumns({c: id_in(c) for c in ids})
    shared = spark.sparkContext.broadcast(slots)

    def place(batches):
        table = shared.value
        for batch in batches:
            rank, length = batch["sequence_id"].to_numpy().astype(np.int64), batch["length"].to_numpy().astype(np.int64)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for rows in np.split(order, bounds[1:]):
                if not len(rows):
                    continue
                n = int(length[rows[0]])
                first, bins, base, at, _ = table[n]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                inner = rank[rows] - first[k]
                sequence[rows] = base[k] + inner % bins[k]
                offset[rows] = at[k] + inner // bins[k] * n
            yield batch.assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, ranked.schema).withColumns({c: id_out(c) for c in ids})


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: Capacity = Capacity(), room: int = 6
) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece. ``room``: see
    ``UnitEncoder``."""
    return pack_pieces(token_pieces(docs, tokenizer_path, end_id, capacity.max_tokens, room=room), capacity)
