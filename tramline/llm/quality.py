"""Importance resampling of documents.

Two generative models over hashed word and punctuation n-grams (n = 1, 2): one of
the target, fitted on a bounded sample of labelled good documents, and one of the
raw text, counted over every document; the target is smoothed towards the raw
model. A document's log weight is the mean log ratio of its n-grams times
``REFERENCE_LENGTH``, as if all documents had that many, so that length alone
neither saves nor condemns one; few n-grams pull the mean to zero. Adding
independent Gumbel noise and taking the k largest keys samples k documents without
replacement in proportion to the weights.

k is the number of documents whose log weight is at or above a boundary, the one
that parts the good of the labelled documents from the bad best; the noise then
decides which k are drawn.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NULL_ID, bounded_batches, evaluated_once, materialize
from .units import UnitEncoder, as_texts

BUCKETS = 1 << 16
REFERENCE_LENGTH = 100
#: Neutral n-grams added to every document's mean.
PRIOR_LENGTH = 50
_TOKENS = regex.compile(r"\w+|[^\w\s]+")
_UNITS: list = []


def _units() -> UnitEncoder:
    """Units' token hashes as bytes, cached over batches."""
    if not _UNITS:

        def encode(units: list) -> list:
            return [
                b"".join([xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t in _TOKENS.findall(u.lower())])
                for u in units
            ]

        _UNITS.append(UnitEncoder(encode, False, str.split))
    return _UNITS[0]


def _features(values: list) -> np.ndarray:
    """Buckets of a text's n-grams."""
    h = np.frombuffer(b"".join(values), dtype="<u8")
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7))
    pairs = pairs * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([h, pairs]) >> np.uint64(48)).astype(np.int64)


def _counts(docs: DataFrame) -> np.ndarray:
    """Bucket counts over all rows of ``text``, one row per bucket and task before
    they are summed."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for values in _units().texts(as_texts(batch["text"])):
                held.append(_features(values))
                size += len(held[-1])
                if size > 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return out


@dataclass
class ResamplingModel:
    """``ratio``: log target minus log raw probability by bucket; ``boundary``: the
    least key kept."""

    ratio: np.ndarray
    boundary: float


def _log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 5.0) -> np.ndarray:
    """``smoothing``: raw n-grams added to the target, per bucket."""
    q = (raw + 1) / (raw.sum() + BUCKETS)
    added = smoothing * BUCKETS
    return np.log((target + added * q) / (target.sum() + added)) - np.log(q)


def scored_column(spark: SparkSession, ratio: np.ndarray, doc_id, text, seed: int = 7):
    """struct(n_features, log_weight, gumbel_key) of columns ``doc_id`` and ``text``.

    The noise is a Gumbel variable drawn by a hash of the seed, the id and the text, so
    a retried task repeats it, and rows equal in both get equal keys. Null text is
    empty: log weight 0 on no features."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("n_features long, log_weight double, gumbel_key double")
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        weights, texts, out = shared.value, as_texts(texts), []
        for doc_id, text, values in zip(ids.tolist(), texts, _units().texts(texts)):
            buckets = _features(values)
            weight = log_weight(float(weights[buckets].sum()), len(buckets))
            out.append((len(buckets), weight, weight + gumbel(seed, doc_id, text)))
        return pd.DataFrame(out, columns=["n_features", "log_weight", "gumbel_key"])

    return evaluated_once(run)(F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)), text.cast("string"))


def log_weight(total: float, n: int) -> float:
    """The weight of ``n`` n-grams whose log ratios sum to ``total``."""
    return REFERENCE_LENGTH * total / (n + PRIOR_LENGTH)


def gumbel(seed: int, doc_id: int, text: str) -> float:
    """Standard Gumbel noise, by hash."""
    h = xxhash.xxh3_64_intdigest(f"{seed} {doc_id} {xxhash.xxh3_64_hexdigest(text.encode('utf-8', 'surrogatepass'))}")
    return -math.log(-math.log((h + 0.5) / 2.0**64)) if h < (1 << 64) - 2048 else 44.0


def score(docs: DataFrame, ratio: np.ndarray, id_column: str = "doc_id", text_column: str = "text", seed: int = 7) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key) of every row, see
    ``scored_column``; a null id stays null, other columns are not read."""
    bounded_batches(docs)
    doc_id, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    rows = docs.select(doc_id.cast("long").alias("doc_id"), scored_column(docs.sparkSession, ratio, doc_id, text, seed).alias("s"))
    return rows.select("doc_id", "s.n_features", "s.log_weight", "s.gumbel_key")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_labelled: int = 20_000,
) -> ResamplingModel:
    """``labels``: (doc_id, quality, toxic). Good: quality 1 and not toxic; bad:
    quality 0; other toxic documents take no part in fitting. The target model takes the good ones of at most about
    ``max_labelled`` labelled documents (least hash of the id); the raw model
    counts every document. Half of the sample fits the target, the other half the
    boundary. Without good or without bad documents the boundary is minus infinity:
    everything is kept. Null labels count as not given; conflicting labels of one
    id as bad."""
    plain = bounded_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
        .where("doc_id is not null and good is not null and not (good and toxic)")
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
    )
    marked = marked.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    total = marked.count()
    if total > max_labelled:
        marked = marked.where(F.col("h") < int(max_labelled / total * (1 << 63)))
    # bounded by about max_labelled rows of three numbers, so it may be broadcast; in a task
    # of its own Python code, no other stands before the one that counts or scores
    sample = materialize(marked.select("doc_id", "good", F.pmod("h", F.lit(2)).alias("half")), "labelled", few_files=True)
    chosen = plain.join(F.broadcast(sample), "doc_id")
    raw = _counts(plain)
    ratio = _log_ratio(_counts(chosen.where("good and half = 0")), raw)
    scores = scored_column(docs.sparkSession, ratio, F.col("doc_id"), F.col("text"))
    # bounded by max_labelled rows
    seen = chosen.where("half = 1").select("good", scores.alias("s")).select("good", "s.log_weight").toPandas()
    return ResamplingModel(ratio, _boundary(seen["log_weight"].to_numpy(dtype=np.float64), seen["good"].to_numpy(dtype=bool)))


def _boundary(weight: np.ndarray, good: np.ndarray) -> float:
    """Where good and bad are parted best, each class counting the same, moved down
    by the noise a good document may draw. Few good documents may fall below it."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight)
    w, g = weight[order], good[order]
    below_good = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    below_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    gain = below_bad - 4 * below_good
    k = int(gain.argmax())
    if gain[k] <= 0:
        return -np.inf
    low = w[k - 1] if k else w[0] - 1
    high = w[k] if k < len(w) else w[-1] + 1
    return float((low + high) / 2)


def kth_largest(rows: DataFrame, k: int, column: str, bins: int = 1024, few: int = 20_000) -> float:
    """The k-th largest value of a column of numbers: minus infinity where there are
    fewer, infinity where k is not positive. The interval that holds it is narrowed by
    histograms until it has at most ``few`` rows or one value, so the driver sees a
    bounded number of values however many rows there are."""
    if k <= 0:
        return math.inf
    value = F.col(column)
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < k:
        return -math.inf
    left = k  # the value is the left-th largest of those up to high
    while low < high:
        inside = rows.where((value >= low) & (value <= high))
        if n <= few:
            values = np.sort(inside.select(value).toPandas().iloc[:, 0].to_numpy(dtype=np.float64))
            return float(values[-left])
        step = (high - low) / bins
        at = F.least(F.floor((value - low) / step), F.lit(bins - 1)).alias("b")
        # at most ``bins`` rows
        found = inside.groupBy(at).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for x in sorted(found, key=lambda x: -x["b"]):
            if left <= x["n"]:
                low, high, n = x["low"], x["high"], x["n"]
                break
            left -= x["n"]
    return low


def gumbel_top_k(scored: DataFrame, k: int, key: str = "gumbel_key") -> DataFrame:
    """The k rows with the largest keys, and those whose key equals the k-th one: rows
    equal in id and text stay together. ``scored`` is read several times, so store it
    first."""
    return scored.where(F.col(key) >= F.lit(kth_largest(scored, k, key)))


def resample(docs: DataFrame, model: ResamplingModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``score`` plus ``selected``: whether the row is among the Gumbel top k, k being
    the number of documents whose log weight is at or above the model's boundary.
    Repeated rows are documents of their own, with equal keys; an empty table gives an
    empty result."""
    scored = materialize(score(docs, model.ratio, id_column, text_column), "scored")
    cut = kth_largest(scored, expected(scored, model), "gumbel_key")
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(cut))


def expected(scored: DataFrame, model: ResamplingModel) -> int:
    """How many documents are to be drawn."""
    return scored.where(F.col("log_weight") >= F.lit(model.boundary)).count()


def draw(docs: DataFrame, model: ResamplingModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, all columns kept. Each row's key
    stands beside it in a stored table, so nothing is joined by id."""
    bounded_batches(docs)
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in (id_column, text_column))
    keyed = rows.withColumn("s", scored_column(docs.sparkSession, model.ratio, doc_id, text))
    keyed = materialize(keyed.select(*names, "s.log_weight", "s.gumbel_key"), "scored")
    chosen = gumbel_top_k(keyed, expected(keyed, model))
    return chosen.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
