"""How a source's words differ from its language's: smoothed probabilities of terms, the
distance between any two sources of a language, and the terms a source has most beyond
its language.

A term's probability in a group is 1 + floor(10^9 (count + 5) / (N + 5 V)), all in whole
numbers, so it depends on the group and the count alone. Three things follow:

- Terms that a group lacks all have its base probability. The distance of two groups is
  V |base - base'| plus what the terms of either add to that, which comes from the
  group's histogram of counts, plus a correction for each term that both have, which
  comes from the terms' postings.
- Terms of a group fall into buckets by count. A bucket's largest count and the least
  probability that the language gives any of its terms bound what a term in it can reach.
- The search for the foremost terms opens buckets best bound first and stops when all
  bounds left are strictly below the k-th value found.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, materialize, tasks_for

SCALE = 1_000_000_000
#: Entries of the counts a task holds before it hands them on.
HELD = 400_000
#: Bytes of text split at a time.
SLICE = 1 << 20
#: Groups on a side of a tile of pairs.
TILE = 128
#: Pairs of postings worked on at a time.
PAIRS = 1 << 20
#: Counts below this have a bucket of their own.
EXACT = 32

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list:
    """The terms of a text, as UTF-8: runs of letters A to Z and of characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _slices(text: str):
    """The text in slices that no term crosses."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and (text[end].isascii() is False or text[end].isalpha()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def count_terms(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows they are in. Every group has a
    row with the empty term as well, which no text has. A task adds up what it reads, a
    bounded number of entries at a time, so a term may have several rows, to be summed;
    null text, lang and source are empty, rows that repeat count each."""
    names = {"lang": lang_column, "source": source_column, "text": text_column}
    rows = bounded_batches(docs).select(*(F.coalesce(F.col(f"`{v}`").cast("string"), F.lit("")).alias(k) for k, v in names.items()))

    def frames(held):
        for (lang, source), (times, inside) in held.items():
            yield pd.DataFrame({"lang": lang, "source": source, "term": [""] + [x.decode("utf-8", "surrogatepass") for x in times], "n": [0, *times.values()], "docs": [0, *(inside[x] for x in times)]})

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                times, inside = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(times), set()
                for piece in _slices(text):
                    terms = terms_of(piece)
                    times.update(terms)
                    own.update(terms)
                inside.update(own)
                size += len(times) - before
                if size >= HELD:
                    yield from frames(held)
                    held, size = {}, 0
        yield from frames(held)

    return rows.mapInPandas(count, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), three decimal digits at a time, so
    that 64 bits are enough for totals up to 9 x 10^15."""
    below = total + 5 * kept
    out, rest = F.lit(0).cast("long"), (count + 5).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, below), (rest * 1000) % below
    return out + 1


class Counts:
    """Counts of the kept terms, stored: ``groups`` (lang, source, kept, total, lang_total,
    base, no) and ``postings`` (lang, source, term, n, p, q, base, no)."""

    def __init__(self, docs: DataFrame, least_docs: int = 30, **columns):
        # one shuffle by term: a term's sums over sources need no other
        counted = count_terms(docs, **columns).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")
        counted = counted.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), F.row_number().over(term.orderBy("source")).alias("k"))
        own = materialize(counted.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "kept-counts")
        words = own.where("term <> ''")
        langs = words.where("k = 1").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        totals = words.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = own.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"])
        base = F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(0)
        numbered = groups.withColumn("base", base).withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        # a row a group; joins with it are broadcast only where its files are small
        self.groups = materialize(numbered, "term-groups", few_files=True)
        joined = words.join(self.groups, ["lang", "source"])
        self.postings = materialize(
            joined.select(
                "lang", "source", "term", "n", "no", "base",
                probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                probability(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
            ),
            "term-postings",
        )
        discard(own)


def _corrections(postings: DataFrame) -> DataFrame:
    """(lang, a, b, value): for every two groups of a language, by number, what their common
    terms have |p - p'| - |p - base'| - |base - p'| + |base - base'| of, summed.

    Postings meet by term within tiles of ``TILE`` x ``TILE`` groups, so a term's list has
    at most two tiles' sides of rows wherever it is looked at; a task adds up a tile's
    pairs before it hands them on."""
    side = F.floor(F.col("no") / TILE).cast("int")
    sides = postings.groupBy("lang").agg(F.max(side).alias("most"))
    rows = postings.join(sides, "lang").select("lang", "term", "no", "p", "base", side.alias("own"), F.explode(F.sequence(F.lit(0), F.col("most"))).alias("other"))
    rows = rows.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "term", "no", "p", "base")
    dealt = rows.repartition(tasks_for(postings.sparkSession), "lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term", "no")

    def add(batches):
        tile, table, rest = None, None, None

        def result():
            a, b = np.nonzero(table)
            i, j = tile[1] * TILE, tile[2] * TILE
            columns = {"a": i + a, "b": j + b, "value": table[a, b].astype(np.int64)}
            return pd.DataFrame({"lang": [tile[0]] * len(a), **columns})[["lang", "a", "b", "value"]]

        def work(part):
            """Adds a run of rows of one tile, whole lists of terms."""
            term, no, p, base = (part[x].to_numpy() for x in ("term", "no", "p", "base"))
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            ends = np.append(starts[1:], len(term))
            after = np.repeat(ends, ends - starts) - np.arange(len(term)) - 1  # rows behind it in its list
            edges = np.cumsum(after)
            first = 0
            while first < len(term):
                last = max(first + 1, int(np.searchsorted(edges, (edges[first - 1] if first else 0) + PAIRS, "right")))
                left = np.repeat(np.arange(first, last), after[first:last])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after[first:last]) - after[first:last], after[first:last])
                if tile[1] != tile[2]:
                    inside = (no[left] // TILE == tile[1]) & (no[right] // TILE == tile[2])
                    left, right = left[inside], right[inside]
                value = np.abs(p[left] - p[right]) - np.abs(p[left] - base[right]) - np.abs(base[left] - p[right]) + np.abs(base[left] - base[right])
                at = (no[left] - tile[1] * TILE) * TILE + no[right] - tile[2] * TILE
                # sums stay below 2^53: a group's probabilities add up to about 10^9
                table[:] += np.bincount(at, weights=value, minlength=TILE * TILE).reshape(TILE, TILE)
                first = last

        for batch in batches:
            for key, part in batch.groupby(["lang", "i", "j"], sort=False):
                if key != tile:
                    if rest is not None:
                        work(rest)
                        rest = None
                    if tile is not None and table.any():
                        yield result()
                    tile, table = key, np.zeros((TILE, TILE))
                if rest is not None:
                    part = pd.concat([rest, part])
                unlike = np.flatnonzero(part["term"].to_numpy() != part["term"].iloc[-1])
                whole = int(unlike[-1]) + 1 if len(unlike) else 0
                if whole:
                    work(part.iloc[:whole])
                rest = part.iloc[whole:]  # its list may go on in the next batch
        if tile is not None:
            work(rest)
            if table.any():
                yield result()

    found = dealt.mapInPandas(add, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_distances(counts: Counts) -> DataFrame:
    """(lang, source, item, value): sum over all kept terms of |p - q| for every two sources
    of a language; 0 where it keeps no term. A row for either order."""
    groups = counts.groups.select("lang", "no", "base", "kept", "source")
    one, other = groups.alias("x"), groups.alias("y")
    both = one.join(other, F.expr("x.lang = y.lang and x.no <> y.no")).select("x.lang", F.col("x.no").alias("no"), F.col("y.no").alias("to"), F.col("x.base").alias("base"), F.col("y.base").alias("at"), F.col("x.kept").alias("kept"))
    # a group's own terms against another's base: sums over its histogram up to that base
    bars = counts.postings.groupBy("lang", "no", "base", "p").agg(F.count("*").alias("n"))
    marks = bars.select("lang", "no", "p", F.lit(0).alias("kind"), "n", (F.col("n") * F.col("p")).alias("sum"), F.lit(None).cast("int").alias("to"), "base", F.lit(None).cast("long").alias("kept")).unionByName(
        both.select("lang", "no", F.col("at").alias("p"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"), "to", "base", "kept")
    )
    group = Window.partitionBy("lang", "no")
    so_far = group.orderBy("p", "kind", "to").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.select("*", F.sum("n").over(so_far).alias("n_low"), F.sum("sum").over(so_far).alias("s_low"), F.sum("n").over(group).alias("n_all"), F.sum("sum").over(group).alias("s_all")).where("kind = 1")
    x, base = F.col("p"), F.col("base")
    high, s_high = F.col("n_all") - F.col("n_low"), F.col("s_all") - F.col("s_low")
    own = F.col("n_low") * x - F.col("s_low") + s_high - high * x - F.col("n_all") * F.abs(base - x)
    # either order of a pair brings its own terms; the terms neither has are brought once
    rest = F.when(F.col("no") < F.col("to"), F.col("kept") * F.abs(base - x)).otherwise(0)
    parts = seen.select("lang", F.least("no", "to").alias("a"), F.greatest("no", "to").alias("b"), (own + rest).alias("value")).unionByName(_corrections(counts.postings))
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    either = summed.union(summed.select("lang", "b", "a", "value"))
    names = counts.groups.select("lang", "no", "source")
    left, right = names.withColumnRenamed("no", "a"), names.select("lang", F.col("no").alias("b"), F.col("source").alias("item"))
    return either.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select("lang", "source", "item", "value")


def bucket(count: Column) -> Column:
    """The bucket of a count: its own below ``EXACT``, then about eight to a power of two."""
    high = F.floor(F.log2(count.cast("double"))).cast("int")
    eighth = F.floor(count / F.pow(F.lit(2.0), high - 3)).cast("int") % 8
    return F.when(count < EXACT, count.cast("int")).otherwise(EXACT + 8 * high + eighth)


def foremost_terms(counts: Counts, k: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): the ``k`` terms of a group that are furthest above
    its language's probability, ties by the term's bytes.

    Each round opens a group's buckets in order of their bounds, until they hold four times
    as many terms as in the round before, or the bounds fall below the k-th value that is
    known; it ends when that is so for every group."""
    postings = counts.postings.select("lang", "source", "term", bucket(F.col("n")).alias("bucket"), "p", "q")
    buckets = postings.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("size")).where("bound > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = materialize(buckets.select("*", before.alias("before")), "term-buckets", few_files=True)
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    asked, least, held = k, None, None
    while True:
        reach = buckets if least is None else buckets.join(least, ["lang", "source"], "left").where("least is null or bound >= least")
        opened = reach.where(F.col("before") < asked).select("lang", "source", "bucket")
        found = postings.join(opened, ["lang", "source", "bucket"], "left_semi").where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        top = materialize(found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k), "term-tops", few_files=True)
        if held is not None:
            discard(held)
        held = top
        least = top.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("least"))
        # a bucket not opened may hold a term as high as the k-th, or there is no k-th yet
        left = buckets.where(F.col("before") >= asked).join(least, ["lang", "source"], "left").where("least is null or bound >= least")
        if left.isEmpty():
            return top
        asked *= 4


def audit(docs: DataFrame, k: int = 50, least_docs: int = 30, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair_distances`` with their ranks and
    ``foremost_terms``.

    Null text, lang and source are empty, and so are groups of their own; empty texts give
    a group without terms, which has distances but no foremost terms; rows that repeat
    count each; an empty table gives no rows. Other columns are not read."""
    counts = Counts(docs, least_docs, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(counts).withColumn("rank", F.row_number().over(order))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(names).union(foremost_terms(counts, k).withColumn("part", F.lit("term")).select(names))
