"""Exact Jaccard join of documents' word shingles, with set-relation skipping.

Sets are shingles hashed to 64 bits. Equal sets are one node, named by a hash of
the set. The join runs over nodes:

1. A sketch of which shingles recur orders each set's shingles, rare ones first.
   Any order gives right results; this one keeps common passages out of prefixes.
2. Prefix index. Two sets of the wanted similarity share a shingle within the
   first ``n - ceil(s * n) + 1`` of each. Postings (shingle, node, size, position)
   go to index parts as packed arrays.
3. In every list a member is held against three others only: the first one of its
   block of sizes, and the next one in two orders of hashes, where sizes and
   positions allow a link. Pairs whose bitmaps leave too few common shingles are
   skipped, the others verified exactly, and links put together to components. A
   member's answers are thereby known from a highly similar set's: whatever is
   already in one component needs no more comparisons, which are all but a few of
   a group of near copies.
4. Lists whose members are in several components still hold unknown pairs: all
   pairs across components that sizes, positions and bitmaps leave are verified.
   A long list is dealt out as pairs of blocks.

A set's bitmap has the bits its shingles' hashes name, so a bit that another's
lacks is a shingle the other lacks. No link between components is missed, and no
list of all pairs of a group is ever made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import expand, squeeze
from .shared import NULL_ID, bounded_batches, connected_components, discard, id_in, id_out, materialize, possible_ids, tasks_for
from .units import as_texts, only_cache, release_memory
from .words import BASE, hash_words, mix, words_of

WORDS = 5
SKETCH_BITS = 22
MOST_BITS = 1 << 13
#: Bytes of text whose shingles are held at a time.
_WINDOW = 12 << 20


def shingle_sets(texts: list) -> list:
    """Sorted distinct shingle hashes per text (bytes). Words are runs of bytes other
    than space and 0x09 to 0x0D, with A-Z in lower case; a text of fewer than five
    words has its whole sequence as the one shingle, one without words none."""
    out: list = []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
            size += len(texts[to]) + 1
            to += 1
        out += _sets_of(texts[at:to])
        at = to
    return out


def _sets_of(texts: list) -> list:
    data, starts, ends, first = words_of([t.lower() for t in texts])  # of bytes: A to Z alone
    words = hash_words(data, starts, ends)
    n = max(0, len(words) - WORDS + 1)
    shingles = np.full(n, WORDS, dtype=np.uint64)
    for i in range(WORDS):
        shingles = mix((shingles ^ words[i : i + n]) * BASE + np.uint64(i + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(_distinct(shingles[a : b - WORDS + 1]))
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for i in range(b - a):
                h = mix((h ^ words[a + i : a + i + 1]) * BASE + np.uint64(i + 1))
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    fresh = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def _node(s: np.ndarray) -> int:
    """The set's name."""
    return xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes()) - (1 << 63)


def _windows(batches):
    """Documents in windows of bounded bytes: ((id, hash), sets)."""
    only_cache(None)
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, h, t in zip(batch["doc"].tolist(), batch["h"].tolist(), as_texts(batch["text"])):
            raw = t.encode("utf-8", "surrogatepass")
            ids.append((d, h))
            texts.append(raw)
            size += len(raw) + 64
            if size >= _WINDOW:
                yield ids, shingle_sets(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, shingle_sets(texts)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _bitmap(s: np.ndarray) -> bytes:
    """Four bits a shingle, a power of two, at most MOST_BITS: then more shingles
    share a bit and fewer pairs are told apart."""
    width = min(MOST_BITS, 1 << max(6, (4 * len(s) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bitmaps: list, width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes or a power of two times as many, as rows of words
    of ``width`` bytes."""
    out = np.empty((len(bitmaps), width), dtype=np.uint8)
    for k, b in enumerate(bitmaps):
        x = np.frombuffer(b, dtype=np.uint8)
        out[k] = x if len(x) == width else np.bitwise_or.reduce(x.reshape(-1, width), axis=0)
    return out.view(np.uint64)


def bitmaps_allow(one: list, other: list, sizes, other_sizes, need) -> np.ndarray:
    """Whether pairs of sets can share as many shingles as they need, by their bitmaps."""
    width = np.minimum([len(x) for x in one], [len(x) for x in other])
    ok = np.zeros(len(one), dtype=bool)
    for w in np.unique(width).tolist():
        every = np.flatnonzero(width == w)
        step = max(1, (4 << 20) // w)
        for rows in np.split(every, range(step, len(every), step)):
            a, b = _folded([one[k] for k in rows], w), _folded([other[k] for k in rows], w)
            own = sizes[rows] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            others = other_sizes[rows] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            ok[rows] = np.minimum(own, others) >= need[rows]
    return ok


def least_overlap(a, b, percent: int):
    """Shingles two sets of these sizes share at least when they link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sketch_and_nodes(rows: DataFrame) -> tuple:
    """(doc, h, n, node, bitmap) of every document, and the recurrence level of every slot."""
    slices = 16

    def run(batches):
        seen = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for ids, sets in _windows(batches):
            nodes, parts = {}, []
            out = []
            for (d, h), s in zip(ids, sets):
                node = _node(s)
                out.append((0, d, h, len(s), node if len(s) else 0, _bitmap(s) if len(s) else None))
                if len(s) and node not in nodes:
                    nodes[node] = True
                    parts.append(s)
            yield pd.DataFrame(out, columns=names)
            if parts:
                every = np.concatenate(parts)
                every.sort()
                starts = np.flatnonzero(np.diff(every, prepend=every[0] ^ np.uint64(1)))
                times = np.diff(np.append(starts, len(every)))
                several = times > 1
                np.add.at(seen, _slots(every[starts[several]]), times[several].astype(np.int32))
        if seen.any():
            for k, part in enumerate(np.split(seen, slices)):
                yield pd.DataFrame([(1, k, 0, 0, 0, zlib.compress(part.astype("<i4").tobytes(), 1))], columns=names)

        release_memory()

    names = ["kind", "doc", "h", "n", "node", "blob"]
    made = materialize(rows.mapInPandas(run, "kind int, doc long, h long, n long, node long, blob binary"), "shingle-sets")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // slices, dtype=np.int64)
        for blob in group["blob"]:
            total += np.frombuffer(zlib.decompress(blob), dtype="<i4")
        level = np.ceil(np.log2(total + 1)).astype(np.uint8)
        return pd.DataFrame({"doc": [int(group["doc"].iloc[0])], "blob": [level.tobytes()]})

    def add_some(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // slices, dtype=np.int64)
        for blob in group["blob"]:
            total += np.frombuffer(zlib.decompress(blob), dtype="<i4")
        return pd.DataFrame({"doc": [int(group["doc"].iloc[0])], "blob": [zlib.compress(np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes(), 1)]})

    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    width = (1 << SKETCH_BITS) // slices
    # a slice's sketches of all tasks are added up in two steps, so that neither meets many
    some = made.where("kind = 1").withColumn("step", F.pmod(F.xxhash64("blob"), F.lit(64)))
    some = some.groupBy("doc", "step").applyInPandas(add_some, "doc long, blob binary")
    # a row a slice, four million bytes in all
    for x in some.groupBy("doc").applyInPandas(add, "doc long, blob binary").collect():
        levels[x["doc"] * width : (x["doc"] + 1) * width] = np.frombuffer(x["blob"], dtype=np.uint8)
    return made.where("kind = 0").select("doc", "h", "n", "node", F.col("blob").alias("bitmap")), levels


_POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<u4"), ("at", "<u4")])


def _index(rows: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """Lists of two nodes or more as rows (pair = false; x: list, y: node, size, at),
    lists of the same members once an index part, ``list`` being a hash of the members;
    and the pairs of step 3 (pair = true; x < y: nodes, their sizes)."""
    parts = 2 * tasks_for(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def post(batches):
        level = shared.value
        for _, sets in _windows(batches):
            done, found = set(), []
            for s in sets:
                if not len(s) or (node := _node(s)) in done:
                    continue
                done.add(node)
                k = prefix_length(len(s), percent)
                key = level[_slots(s)]
                if k < len(s):
                    # the least k by (level, hash): sets are sorted by hash already
                    bound = np.partition(key, k - 1)[k - 1]
                    below = np.flatnonzero(key < bound)
                    chosen = np.concatenate([below[np.argsort(key[below], kind="stable")], np.flatnonzero(key == bound)[: k - len(below)]])
                else:
                    chosen = np.argsort(key, kind="stable")
                p = np.empty(len(chosen), dtype=_POSTING)
                p["token"], p["node"], p["size"], p["at"] = s[chosen], node, len(s), np.arange(len(chosen))
                found.append(p)
            if not found:
                continue
            every = np.concatenate(found)
            part = (every["token"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            every, part = every[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            yield pd.DataFrame({"part": part[cuts], "blob": [x.tobytes() for x in np.split(every, cuts[1:])]})

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        p = np.concatenate([np.frombuffer(b, dtype=_POSTING) for b in group["blob"]])
        p = p[np.lexsort((p["node"], p["size"], p["token"]))]
        fresh = np.ones(len(p), dtype=bool)
        fresh[1:] = (p["token"][1:] != p["token"][:-1]) | (p["node"][1:] != p["node"][:-1])
        p = p[fresh]  # copies in several tasks
        starts = np.flatnonzero(np.diff(p["token"], prepend=p["token"][:1] ^ np.uint64(1)))
        sizes = np.diff(np.append(starts, len(p)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        if not len(starts):
            return pd.DataFrame({"pair": np.zeros(0, dtype=bool), "x": [], "y": [], "size": [], "at": []}).astype({k: "int64" for k in ("x", "y", "size", "at")})
        rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        p = p[rows]
        heads = np.cumsum(sizes) - sizes
        name = mix(p["node"].copy().view(np.uint64))
        name = np.add.reduceat(name, heads).view(np.int64)
        # of lists with the same members one is enough, with each member's least position
        same = np.repeat(name, sizes)
        frame = pd.DataFrame({"x": same, "y": p["node"], "size": p["size"].astype(np.int64), "at": p["at"].astype(np.int64)})
        frame = frame.groupby(["x", "y", "size"], as_index=False)["at"].min()
        frame.insert(0, "pair", False)
        return pd.concat([frame, _few_pairs(frame, percent)], ignore_index=True)

    packed = rows.mapInPandas(post, "part int, blob binary")
    return packed.groupBy("part").applyInPandas(lists, "pair boolean, x long, y long, size long, at long")


def _few_pairs(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each member of each list the first one of its block of sizes, and the next
    one in two orders of hashes, where sizes and positions allow a link. The orders are
    the same in all lists, so lists of much the same members give much the same pairs."""
    lists, nodes, sizes, places = (members[c].to_numpy() for c in ("x", "y", "size", "at"))
    block = np.floor(np.log(sizes) / np.log(100 / percent)) if percent < 100 else sizes
    first, second = [], []
    for turn in range(3):
        if turn:
            h = mix(nodes.view(np.uint64) + np.uint64(turn))
            order = np.lexsort((nodes, h, lists))
            a, b = order[:-1], order[1:]
        else:
            order = np.lexsort((nodes, sizes, lists))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (lists[order][1:] != lists[order][:-1]) | (block[order][1:] != block[order][:-1])
            a, b = order[np.flatnonzero(new)[np.cumsum(new) - 1]], order
        near = (lists[a] == lists[b]) & (nodes[a] != nodes[b])
        near &= np.minimum(sizes[a] - places[a], sizes[b] - places[b]) >= least_overlap(sizes[a], sizes[b], percent)
        first.append(a[near])
        second.append(b[near])
    a, b = np.concatenate(first), np.concatenate(second)
    a, b = np.where(nodes[a] < nodes[b], a, b), np.where(nodes[a] < nodes[b], b, a)
    out = pd.DataFrame({"pair": True, "x": nodes[a], "y": nodes[b], "size": sizes[a], "at": sizes[b]})
    return out.drop_duplicates(["x", "y"])


def _possible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb) the (a, b) whose bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            ok = bitmaps_allow(batch["ba"].tolist(), batch["bb"].tolist(), na, nb, least_overlap(na, nb, percent))
            yield batch.loc[ok, ["a", "b"]]

    sides = pairs.join(bitmaps.select(F.col("node").alias("b"), F.col("bitmap").alias("bb")), "b")
    sides = sides.join(bitmaps.select(F.col("node").alias("a"), F.col("bitmap").alias("ba")), "a")
    return sides.select("a", "b", "na", "nb", "ba", "bb").mapInPandas(run, "a long, b long")


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _sets(column):
    """The shingle sets of a column of compressed texts, in order, decoded in groups
    of bounded bytes."""
    texts, size = [], 0
    for z in column:
        texts.append(expand(z))
        size += len(texts[-1])
        if size >= 2 << 20:
            yield from shingle_sets(texts)
            texts, size = [], 0
    yield from shingle_sets(texts)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by exact intersection."""

    def run(batches):
        own = None
        for batch in batches:
            keep, a = [], batch["a"].to_numpy()
            fresh = np.flatnonzero(np.diff(a, prepend=a[:1] ^ 1)).tolist() if len(a) else []
            leads, heads = _sets(batch["za"].iloc[fresh]), set(fresh)
            for k, other in enumerate(_sets(batch["zb"])):
                if k in heads:
                    own = next(leads)
                common = _intersection(own, other)
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    sides = pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    sides = sides.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    return sides.select("a", "b", "za", "zb").mapInPandas(run, "a long, b long")


#: Members of a list that are passed over together.
LIST_BLOCK = 64


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that these put together are
    worked on, each by its name, its least node."""
    one = components.select(F.col("node").alias("a"), F.col("component").alias("u"))
    other = components.select(F.col("node").alias("b"), F.col("component").alias("v"))
    between = links.join(one, "a").join(other, "b").where("u <> v").select("u", "v").distinct()
    between = materialize(between, "links", few_files=True)
    if between.isEmpty():
        return components
    moved = connected_components(between, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return materialize(
        components.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components"
    )


def _open_pairs(members: DataFrame, components: DataFrame, bitmaps: DataFrame, percent: int, block: int = 2000, together: int = 10_000) -> DataFrame:
    """(a, b): all pairs of one list across components that sizes, positions and
    bitmaps leave. A list of more than ``block`` members is dealt out as pairs of blocks
    of members. Lists with the same least component stand together, up to ``together``
    rows, so that a pair that many lists share is mostly found in one task, which
    returns it once."""
    spark = members.sparkSession
    placed = materialize(members.join(components, "node"), "index-lists")
    several = placed.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y")
    several = several.select("list", "x", F.ceil(F.col("m") / block).cast("int").alias("k"), "m")
    several = materialize(several, "open-lists", few_files=True)
    shares = several.groupBy("x").agg(F.ceil(F.sum(F.col("m") * F.col("k")) / together).alias("share"))
    several = several.join(shares, "x").select("list", "x", "k", F.pmod("list", "share").alias("share"))
    mixed = placed.join(several, "list").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    mixed = mixed.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).join(bitmaps, "node")

    def across(frame, one_block):
        """Surviving pairs of whole groups (list, i, j), sorted by size within each."""
        group, node, size, at, comp, mine = (frame[c] for c in ("group", "node", "size", "at", "component", "mine"))
        bitmaps = frame["bitmap"]
        # the members after each that its size reaches, in blocks of the list: a block is
        # passed over when none of its members has enough behind its position
        last = np.searchsorted(group, group, side="right")
        row, rest = np.arange(len(group)), size - at
        reach = np.maximum(np.minimum(last, _reach(group, size, percent)), row + 1)
        starts = np.arange(0, len(row), LIST_BLOCK)
        longest, smallest = np.maximum.reduceat(rest, starts), np.minimum.reduceat(size, starts)
        first_block = (row + 1) // LIST_BLOCK
        count = np.where(reach > row + 1, (reach - 1) // LIST_BLOCK - first_block + 1, 0)
        ends = np.cumsum(count)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000 // LIST_BLOCK, side="right")))
            one = np.repeat(row[lo:hi], count[lo:hi])
            which = np.repeat(first_block[lo:hi] - (ends[lo:hi] - count[lo:hi]), count[lo:hi]) + np.arange(len(one)) + (ends[lo] - count[lo])
            need = least_overlap(size[one], smallest[which], percent)
            open_ = (rest[one] >= need) & (longest[which] >= need)
            one, which = one[open_], which[open_]
            begin = np.maximum(which * LIST_BLOCK, one + 1)
            width = np.minimum((which + 1) * LIST_BLOCK, reach[one]) - begin
            left = np.repeat(one, width)
            right = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(len(left))
            need = least_overlap(size[left], size[right], percent)
            keep = (comp[left] != comp[right]) & (np.minimum(size[left] - at[left], size[right] - at[right]) >= need)
            keep &= one_block[left] | (mine[left] != mine[right])
            left, right, need = left[keep], right[keep], need[keep]
            if len(left):
                # a pair that several lists share is looked at once
                a, b = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
                order = np.lexsort((b, a))
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
                pick = order[fresh]
                ok = bitmaps_allow([bitmaps[k] for k in left[pick]], [bitmaps[k] for k in right[pick]], size[left[pick]], size[right[pick]], need[pick])
                yield np.stack([a[pick][ok], b[pick][ok]], axis=1)
            lo = hi

    columns = ["list", "i", "j", "mine", "node", "size", "at", "component", "bitmap"]

    def pairs(batches):
        only_cache(None)
        rest, found, count = None, [], 0
        for batch in _whole_groups(batches, columns[:3]):
            keys = batch[columns[:3]].to_numpy()
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            frame = {c: batch[c].to_numpy() for c in columns[3:]} | {"group": np.cumsum(new)}
            frame["bitmap"] = batch["bitmap"].tolist()
            for p in across(frame, keys[:, 1] == keys[:, 2]):
                found.append(p)
                count += len(p)
                if count >= 500_000:
                    yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
                    found, count = [], 0
        if found:
            yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
        release_memory()

    # a row more for an id that repeats would only repeat pairs
    ordered = mixed.repartition(tasks_for(spark), "x", "share", "i", "j").sortWithinPartitions("x", "list", "i", "j", "size", "node")
    out = materialize(ordered.select(*columns).mapInPandas(pairs, "a long, b long").distinct(), "open-pairs", few_files=True)
    discard(placed, several)
    return out


def _reach(group: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """One past the last row that a row's size reaches, for rows sorted by group and size."""
    most = size * 100 // percent
    width = int(most.max()) + 1 if len(size) else 1
    return np.searchsorted(group * width + size, group * width + most, side="right")


def _whole_groups(batches, keys: list):
    """Batches of sorted rows, cut where the values of ``keys`` change. A group is as
    large as two blocks at most."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        value = batch[keys].to_numpy()
        change = np.flatnonzero((value != value[-1]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
        if not cut and held and (held[-1][keys].to_numpy()[-1] == value[-1]).all():
            held.append(batch)
            continue
        if held or cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
        held = [batch.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def components_of(rows: DataFrame, percent: int) -> DataFrame:
    """(doc, h, n, component) of every row (doc, h, text): the component is the least
    node of the row's set's, or 0 for a set without shingles. A stored table."""
    nodes, levels = _sketch_and_nodes(rows)
    index = materialize(_index(rows, levels, percent), "index")
    members = index.where("not pair").select(F.col("x").alias("list"), F.col("y").alias("node"), "size", "at")
    pairs = index.where("pair").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.first("size").alias("na"), F.first("at").alias("nb"))
    pairs = materialize(pairs, "pairs", few_files=True)
    listed = members.select("node").distinct()
    # one row a node, whichever of its documents; least() of a struct of numbers
    reps = nodes.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "h")).alias("r"), F.first("bitmap").alias("bitmap"))
    reps = materialize(reps.join(listed, "node").select("node", "r.doc", "r.h", "bitmap"), "index-nodes")
    bitmaps = reps.select("node", "bitmap")
    components = materialize(reps.select("node", F.col("node").alias("component")), "components", few_files=True)

    def join(found: DataFrame, components: DataFrame) -> DataFrame:
        """Components after the pairs that link, of stored pairs (a, b)."""
        wanted = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        texts = materialize(_texts_of(rows, reps.join(wanted, "node").select("node", "doc", "h")), "node-texts")
        links = materialize(_verified(found, texts, percent), "verified", few_files=True)
        merged = _merged(components, links)
        discard(texts, links, found)
        return merged

    components = join(materialize(_possible(pairs, bitmaps, percent), "candidates", few_files=True), components)
    left = _open_pairs(members, components, bitmaps, percent)
    new = materialize(left.join(pairs, ["a", "b"], "left_anti"), "candidates", few_files=True)
    components = join(new, components)
    discard(left)
    placed = nodes.join(components, "node", "left").select("doc", "h", "n", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed")
    discard(index, pairs, reps, components, nodes)
    return placed


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, h, text): rows are told apart by id and a hash of the text."""
    text = F.col(f"`{text_column}`").cast("string")
    return bounded_batches(docs).select(id_in(f"`{id_column}`").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def join_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Links are pairs with ``100 * intersection >= percent * union``. Null and empty
    texts, and texts of white space alone, have no shingles and link with nothing.
    Rows that repeat an id are documents of their own; a null id stays null, and a
    component's id is the least id in it that is not null. Other columns are not
    read; an empty table gives an empty result.
    """
    placed = components_of(_rows(docs, id_column, text_column), percent)
    # documents without shingles stand alone
    least = placed.where("n > 0").groupBy("component").agg(F.min(id_out("doc")).alias("component_id"))
    linked = placed.where("n > 0").join(least, "component").select("doc", "n", "component_id")
    alone = placed.where("n = 0").select("doc", "n", id_out("doc").alias("component_id"))
    return linked.union(alone).select(id_out("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` without all but one of every component: the row of the least
    id (a null id comes last), of rows that share it the one of the least text hash, of
    rows equal in both any one. Documents without shingles all stay; all columns are
    kept; an empty table stays empty."""
    placed = components_of(_rows(docs, id_column, text_column), percent).where("n > 0")
    order = F.struct(F.when(F.col("doc") == F.lit(NULL_ID), 1).otherwise(0).alias("late"), "doc", "h")
    best = placed.groupBy("component").agg(F.min(order).alias("best"))
    gone = placed.join(best, "component").where("doc <> best.doc or h <> best.h").select("doc", "h").distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_column, text_column))
    rows = rows.withColumns({"_doc": id_in(own_id), "_h": F.xxhash64(F.col(own_text).cast("string"))})
    left = rows.join(gone.select(F.col("doc").alias("_doc"), F.col("h").alias("_h")), ["_doc", "_h"], "left_anti")
    again = placed.groupBy("doc", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("_doc"), F.col("h").alias("_h"))
    if not again.isEmpty():
        # rows equal in id and text: one of each
        left = left.join(again, ["_doc", "_h"], "left_anti").unionByName(left.join(again, ["_doc", "_h"], "left_semi").dropDuplicates(["_doc", "_h"]))
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def _texts_of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, z): one compressed text for each row (node, doc, h) of ``reps``. Most other
    documents' texts are kept out of the shuffle by a filter on the hash."""
    reps = materialize(reps, "wanted", few_files=True)
    maybe = possible_ids(reps, "h")

    def pack(batches):
        only_cache(None)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "z": [squeeze(t.encode("utf-8", "surrogatepass")) for t in as_texts(batch["text"])]})
        release_memory()

    # the filter and the packing stand in different stages: a task runs one Python worker
    some = rows.where(maybe("h")).join(reps.hint("merge"), ["doc", "h"]).select("node", "text")
    return some.mapInPandas(pack, "node long, z binary").dropDuplicates(["node"])
