"""Embedding near-duplicates by a random-projection tree forest.

Every tree splits the vectors recursively: a node projects its vectors on a random
direction and cuts at a quantile near the median of a bounded sample; vectors in
the band around the cut spill into both children. Two vectors are compared, in
double precision, where they share a leaf of some tree; links are pairs of cosine
``threshold`` or more.

A vector carries its leaves in all trees, so the task that compares a leaf knows
whether a pair shares an earlier leaf as well and counts it once over the whole
forest without any list of pairs. It returns counts and a spanning forest of its
links, at most one edge per vector; components are joined from these. A leaf of
more than ``block`` vectors is dealt out as pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, connected_components, discard, materialize, tasks_for


def _matrix(column) -> np.ndarray:
    """Rows of bytes (doubles) as unit vectors."""
    x = np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Forest:
    """Bands of all nodes of the trees over vectors of one number of dimensions; node n
    has children 2n, 2n + 1. Directions are drawn again from the seed where they are
    needed, so what is broadcast is two numbers a node."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, seed: int):
        self.depth, self.trees, self.seed, self.dims = depth, trees, seed, sample.shape[1]
        self.low = np.full((trees, 1 << depth), np.inf)
        self.high = np.full((trees, 1 << depth), -np.inf)
        for t in range(trees):
            directions = self._directions(t)
            level = {1: np.arange(len(sample))}
            for _ in range(depth):
                below = {}
                for node, rows in level.items():
                    p = sample[rows] @ directions[node].astype(np.float64)
                    if len(p):
                        self.low[t, node], self.high[t, node] = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
                    else:
                        self.low[t, node] = self.high[t, node] = 0.0
                    below[2 * node] = rows[p <= self.high[t, node]]
                    below[2 * node + 1] = rows[p >= self.low[t, node]]
                level = below

    def _directions(self, t: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, t, self.dims])
        return rng.standard_normal((1 << self.depth, self.dims)).astype(np.float32)

    def leaves(self, x: np.ndarray):
        """For each tree (tree, row, leaf) of every leaf a row falls into."""
        for t in range(self.trees):
            directions = self._directions(t)
            rows, nodes = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                p = np.empty(len(rows))
                order = np.argsort(nodes, kind="stable")
                cuts = np.flatnonzero(np.diff(nodes[order], prepend=-1))
                for at in np.split(order, cuts[1:]):
                    p[at] = x[rows[at]] @ directions[nodes[at[0]]].astype(np.float64)
                left, right = p <= self.high[t, nodes], p >= self.low[t, nodes]
                rows = np.concatenate([rows[left], rows[right]])
                nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            yield t, rows, nodes


#: Levels by which a leaf that is still too large is split again, and vectors a leaf of it.
SPLIT_DEPTH, SPLIT_SAMPLE = 7, 20
#: Bytes of vectors that the upper levels are fitted on, at most.
SAMPLE_BYTES = 64 << 20
#: A leaf's number: tree, node of the upper levels, node of the lower ones.
_TREE, _NODE = 48, 16


def _split_directions(seed: int, tree: int, dims: int) -> np.ndarray:
    """Directions of a tree's lower levels, the same for all its leaves."""
    return np.random.default_rng([seed, tree, dims, 1]).standard_normal((1 << SPLIT_DEPTH, dims)).astype(np.float32).astype(np.float64)


def _split_again(placed: DataFrame, leaf_size: int, spill: float, seed: int) -> DataFrame:
    """``placed`` with every leaf of more than twice ``leaf_size`` vectors split by up to
    ``SPLIT_DEPTH`` levels more, into bands fitted on a sample of its own vectors by one
    task a leaf. A leaf of the upper levels has two numbers for each lower node, so what
    is broadcast is bounded by the sample that the upper levels were fitted on."""
    spark = placed.sparkSession
    per_leaf = placed.select(F.length("raw").alias("width"), F.explode("leaves").alias("leaf")).groupBy("width", "leaf").agg(F.count("*").alias("m"))
    large = {(x["width"], x["leaf"]): (min(SPLIT_DEPTH, math.ceil(math.log2(x["m"] / leaf_size))), x["m"]) for x in per_leaf.where(F.col("m") > 2 * leaf_size).collect()}
    if not large:
        return placed
    asked = spark.sparkContext.broadcast(large)

    def draw(batches):
        known = asked.value
        for batch in batches:
            out = []
            for rep, raw, leaves in zip(batch["rep"].tolist(), batch["raw"], batch["leaves"]):
                for leaf in leaves.tolist():
                    depth, m = known.get((len(raw), leaf), (0, 1))
                    if depth and xxhash.xxh3_64_intdigest(rep.to_bytes(8, "little", signed=True), seed=leaf & 0xFFFF_FFFF) < (SPLIT_SAMPLE << depth) / m * 2**64:
                        out.append((len(raw), leaf, raw))
            yield pd.DataFrame(out, columns=["width", "leaf", "raw"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        width, leaf = int(group["width"].iloc[0]), int(group["leaf"].iloc[0])
        depth, x = asked.value[width, leaf][0], _matrix(group["raw"])
        p = x @ _split_directions(seed, leaf >> _TREE, x.shape[1]).T
        bands, level = np.zeros((2, 1 << depth)), {1: np.arange(len(x))}
        for _ in range(depth):
            below = {}
            for node, rows in level.items():
                at = p[rows, node]
                if len(at):
                    bands[:, node] = np.quantile(at, [0.5 - spill / 2, 0.5 + spill / 2])
                below[2 * node], below[2 * node + 1] = rows[at <= bands[1, node]], rows[at >= bands[0, node]]
            level = below
        return pd.DataFrame({"width": [width], "leaf": [leaf], "bands": [bands.tobytes()]})

    drawn = placed.mapInPandas(draw, "width int, leaf long, raw binary")
    fitted = drawn.groupBy("width", "leaf").applyInPandas(fit, "width int, leaf long, bands binary").collect()
    shared = spark.sparkContext.broadcast({(x["width"], x["leaf"]): np.frombuffer(x["bands"]).reshape(2, -1) for x in fitted})

    def refine(batches):
        known = shared.value
        for batch in batches:
            for width, part in batch.groupby(batch["raw"].map(len)):
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    x = _matrix(some["raw"])
                    row = np.repeat(np.arange(len(some)), some["leaves"].map(len))
                    leaf = np.concatenate(some["leaves"].to_numpy())
                    rows, names = [], []
                    for tree in np.unique(leaf >> _TREE).tolist():
                        mine = leaf >> _TREE == tree
                        rows_, names_ = _lower(x, row[mine], leaf[mine], {k[1]: v for k, v in known.items() if k[0] == width and k[1] >> _TREE == tree}, tree, seed)
                        rows.append(rows_)
                        names.append(names_)
                    yield _placed(some, np.concatenate(rows), np.concatenate(names))

    out = materialize(placed.mapInPandas(refine, "rep long, n long, raw binary, leaves array<long>"), "vector-leaves")
    discard(placed)
    return out


def _lower(x: np.ndarray, row: np.ndarray, leaf: np.ndarray, bands: dict, tree: int, seed: int) -> tuple:
    """(rows, leaves) with those leaves that have bands taken down their lower levels."""
    names = np.unique(leaf)
    split = [k for k in names.tolist() if k in bands]
    if not split:
        return row, leaf
    p = x @ _split_directions(seed, tree, x.shape[1]).T
    low, high = (np.zeros((len(split), 1 << SPLIT_DEPTH)) for _ in range(2))
    depth = np.zeros(len(split), dtype=np.int64)
    for k, name in enumerate(split):
        size = bands[name].shape[1]
        low[k, :size], high[k, :size] = bands[name]
        depth[k] = size.bit_length() - 1
    inside = np.isin(leaf, split)
    done_rows, done_names = [row[~inside]], [leaf[~inside]]
    rows, which, node = row[inside], np.searchsorted(split, leaf[inside]), np.ones(inside.sum(), dtype=np.int64)
    for level in range(SPLIT_DEPTH + 1):
        ready = depth[which] == level
        done_rows.append(rows[ready])
        done_names.append(np.array(split)[which[ready]] | node[ready])
        rows, which, node = rows[~ready], which[~ready], node[~ready]
        if not len(rows):
            break
        at = p[rows, node]
        left, right = at <= high[which, node], at >= low[which, node]
        rows, which, node = np.concatenate([rows[left], rows[right]]), np.concatenate([which[left], which[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return np.concatenate(done_rows), np.concatenate(done_names)


def _placed(some: pd.DataFrame, rows: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """A row a vector with its leaves, those of an earlier tree first."""
    order = np.lexsort((names, rows))
    cuts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    return pd.DataFrame({"rep": some["rep"].to_numpy(), "n": some["n"].to_numpy(), "raw": some["raw"].to_numpy(), "leaves": np.split(names[order], cuts[1:])})


class _Earlier:
    """Which pairs of a group's vectors share a leaf that comes before the group's: bits
    over the leaves of one tree after another, as near vectors mostly share a leaf of
    the first."""

    def __init__(self, leaves: list, leaf: int):
        owner = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        every = np.concatenate(leaves)
        before = every < leaf
        owner, every = owner[before], every[before]
        self.bits = []
        for tree in np.unique(every >> _TREE).tolist():
            mine = every >> _TREE == tree
            names, code = np.unique(every[mine], return_inverse=True)
            # vectors of a group by leaves of a tree, each within a bound
            marks = np.zeros((len(leaves), -(-len(names) // 64) * 64), dtype=bool)
            marks[owner[mine], code] = True
            self.bits.append(np.packbits(marks, axis=1).view(np.uint64))

    def share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        left = np.arange(len(a))
        for bits in self.bits:
            step = max(1, (1 << 20) // bits.shape[1])
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                out[rows] = (bits[a[rows]] & bits[b[rows]]).any(axis=1)
            left = left[~out[left]]
        return out


def _spanning(a: np.ndarray, b: np.ndarray, size: int) -> list:
    """Edges of a spanning forest of the links a-b."""
    parent = list(range(size))
    out = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            parent[u] = v
            out.append((x, y))
    return out


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = 0.9,
    trees: int = 10,
    spill: float = 0.15,
    leaf_size: int = 1500,
    sample_size: int = 50_000,
    block: int = 3000,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Equal vectors are one class, compared once and counted by its size. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing
    and are their own component; vectors of different numbers of dimensions do not link,
    and every number of dimensions has a forest of its own.
    Rows that repeat an id are vectors of their own with that id: ``n_links`` and
    the component hold for the id. A null id takes part with a null component.
    Splits are fitted on at most ``sample_size`` classes (least hash of the
    vector) and ``SAMPLE_BYTES`` of them; the depth follows the number of classes, at most
    20 sample vectors a leaf. Leaves that are still more than twice ``leaf_size`` are split
    again where they are, by up to ``SPLIT_DEPTH`` levels. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(vectors)
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    fine = F.coalesce(
        F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("ok", fine)

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch["v"]:
                x = np.asarray(v, dtype="<f8") + 0.0  # -0.0 and 0.0 are equal
                top = np.abs(x).max()
                raw = (x / top if not 1e-100 < top < 1e100 else x).tobytes()
                out.append((xxhash.xxh3_64_intdigest(raw) - (1 << 63), raw))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "h": [x[0] for x in out], "raw": [x[1] for x in out]})

    good = rows.where("ok and vec_id is not null").select("vec_id", "v").mapInPandas(pack, "vec_id long, h long, raw binary")
    # grouping by the bytes compares them; the class goes by its least id
    classes = good.groupBy("h", "raw").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n"))
    classes = materialize(classes, "vector-classes")
    members = good.join(classes.select("h", "raw", "rep"), ["h", "raw"]).select("vec_id", "rep").distinct()
    # a row for each number of dimensions
    sizes = {x["b"]: x["n"] for x in classes.groupBy(F.length("raw").alias("b")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        linked = spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    else:
        total = sum(sizes.values())
        sample_size = min(sample_size, max(1, SAMPLE_BYTES // max(sizes)))
        chosen = classes.select("raw", "h")
        if total > sample_size:
            chosen = chosen.where(F.shiftrightunsigned(F.xxhash64("h"), 1) < int(sample_size / total * (1 << 63)))
        sample = chosen.select("raw").limit(2 * sample_size).toPandas()["raw"]
        lengths = sample.map(len)
        forests = {}
        for width, count in sizes.items():
            own = sample[lengths == width]
            wanted = max(0, math.ceil(math.log2(max(1, count) / leaf_size)))
            depth = min(wanted, max(0, int(math.log2(max(1, len(own)) / 20))))
            fitted = _matrix(own) if len(own) else np.zeros((0, width // 8))
            forests[width] = Forest(fitted, trees, depth, spill, seed)
        linked = _compare(classes.select("rep", "n", "raw"), forests, threshold, block, members, leaf_size, spill, seed)
    ids = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"))
    out = ids.join(linked, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _compare(usable: DataFrame, forests: dict, threshold: float, block: int, members: DataFrame, leaf_size: int, spill: float, seed: int) -> DataFrame:
    spark = usable.sparkSession
    shared = spark.sparkContext.broadcast(forests)

    def assign(batches):
        """A vector's leaves in all trees, as numbers that tell tree, dimensions and node;
        those of an earlier tree are less."""
        known = shared.value
        for batch in batches:
            for width, part in batch.groupby(batch["raw"].map(len)):
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    rows, names = [], []
                    for t, r, n in known[width].leaves(_matrix(some["raw"])):
                        rows.append(r)
                        names.append(t << _TREE | n << _NODE)
                    yield _placed(some, np.concatenate(rows), np.concatenate(names))

    placed = usable.select("rep", "n", "raw").mapInPandas(assign, "rep long, n long, raw binary, leaves array<long>")
    placed = _split_again(materialize(placed, "vector-leaves"), leaf_size, spill, seed)
    # the leaves that are dealt in blocks all the same: few, once large ones were split
    per_leaf = placed.select(F.length("raw").alias("width"), F.explode("leaves").alias("leaf")).groupBy("width", "leaf").agg(F.count("*").alias("m"))
    blocks = {(x["width"], x["leaf"]): -(-x["m"] // block) for x in per_leaf.where(F.col("m") > block).collect()}
    cuts = spark.sparkContext.broadcast(blocks)

    def deal(batches):
        """A row per leaf and pair of blocks the vector takes part in."""
        parts = cuts.value
        for batch in batches:
            out = []
            for rep, n, raw, leaves in zip(batch["rep"].tolist(), batch["n"].tolist(), batch["raw"], batch["leaves"]):
                packed = np.asarray(leaves, dtype="<i8").tobytes()
                for leaf in leaves.tolist():
                    k = parts.get((len(raw), leaf), 1)
                    mine = xxhash.xxh3_64_intdigest(rep.to_bytes(8, "little", signed=True)) % k if k > 1 else 0
                    for other in range(k):
                        out.append((len(raw), leaf, min(mine, other), max(mine, other), mine, rep, n, raw, packed))
                    if len(out) >= 4000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    names = ["width", "leaf", "i", "j", "mine", "rep", "n", "raw", "leaves"]
    schema = "width int, leaf long, i int, j int, mine int, rep long, n long, raw binary, leaves binary"

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        leaf, i, j = int(group["leaf"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
        mine = group["mine"].to_numpy()
        rep, size, x = group["rep"].to_numpy(), group["n"].to_numpy(), _matrix(group["raw"])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        earlier = _Earlier([np.frombuffer(x, dtype="<i8") for x in group["leaves"]], leaf)
        links = np.zeros(len(rep), dtype=np.int64)
        edges = []
        for at in range(0, len(left), 512):
            a = left[at : at + 512]
            near = x[a] @ x[right].T >= threshold
            if i == j:
                near &= a[:, None] < right[None, :]
            p, q = np.nonzero(near)
            edges += _spanning(a[p], right[q], len(rep))
            new = ~earlier.share(a[p], right[q])
            np.add.at(links, a[p[new]], size[right[q[new]]])
            np.add.at(links, right[q[new]], size[a[p[new]]])
        counted = pd.DataFrame({"a": rep, "b": rep, "links": links})[links > 0]
        kept = _spanning(*np.array(edges, dtype=np.int64).reshape(-1, 2).T, len(rep))
        joined = pd.DataFrame([(rep[u], rep[v], 0) for u, v in kept], columns=["a", "b", "links"])
        return pd.concat([counted, joined]).astype("int64")

    dealt = placed.mapInPandas(deal, schema).repartition(tasks_for(spark) * 4, "width", "leaf", "i", "j")
    found = dealt.groupBy("width", "leaf", "i", "j").applyInPandas(compare, "a long, b long, links long")
    found = materialize(found, "vector-links")
    discard(placed)
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("a <> b"), "a", "b")
    per_class = (
        usable.select(F.col("rep").alias("a"), "n")
        .join(links, "a", "left")
        .join(components.withColumnRenamed("node", "a"), "a", "left")
        .select(
            F.col("a").alias("rep"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "a").alias("component_id"),
        )
    )
    return members.join(per_class, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
