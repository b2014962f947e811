"""Walking transfers: stations, pathways, streets; and their merge."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import STREET_RADIUS, WALK_METRES_PER_SECOND

TRANSFER = "from_stop_id long, to_stop_id long, min_walk_seconds int, type string"


def station_transfers(stops: DataFrame) -> DataFrame:
    """All ordered pairs of a station's platforms, 60 seconds each."""
    a = stops.where("parent_station is not null").select(F.col("stop_id").alias("from_stop_id"), "parent_station")
    b = a.select(F.col("from_stop_id").alias("to_stop_id"), "parent_station")
    return a.join(b, "parent_station").where("from_stop_id <> to_stop_id").select(
        "from_stop_id", "to_stop_id", F.lit(60).alias("min_walk_seconds"), F.lit("station").alias("type")
    )


def stop_spots(stops: DataFrame) -> DataFrame:
    """(stop_id, spot, lat, lon, parent_station): stops, stations apart, with their places. A
    spot is named by the least stop there; stops of no known place have none."""
    rows = stops.select("stop_id", "stop_lat", "stop_lon", "parent_station", "location_type")
    there = F.expr("not (location_type <=> 1) and stop_lat is not null and stop_lon is not null")
    located = rows.where(there).groupBy(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")).agg(F.min("stop_id").alias("spot"))
    lat, lon = (F.when(there, F.col(c)) for c in ("stop_lat", "stop_lon"))
    return rows.select("stop_id", lat.alias("lat"), lon.alias("lon"), "parent_station").join(located, ["lat", "lon"], "left").select("stop_id", "spot", "lat", "lon", "parent_station")


def spot_ways(spots: DataFrame, radius: float) -> DataFrame:
    """(spot, to_spot, min_walk_seconds) of places within the radius, each from itself too.

    Cells are as wide as the radius at the largest latitude there is, so the nine
    cells around a place hold every place in reach and pairs meet by an equi-join."""
    located = spots.where("spot is not null and spot = stop_id").select("spot", "lat", "lon")
    top = located.agg(F.max(F.abs("lat")).alias("top"))
    height = radius / 110_000.0
    cells = located.crossJoin(F.broadcast(top)).select(  # one row
        "spot", "lat", "lon", F.floor(F.col("lat") / height).alias("y"),
        F.floor(F.col("lon") / (F.lit(height) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.col("top") + height)))))).alias("x"),
    )
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = cells.withColumn("d", F.explode(near)).select(
        F.col("spot").alias("from"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y")
    )
    metres = S.metres_between(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon"))
    pairs = around.join(cells, ["x", "y"]).withColumn("metres", metres).where(F.col("metres") <= radius)
    return pairs.select(F.col("from").alias("spot"), F.col("spot").alias("to_spot"), S.walk_seconds(F.col("metres")).alias("min_walk_seconds"))


#: Stops of a place that are paired at a time, and pairs of stops for one task.
BLOCK, TASK_PAIRS = 256, 4_000_000


def street_transfers(stops: DataFrame, radius: float = STREET_RADIUS, apart: bool = False) -> DataFrame:
    """Pairs of stops, stations apart, within the radius, both directions; ``apart``: none of
    one station.

    Distances are found once for two places. Their stops are paired block by block, and
    the pairs of blocks dealt to tasks by the number of rows that come of them."""
    spots = stop_spots(stops).where("spot is not null")
    ways = spot_ways(spots, radius)
    many = spots.groupBy("spot").agg(F.count("*").alias("n"))
    pairs = ways.join(many, "spot").join(many.select(F.col("spot").alias("to_spot"), F.col("n").alias("m")), "to_spot").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tasks = max(int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // TASK_PAIRS) + 1)
    part = F.pmod(F.xxhash64("stop_id"), F.ceil(F.col("n") / BLOCK))
    blocks = spots.join(many, "spot").groupBy("spot", part.alias("part")).agg(F.collect_list(F.struct("stop_id", "parent_station")).alias("a"))
    others = blocks.select(F.col("spot").alias("to_spot"), F.col("part").alias("to_part"), F.col("a").alias("b"))
    met = ways.join(blocks, "spot").join(others, "to_spot").repartition(tasks, "spot", "part", "to_spot", "to_part")
    rows = met.select("b", "min_walk_seconds", F.explode("a").alias("a")).select("a", "min_walk_seconds", F.explode("b").alias("b")).where("a.stop_id <> b.stop_id")
    if apart:
        rows = rows.where("a.parent_station is null or b.parent_station is null or a.parent_station <> b.parent_station")
    return rows.select(F.col("a.stop_id").alias("from_stop_id"), F.col("b.stop_id").alias("to_stop_id"), "min_walk_seconds", F.lit("street").alias("type"))


def merged_walks(stops: DataFrame, radius: float = STREET_RADIUS) -> DataFrame:
    """``merge_transfers`` of stations and streets, whose pairs need not meet: a street
    between two platforms of one station is left out as it is made."""
    return station_transfers(stops).unionByName(street_transfers(stops, radius, apart=True))


def pathway_edges(pathways: DataFrame) -> DataFrame:
    """Directed edges with seconds: given, else by length, else a minute."""
    seconds = F.coalesce("traversal_time", F.round(F.col("length") / WALK_METRES_PER_SECOND).cast("int"), F.lit(60))
    there = pathways.select(F.col("from_stop_id").alias("u"), F.col("to_stop_id").alias("v"), seconds.alias("s"))
    back = pathways.where("is_bidirectional <=> 1").select(F.col("to_stop_id").alias("u"), F.col("from_stop_id").alias("v"), seconds.alias("s"))
    return there.union(back).where("u is not null and v is not null and s is not null")


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) by spreading the least node; as many rounds as a pathway
    network is wide."""
    from ..checkpoints import materialize

    both = materialize(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        spread = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("least"))
        new = materialize(labels.join(spread, "node").select("node", F.least("component", "least").alias("component"), (F.col("least") < F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def pathway_transfers(stops: DataFrame, pathways: DataFrame) -> DataFrame:
    """Shortest walks along pathways from every known stop to every other, through
    nodes that need not be known. One group per connected pathway network, that
    is, per station."""
    edges = pathway_edges(pathways)
    known = stops.select(F.col("stop_id").alias("node")).distinct().withColumn("known", F.lit(True))
    labels = _components(edges)
    placed = edges.join(labels.withColumnRenamed("node", "u"), "u")
    for end in ("u", "v"):
        placed = placed.join(known.select(F.col("node").alias(end), F.col("known").alias(f"{end}_known")), end, "left")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        ways: dict = {}
        ends = set()
        for u, v, s, x, y in zip(group["u"], group["v"], group["s"], group["u_known"], group["v_known"]):
            ways.setdefault(u, []).append((v, s))
            ends |= {n for n, k in ((u, x), (v, y)) if k is True}
        out = []
        for source in sorted(ends):
            done: dict = {}
            heap = [(0, source)]
            while heap:
                at, node = heapq.heappop(heap)
                if node in done:
                    continue
                done[node] = at
                for to, s in ways.get(node, ()):
                    if to not in done:
                        heapq.heappush(heap, (at + s, to))
            out += [(source, n, int(s), "pathway") for n, s in done.items() if n in ends and n != source]
        return pd.DataFrame(out, columns=["from_stop_id", "to_stop_id", "min_walk_seconds", "type"])

    return placed.groupBy("component").applyInPandas(solve, TRANSFER)


def merge_transfers(*groups: DataFrame) -> DataFrame:
    """One row per directed pair: station before pathway before street, then the
    shortest walk."""
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    rank = F.when(F.col("type") == "station", 0).when(F.col("type") == "pathway", 1).otherwise(2)
    best = every.groupBy("from_stop_id", "to_stop_id").agg(F.min(F.struct(rank.alias("rank"), "min_walk_seconds", "type")).alias("best"))
    return best.select("from_stop_id", "to_stop_id", F.col("best.min_walk_seconds").alias("min_walk_seconds"), F.col("best.type").alias("type"))


def overlay(stops: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stops with the other feed's parents and stations, and the crosswalk.

    Stops match by stop_code; a matched platform gets the parent of the least
    matching id, stations whose id is new are added, and every matching other id
    is mapped to the least stop id of its code."""
    parents = others.where("stop_code is not null and parent_station is not null").groupBy("stop_code").agg(F.min_by("parent_station", "stop_id").alias("found"))
    linked = stops.join(parents, "stop_code", "left").withColumn("parent_station", F.coalesce("found", "parent_station")).select(*stops.columns)
    new = others.where("location_type = 1").join(stops.select("stop_id"), "stop_id", "left_anti").select(*stops.columns)
    whole = linked.unionByName(new)
    codes = whole.where("stop_code is not null").select("stop_code", "stop_id")
    crosswalk = others.select(F.col("stop_id").alias("rt_stop_id"), "stop_code").join(codes, "stop_code")
    return whole, crosswalk.groupBy("rt_stop_id").agg(F.min("stop_id").alias("stop_id"))
