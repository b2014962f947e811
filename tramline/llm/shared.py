"""What the operators of this subpackage share: materialised tables, table
readers and connected components.

Lineage is cut by writing Parquet into the folder the cluster names in
``spark.checkpoint.dir`` and reading it back, so a lost executor costs only the
tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; one of our own
    only where none is set and driver and executors are one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_tramline_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark._tramline_shared = own
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tramline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """Write the rows into the shared folder and read them back. ``few_files``: rows
    of a few numbers, dealt evenly by the shuffle before, are written by no more
    tasks than two a core, or an eighth of the shuffle's."""
    path = fresh_path(df.sparkSession, name)
    if few_files:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, tasks_for(df.sparkSession) // 8))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that later stored tables have taken the place
    of. What was selected from one without another store in between goes with it."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = file.rsplit("/", 1)[0]
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows that a Python worker is handed at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_BYTES``: batches are cut
    by number of rows only, unless this setting says otherwise, and long texts make
    them as large as they are long. A setting of the session's own stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null id where ids go through pandas, which would make them floats.
NULL_ID = -(1 << 63)


def id_in(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_out(column: str):
    return F.when(F.col(column) != NULL_ID, F.col(column))


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def evaluated_once(udf):
    """The function as one the optimizer does not copy: a filter on its result is else put
    below with a copy of its own, and a join's other side gets it too, so a task runs it
    twice and in two workers."""
    return udf.asNondeterministic()


def possible_ids(ids: DataFrame, column: str, bits: int = 1 << 23):
    """A function of a column of ids: whether each may be one of ``ids``. It holds a fixed
    number of bits, so it passes more others when it fills up, and never fails one that
    is there. The bits are set by an aggregation over words of 64, which tasks begin on
    their own, and of which there are ``bits`` / 64 at most."""

    def slot(value):
        return F.pmod(F.xxhash64(value), F.lit(bits))

    marks = ids.select(slot(F.col(column).cast("long")).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = marks.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(one).alias("set")).toPandas()
    held = np.zeros(bits // 64, dtype="<u8")
    held[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(zlib.compress(held.tobytes(), 1))
    tables: list = []

    @F.pandas_udf("boolean")
    def maybe(slots: pd.Series) -> pd.Series:
        if not tables:
            tables.append(np.frombuffer(zlib.decompress(shared.value), dtype=np.uint8))
        at = slots.to_numpy()
        return pd.Series((tables[0][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    maybe = evaluated_once(maybe)
    return lambda value: maybe(slot((F.col(value) if isinstance(value, str) else value).cast("long")))


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; component = smallest node.

    Alternates large-star and small-star steps until every node hangs on its
    component's smallest one, so the number of rounds grows with the logarithm of
    the longest chain. A round is aggregations and joins on the node, which Spark
    can split when a node is hot; no neighbourhood is ever collected. ``links`` is a
    stored table, as it is read more than once. Empty input gives no rows; self
    links and nulls are ignored, and links may repeat.
    """
    both = links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    stored = None
    edges = both.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        edges = materialize(small.where("u <> v").distinct(), "edges", few_files=True)
        if stored is not None:
            discard(stored)
        stored = edges
        # star forest: every u has one parent, and no parent has one of its own
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("v", F.lit(0), F.lit(1))
        )
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        several = ends.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0))).first()[0]
        if several is None or several <= 1:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )

