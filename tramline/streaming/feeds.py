"""Streams of realtime rows: the newest row of each key, and whole snapshots of which each
takes the place of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_rows(stream: DataFrame, target: str, key: str, checkpoint: str, at: str = "timestamp"):
    """Keep the newest row per key of a stream under ``target``: rows of a batch are united
    with those kept; of rows of one time the one greatest in the other columns stays.
    Every batch is written beside the last under its number, so a batch that is repeated
    after a failure changes nothing; ``read_latest`` takes the greatest that is whole."""

    def unite(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/n={number - 1}").unionByName(batch)
        columns = [c for c in batch.columns if c not in (key, at)]
        newest = rows.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("r")).select(key, f"r.{at}", *[f"r.{c}" for c in columns])
        newest.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/n={number}")
        _forget(batch.sparkSession, f"{target}/n={number - 2}")

    return stream.writeStream.foreachBatch(unite).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_entities(stream: DataFrame, target: str, key: str, checkpoint: str, limit: int | None = None, at: str = "timestamp"):
    """Follow a feed whose snapshots are whole (``snapshot``, ``position``, ``made_at`` as the
    feed's data source has them): under ``target`` are the entities of the newest snapshot,
    with ``since``, the snapshot from which on each has been there, and under
    ``target``-changes what came (new), went (gone) or differs (changed) with each batch.

    An entity that a later snapshot lacks is removed, all of them by an empty one. With
    ``limit``, so is one whose own time ``at`` is more than so many seconds before the
    snapshot was made. Of rows with one key the first in the feed stays; rows without a
    key are passed over. A batch of several snapshots goes to the last; a batch without
    any changes nothing."""

    def replace(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c not in ("position", "snapshot", "made_at")]
        state = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema.fields)}, since long"
        before = spark.read.schema(state).parquet(f"{target}/n={number - 1}") if number else spark.createDataFrame([], state)
        last = batch.agg(F.max("snapshot")).first()[0]
        if last is None:
            after = before
        else:
            rows = batch.where((F.col("snapshot") == last) & (F.col("position") >= 0) & F.col(key).isNotNull())
            if limit is not None:
                rows = rows.where(F.col(at).isNull() | F.col("made_at").isNull() | (F.col("made_at") - F.col(at) <= limit))
            first = rows.groupBy(key).agg(F.min("position").alias("position"))
            rows = rows.join(first, [key, "position"], "left_semi")
            after = rows.join(before.select(key, "since"), key, "left").withColumn("since", F.coalesce("since", F.lit(last)))
        after.select(*batch.columns, "since").write.mode("overwrite").parquet(f"{target}/n={number}")
        now = spark.read.schema(state).parquet(f"{target}/n={number}")
        whole = F.struct(*[F.col(c) for c in columns if c != key])
        one, other = before.select(key, whole.alias("old")), now.select(key, whole.alias("new"))
        both = one.join(other, key, "full_outer")
        change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        both.select(key, change.alias("change"), F.lit(last).cast("long").alias("snapshot")).where("change is not null").write.mode("overwrite").parquet(f"{target}-changes/n={number}")
        _forget(spark, f"{target}/n={number - 2}")

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the greatest batch that was written to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(target)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [int(x.getPath().getName()[2:]) for x in files.listStatus(root) if x.getPath().getName().startswith("n=") and files.exists(hadoop.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{target}/n={max(whole)}")
