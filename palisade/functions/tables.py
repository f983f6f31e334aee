"""Tables written to the shared folder, to cut lineage where a result is read again."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_built: dict[tuple, object] = {}


def built(key: tuple, make: Callable[[], object]) -> object:
    """What make builds, kept for the running application: a large expression over fixed column names
    takes seconds to build node by node, and is the same in every plan."""
    own = (SparkContext._active_spark_context.applicationId, *key)
    if own not in _built:
        if len(_built) > 200:
            _built.clear()
        _built[own] = make()
    return _built[own]


def constant(value: object, kind: str) -> Column:
    """A list as a column that the optimizer turns into one literal; hundreds of single ones take seconds to build."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A temporary folder is used only by a local session that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go as it ends. Else they stay until the driver's heap is collected, which
    with a large heap is seldom: those of all steps then stand on disk at once. The session's own setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read again.

    This cuts the lineage; the files outlive lost executors, and the shuffles that made them are dropped.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palisade-{uuid.uuid4().hex}/{name}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files give fewer partitions than there are; a large table stays as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running(df: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """df with ``upto``, the sum of weight over a group's rows up to each in the order, and no task that
    holds a group: rows are dealt in ranges of (by, order), and sums of whole ranges go ahead."""
    placed = materialize(df.repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*by, "__p").agg(F.sum(weight).alias("__s"))  # a row for each range of a group
    ahead = F.sum("__s").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    ahead = materialize(sums.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).drop("__s"), "ahead")
    inside = F.sum(weight).over(Window.partitionBy(*by, "__p").orderBy(order))
    held = placed.withColumn("__in", inside)
    same = [held[c].eqNullSafe(ahead[c]) for c in (*by, "__p")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return held.join(ahead, on).select(*[held[c] for c in df.columns], (held["__in"] + ahead["__ahead"]).alias("upto"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with ``rank``, a row's place from 0 in the order, and no task that holds all rows: rows are dealt
    in ranges of the order, and the ranges' counts, one a partition, give each its start."""
    placed = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    at, starts = 0, []
    for r in sorted(placed.groupBy("__p").count().collect()):
        starts.append((r["__p"], at))
        at += r["count"]
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __start long"))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return placed.join(known, "__p").withColumn("rank", (F.col("__start") + inside).cast("long")).drop("__p", "__start")
