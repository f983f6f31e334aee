"""What several training-data operators share: tables written to the shared folder,
connected components, and size checks before a broadcast."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.tables import shuffles_dropped

#: Rows of a table of longs that may be broadcast; its count is taken first.
BROADCAST_ROWS = 1_000_000


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


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read again.

    This cuts the lineage; the files outlive lost executors, and the shuffles that made them are dropped.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palisade-{uuid.uuid4().hex}/{name}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = table.sparkSession
    for at in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch of whole texts holds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it an Arrow batch holds no more rows; the session's own setting comes back. Jobs must run within it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``__n``, its place from 0 in the order, and no task that holds all rows: rows are
    dealt in ranges of the order, and the ranges' counts, one a partition, give each its start."""
    placed = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    at, starts = 0, []
    for r in sorted(placed.groupBy("__p").count().collect()):
        starts.append((r["__p"], at))
        at += r["count"]
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __start long"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return placed.join(known, "__p").withColumn("__n", F.col("__start") + place).drop("__p", "__start")


def row_key(text: str | Column = "text", doc_id: str | Column = "doc_id") -> Column:
    """Two independent longs for a row's id and text; rows that agree in both agree in it.

    One hash of 64 bits would join unlike rows by chance among tens of billions.
    """
    of = (F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("\x00")))
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit("second"), *of).alias("b"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs' rows whose row_key is not among those of gone, a table of one column of row keys."""
    keys = gone.toDF("__rk").distinct()
    return docs.withColumn("__rk", row_key()).join(maybe_broadcast(keys, gone.count()), "__rk", "left_anti").select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root).

    root is the least node of the component. Every node hooks to its least neighbour,
    the pointers are doubled until each names a root, and the edges are contracted to
    roots; this repeats on the contracted graph, so the rounds grow with the logarithm
    of the longest chain. Only nodes that have an edge to another node are returned;
    null ends and loops are ignored. Every round is written to the shared folder.
    """
    e = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    found = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "up")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = materialize(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            up = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            last = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(last, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        to_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = materialize(
            e.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if found is None:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return found
