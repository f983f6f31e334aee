"""Connected components kept from batch to batch.

The table of labels grows by the batch's new nodes and by which components it joined; what is there is
never rewritten. A batch's nodes are looked up by a broadcast of those nodes, the batch's edges are drawn between the
components found, and only that small graph is solved. So what is shuffled is in proportion to the batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.tables import materialize
from palisade.operators.components import components
from palisade.operators.correlate import normal_alias
from palisade.sources.commits import Commits

#: Rows that may be broadcast, counted first; parts after which the labels are written anew.
BROADCAST_ROWS, PARTS = 1_000_000, 32
LABELS = "node string, root string"
#: Stands before an alias as a node, so that the least node of a component is an advisory.
ALIAS = "\U0010ffff"


class Labels:
    """(node, root) of components under a folder; a root is the least node of its component."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Commits(spark, f"{self.root}/_commits")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(LABELS).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], LABELS)

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.select("node", "root").write.parquet(f"{self.root}/{folder}")
        return folder

    @staticmethod
    def _found(names: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of a table (node, root) whose node is among names; the table is not shuffled unless names are very many."""
        few = names.count() <= BROADCAST_ROWS
        return table.join(F.broadcast(names) if few else names, "node")

    def _joined(self, named: DataFrame, merges: DataFrame) -> DataFrame:
        """named (node, root) with roots followed through the merges to where they end now."""
        while True:
            over = self._found(named.select(F.col("root").alias("node")).distinct(), merges).select(F.col("node").alias("root"), F.col("root").alias("next"))
            over = materialize(over, "over")
            if over.isEmpty():
                return named
            named = materialize(named.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "named")

    def add(self, edges: DataFrame) -> None:
        """Adds undirected edges (a, b); loops add their node. Null ends are ignored. If another writer is faster, Conflict is raised and nothing is added."""
        number, state = self.log.last()
        parts, merges = state.get("parts", []), state.get("merges", [])
        e = materialize(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a is not null and b is not null").distinct(), "edges")
        nodes = materialize(e.select(F.col("a").alias("node")).unionAll(e.select("b")).distinct(), "nodes")
        named = self._joined(materialize(self._found(nodes, self._read(parts)), "named"), self._read(merges))
        fresh = nodes.join(named, "node", "left_anti")
        where = materialize(named.unionByName(fresh.select("node", F.col("node").alias("root"))), "where")
        end = lambda c: where.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        small = components(e.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        small = materialize(small, "small")
        own = fresh.join(small, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        # a component that was there and whose root is no longer the least
        gone = small.where("node <> root").join(named.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
        self.log.put(number + 1, {"parts": [*parts, self._write(own)], "merges": [*merges, self._write(gone)]})
        if len(parts) >= PARTS:
            self.compact()

    def all(self) -> DataFrame:
        """Every node with its root."""
        state = self.log.last()[1]
        merges = self._read(state.get("merges", []))
        over = merges
        moved = not merges.isEmpty()
        while moved:  # chains of merges, each round of twice the length
            step = over.join(merges.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            step = materialize(step.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
            moved, over = not step.where("moved").isEmpty(), step.select("node", "root")
            merges = over
        last = over.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return self._read(state.get("parts", [])).join(last, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    def compact(self) -> None:
        """Writes all labels as one part without merges."""
        number = self.log.last()[0]
        self.log.put(number + 1, {"parts": [self._write(self.all())], "merges": []})

    def add_advisories(self, advisories: DataFrame) -> None:
        """Adds advisories (id, aliases): those of one alias, or that are another's alias, are linked."""
        names = F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
        each = advisories.select(F.col("id").alias("a"), F.explode(F.transform(names, normal_alias)).alias("alias")).where("alias is not null")
        alone = advisories.select(F.col("id").alias("a"), F.col("id").alias("b"))
        self.add(each.select("a", F.concat(F.lit(ALIAS), "alias").alias("b")).unionByName(alone))

    def groups(self) -> DataFrame:
        """(root, advisory_id) of the advisories."""
        return self.all().where(~F.col("node").startswith(ALIAS)).select("root", F.col("node").alias("advisory_id"))
