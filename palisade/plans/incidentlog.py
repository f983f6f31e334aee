"""Incidents kept from run to run, as snapshots of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.tables import materialize
from palisade.operators import incidents
from palisade.plans.snapshots import Store


class IncidentLog:
    """The incidents of a root folder. Each run stages a snapshot of all incidents and of its deltas and
    makes it the active one, so a run that dies leaves the one before in force."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def current(self) -> DataFrame:
        active = self.store.active()
        return self.store.table(active, "incidents") if active else incidents.none_yet(self.spark)

    def last_run(self) -> int:
        active = self.store.active()
        return int(active.split("-")[1]) if active else 0

    def advance(self, found: DataFrame | None = None, changes: DataFrame | None = None, external: DataFrame | None = None, *, scope: str, unread: DataFrame | None = None) -> int:
        """Merges a run's findings, configuration changes and external observations; returns the run's number.

        unread: (path) of files that the run could not read whole (rejected rows); incidents of these stay open.
        """
        run = self.last_run() + 1
        stored = self.current()
        seen = materialize(incidents.observations(found, changes, external), "observations")  # the scan runs once
        current = incidents.facts(seen, scope)
        hidden = None
        if unread is not None:
            hidden = self.places().join(unread.select("path").distinct(), "path", "left_semi").select("subject").distinct()
        merged, deltas = incidents.merge(stored, current, run, scope, unread=hidden)
        placed = seen.select("observation_id", "path")
        places = current.select("subject", F.explode("observation_ids").alias("observation_id")).join(placed, "observation_id").select("subject", "path").distinct()
        tables = {"incidents": merged, "deltas": deltas, "places": self.places().unionByName(places).distinct()}
        name = f"run-{run}"
        if self.store.abandoned(name):  # a run of that number died before it was active
            self.store.discard(name)
        self.store.stage(name, tables)
        self.store.activate(name)
        return run

    def places(self) -> DataFrame:
        """(subject, path) of all subjects that were ever seen."""
        active = self.store.active()
        return self.store.table(active, "places") if active else self.spark.createDataFrame([], "subject string, path string")

    def deltas(self, run: int) -> DataFrame:
        return self.store.table(f"run-{run}", "deltas")
