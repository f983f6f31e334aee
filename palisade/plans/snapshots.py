"""Immutable snapshots of a set of tables, in any store that Spark reads.

A snapshot is a folder of Parquet tables and a manifest table of each one's count and digest. What is
begun, staged, active, retired or pruned stands in a log of states (``sources.commits``) whose next number one
writer gets: every change reads the last state, checks it, and is in force only if nobody was faster. A
snapshot's content never changes, so an earlier one can be active again.

Whoever stages gets a token, and writes to a folder of that name. If the stage dies, ``recover`` gives its
name up; the token is then worth nothing, so a writer that comes back late neither finishes the stage nor
touches the files of the one that followed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.sources.commits import Commits, Conflict

STATES = "snapshot_id string, state string, at long, reason string"
#: How often a change that does not depend on the active snapshot is tried anew if another was faster.
TRIES = 20


class Fenced(RuntimeError):
    """A stage that was given up, or whose name another has."""


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) that does not depend on the rows' order: SHA-256 of sums of parts of the rows'
    SHA-256, of which each task adds up its own."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", i * 8 + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("d")).first()
    return r["n"], f"sha256:{r['d']}"


class Store:
    """Snapshots under a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/_commits")

    def _state(self) -> tuple[int, dict[str, dict]]:
        number, state = self.commits.last()
        return number, state.get("snapshots", {})

    def _change(self, how: Callable[[dict[str, dict], int], None], tries: int = TRIES) -> None:
        """Writes the next state: how changes the last one's snapshots, and raises if it must not."""
        for left in range(tries - 1, -1, -1):
            number, snapshots = self._state()
            how(snapshots, number + 1)
            try:
                return self.commits.put(number + 1, {"snapshots": snapshots})
            except Conflict:
                if not left:
                    raise

    def states(self) -> DataFrame:
        """The last state of each snapshot; a few rows, of the log's last file."""
        rows = [(k, v["state"], v["at"], v.get("reason", "")) for k, v in sorted(self._state()[1].items())]
        return self.spark.createDataFrame(rows, STATES)

    def abandoned(self, snapshot_id: str) -> bool:
        """Whether a stage of that name was begun or staged, and is not and never was active."""
        return self._state()[1].get(snapshot_id, {}).get("state") in ("begun", "staged")

    def begin(self, snapshot_id: str) -> str:
        """Claims a name; returns the token that the stage is written and finished under."""
        token = uuid.uuid4().hex

        def claim(snapshots: dict[str, dict], number: int) -> None:
            if snapshots.get(snapshot_id, {}).get("state", "given up") != "given up":
                raise FileExistsError(snapshot_id)
            snapshots[snapshot_id] = {"state": "begun", "at": number, "token": token}

        self._change(claim)
        return token

    def finish(self, snapshot_id: str, token: str) -> None:
        """Makes a begun stage a staged one, unless it was given up."""

        def done(snapshots: dict[str, dict], number: int) -> None:
            own = snapshots.get(snapshot_id, {})
            if own.get("token") != token or own["state"] != "begun":
                raise Fenced(snapshot_id)
            own.update(state="staged", at=number)

        self._change(done)

    def stage(self, snapshot_id: str, tables: dict[str, DataFrame]) -> DataFrame:
        """Writes the tables and their manifest; fails if the snapshot is there."""
        token = self.begin(snapshot_id)
        at = f"{self.root}/{snapshot_id}/{token}"
        for name, df in sorted(tables.items()):
            df.write.mode("error").parquet(f"{at}/{name}")
        self.spark.createDataFrame([(n, *digest(self.spark.read.parquet(f"{at}/{n}"))) for n in sorted(tables)], "name string, rows long, digest string").coalesce(1).write.parquet(f"{at}/_manifest")
        self.finish(snapshot_id, token)
        return self.manifest(snapshot_id)

    def recover(self) -> list[str]:
        """Gives up all stages that were begun and not finished, and deletes what they left; their names."""
        names = [k for k, v in self._state()[1].items() if v["state"] == "begun"]
        for name in names:
            self.discard(name, ("begun",))
        return sorted(names)

    def discard(self, snapshot_id: str, states: tuple[str, ...] = ("begun", "staged")) -> None:
        """Gives up a stage, whose name may then be staged anew."""

        def drop(snapshots: dict[str, dict], number: int) -> None:
            if snapshots.get(snapshot_id, {}).get("state") not in states:
                raise Fenced(snapshot_id)
            snapshots[snapshot_id].update(state="given up", at=number)

        at = self.folder(snapshot_id)
        self._change(drop)
        self._delete(at)

    def folder(self, snapshot_id: str) -> str:
        """Where a snapshot's tables are."""
        own = self._state()[1].get(snapshot_id)
        if own is None:
            raise KeyError(snapshot_id)
        return f"{self.root}/{snapshot_id}/{own['token']}"

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def manifest(self, snapshot_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(snapshot_id)}/_manifest")

    def table(self, snapshot_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(snapshot_id)}/{name}")

    def verify(self, snapshot_id: str, keys: dict[str, tuple[str, str, str]] | None = None) -> list[str]:
        """What is wrong: counts or digests that differ, or rows of a table whose column (keys: table to
        column, other table, its column) is not in another."""
        wrong = [f"{r['name']}: content differs from the manifest" for r in self.manifest(snapshot_id).collect() if digest(self.table(snapshot_id, r["name"])) != (r["rows"], r["digest"])]
        for name, (col, other, key) in (keys or {}).items():
            lost = self.table(snapshot_id, name).join(self.table(snapshot_id, other).select(F.col(key).alias(col)), col, "left_anti")
            if not lost.isEmpty():
                wrong.append(f"{name}: rows without {other}")
        return wrong

    def active(self) -> str | None:
        return next((k for k, v in self._state()[1].items() if v["state"] == "active"), None)

    def activate(self, snapshot_id: str, keys: dict[str, tuple[str, str, str]] | None = None) -> None:
        """Verifies a snapshot and makes it the active one; the one before is retired, not changed.

        If another snapshot has become active since this began, Conflict is raised and that one stays.
        """
        known = self._state()[1]
        if snapshot_id not in known or known[snapshot_id]["state"] in ("begun", "given up", "pruned"):
            raise KeyError(snapshot_id)
        before = next((k for k, v in known.items() if v["state"] == "active"), None)
        if wrong := self.verify(snapshot_id, keys):
            raise ValueError("; ".join(wrong))

        def point(snapshots: dict[str, dict], number: int) -> None:
            own = snapshots.get(snapshot_id, {})
            if own.get("token") != known[snapshot_id]["token"] or own["state"] not in ("staged", "retired", "active"):
                raise Fenced(snapshot_id)
            now = next((k for k, v in snapshots.items() if v["state"] == "active"), None)
            if now != before:
                raise Conflict(f"{now} became active meanwhile")
            if now:
                snapshots[now].update(state="retired", at=number)
            own.update(state="active", at=number)

        self._change(point)

    rollback = activate

    def prune_plan(self, keep: set[str]) -> DataFrame:
        """Snapshots that may go: neither active nor being staged nor to be kept."""
        return self.states().where(F.col("state").isin("staged", "retired") & ~F.col("snapshot_id").isin(sorted(keep) or [""])).select("snapshot_id")

    def prune(self, keep: set[str], apply: bool = False) -> list[str]:
        """The plan's ids; with apply the log says that they are gone, and their folders are deleted."""
        ids = sorted(r[0] for r in self.prune_plan(keep).collect())
        for s in ids if apply else ():

            def drop(snapshots: dict[str, dict], number: int, s: str = s) -> None:
                if snapshots[s]["state"] not in ("staged", "retired"):
                    raise Conflict(f"{s} is {snapshots[s]['state']}")
                snapshots[s].update(state="pruned", at=number)

            at = self.folder(s)
            self._change(drop)
            self._delete(at)
        return ids


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, same) of two manifests, by a full outer join."""
    j = a.select("name", F.col("digest").alias("x")).join(b.select("name", F.col("digest").alias("y")), "name", "full_outer")
    return j.select("name", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def top_of_each(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, by order: a cap that is asked for, as when a seed is cut."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def gate(checks: dict[str, bool | None]) -> list[str]:
    """Names of checks that are not true, in order."""
    return [name for name, ok in sorted(checks.items()) if ok is not True]
