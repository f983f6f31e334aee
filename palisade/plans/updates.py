"""Updates of a store from feeds in files, which executors read; a feed never passes the driver.

An update of several sources keeps each source's tables as soon as they are made, and a log says which are
done and of what input. Begun again after a crash, it takes those up and makes only the rest.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.catalogs import PROFILES
from palisade.sources import feeds, imports
from palisade.sources.commits import Commits, Conflict

from .snapshots import Store, digest
from .store import ID, activate, manifest, stage, tables_of

#: Where a feed's one document has its list, if not under the usual names (fixed values).
LISTS = {"cisa-kev": "vulnerabilities", "epss": "data", "nvd": "vulnerabilities"}
#: Sources of advisories, in order, and those that say more of advisories.
ADVISORIES, MORE = ("osv", "github-advisories", "cve-v5", "rustsec"), ("cisa-kev", "epss", "vulnrichment", "nvd")
#: CISA's SSVC decisions are taken with any profile that takes CVE records.
WITH = {"vulnrichment": "cve-v5"}
_ADVISORY = ("id", "aliases", "summary", "details", "published", "modified", "withdrawn", "source")


def feed_rows(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """(path, record): the records of a feed, a file or folder. Lines of .jsonl files are records; another file is one
    JSON document, which the task that reads it takes apart."""
    if path.rstrip("/").endswith(".jsonl"):
        return spark.read.text(path).select(F.lit(path).alias("path"), F.col("value").alias("record")).where(F.trim("record") != "")
    whole = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    return feeds.records(whole, LISTS.get(source_id))


def source_digest(spark: SparkSession, path: str) -> str:
    """A digest of a feed's lines, whatever their order, from partial sums of the tasks."""
    return digest(spark.read.text(path))[1]


def _errors(bad: DataFrame, source: str) -> DataFrame:
    return bad.select(F.lit(source).alias("source_id"), F.col("cve_id").alias("id"), F.lit(None).cast("string").alias("content_digest"), "reason")


def load(rows: DataFrame, source: str, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a source's records make; those that say more of advisories need the alias index."""
    if source in ("osv", "rustsec"):
        return tables_of(imports.osv(rows, source))
    if source in ("github-advisories", "cve-v5"):
        t = tables_of((imports.ghsa if source == "github-advisories" else imports.cve_v5)(rows))
        if "events" in t["packages"].columns:
            t["packages"] = t["packages"].withColumn("ranges", F.array("events")).drop("events")
        return t
    if source in ("cisa-kev", "epss"):
        hit, rest, bad = (imports.kev if source == "cisa-kev" else imports.epss)(rows, index, True)
        name = source.removeprefix("cisa-")
        return {name: hit, f"{name}_unresolved": rest, "errors": _errors(bad, source)}
    if source == "vulnrichment":
        hit, rest, bad = imports.enrichment(feeds.vulnrichment(rows), index, strict=False)
        return {"vulnrichment": hit, "vulnrichment_unresolved": rest, "errors": _errors(bad, source)}
    if source == "nvd":
        t = imports.nvd(rows, index)
        missing = t["errors"].where("reason = 'advisory-not-found'")
        return {f"nvd_{k}": v for k, v in t.items() if k != "errors"} | {"nvd_unresolved": missing, "errors": _errors(t["errors"].where("reason <> 'advisory-not-found'"), "nvd")}
    raise ValueError(f"unsupported source: {source}")


class Update:
    """An update of a store under a name, from feeds (source id: path); ``run`` may be called until it gets through."""

    def __init__(self, store: Store, name: str, paths: dict[str, str], profile: str = "core") -> None:
        if not re.fullmatch(ID, name):
            raise ValueError("malformed name")
        chosen = PROFILES[profile][0]
        self.store, self.spark, self.name = store, store.spark, name
        self.paths = {s: p for s, p in paths.items() if s in chosen or WITH.get(s) in chosen}
        self.root = f"{store.root}/_updates/{name}"
        self.log = Commits(self.spark, f"{self.root}/_done")

    def done(self) -> dict[str, dict]:
        """The sources that are made: input (its digest), folder and tables of each."""
        return self.log.last()[1].get("sources", {})

    def _keep(self, source: str, entry: dict) -> None:
        while True:
            number, state = self.log.last()
            try:
                return self.log.put(number + 1, {"sources": state.get("sources", {}) | {source: entry}})
            except Conflict:
                continue

    def _table(self, source: str, name: str) -> DataFrame | None:
        entry = self.done().get(source)
        return self.spark.read.parquet(f"{self.root}/{entry['folder']}/{name}") if entry and name in entry["tables"] else None

    def make(self, source: str, said: str, index: DataFrame | None = None) -> bool:
        """Makes and keeps a source's tables unless they are there for the same input; whether it made them.

        A source with a bad record is named and not kept; what other sources made stays.
        """
        if self.done().get(source, {}).get("input") == said:
            return False
        tables = load(feed_rows(self.spark, self.paths[source], source), source, index)
        if bad := tables["errors"].first():
            raise ValueError(f"source {source} has errors: {bad['reason']}")
        folder = f"{source}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            if name != "errors":
                df.write.parquet(f"{self.root}/{folder}/{name}")
        self._keep(source, {"input": said, "folder": folder, "tables": sorted(set(tables) - {"errors"})})
        return True

    def _all(self, name: str, sources: list[str]) -> DataFrame:
        parts = [t for s in sources if (t := self._table(s, name)) is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def run(self, apply: bool = False) -> dict:
        """Makes what is missing, then stages all as one snapshot, named by its content; with apply it is activated."""
        first = [s for s in ADVISORIES if s in self.paths]
        if not first:
            raise ValueError("no source of advisories")
        inputs = {s: source_digest(self.spark, p) for s, p in sorted(self.paths.items())}
        made = [s for s in first if self.make(s, inputs[s])]
        advisories = self._all("advisories", first).select(*_ADVISORY)
        index = imports.correlate.alias_index(advisories)
        base = ",".join(inputs[s] for s in first)  # what says more is made anew if the advisories are others
        more = [s for s in MORE if s in self.paths]
        made += [s for s in more if self.make(s, f"{inputs[s]};{base}", index)]
        tables = {"advisories": advisories, "packages": self._all("packages", first), "ledger": self._all("ledger", first)}
        tables["errors"] = self.spark.createDataFrame([], "source_id string, id string, content_digest string, reason string")
        for s in more:
            tables |= {n: self._table(s, n) for n in self.done()[s]["tables"]}
        content = digest(self.spark.createDataFrame(sorted(inputs.items()), "source string, input string"))[1]
        snapshot_id = f"{self.name}-{content.split(':')[1][:24]}"
        state = {r["snapshot_id"]: r["state"] for r in self.store.states().collect()}.get(snapshot_id)
        if state == "begun":  # the stage of a run that died
            self.store.discard(snapshot_id, ("begun",))
            state = None
        if state in (None, "given up"):
            stage(self.store, snapshot_id, "full", content, tables)
        if apply and state != "active":
            activate(self.store, snapshot_id)
        return manifest(self.store, snapshot_id) | {"state": "active" if apply else "staged", "sources": sorted(self.paths), "made": made}


def offline_update(store: Store, path: str, source_id: str, snapshot_id: str, apply: bool = False) -> dict:
    """Stages one local feed as a snapshot; with apply it becomes the active one."""
    said = source_digest(store.spark, path)
    stage(store, snapshot_id, source_id, said, tables_of(imports.osv(feed_rows(store.spark, path, source_id), source_id)))
    if apply:
        activate(store, snapshot_id)
    return manifest(store, snapshot_id) | {"state": "active" if apply else "staged", "activated": apply}
