"""Operations on a store of snapshots: information, reconciliation, updates, seeds, bundles and release reports."""

from __future__ import annotations

import hashlib
import json
import re
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.control import canonical, signed, strict_json
from palisade.functions.safefile import read_regular, write_private
from palisade.operators import quality
from palisade.sources import archives, imports

from .snapshots import Store, digest, gate, top_of_each

VERSION = 4
ID = "[a-z0-9][a-z0-9._-]{0,63}"
#: The tables of a vulnerability snapshot, and what each must find in another (column, table, its column).
TABLES = ("advisories", "packages", "ledger", "errors")
KEYS = {"packages": ("advisory_id", "advisories", "id")}
ECOSYSTEMS = ("PyPI", "npm", "Go", "crates.io", "Maven", "NuGet", "RubyGems", "Packagist")
STAGE, BATCH, BUNDLE = "palisade.stage", "palisade.stage-batch", "palisade.bundle"


def _sha(raw: bytes) -> str:
    return f"sha256:{hashlib.sha256(raw).hexdigest()}"


# Staged artifacts: acquired feeds, kept with digests until they are imported.


def stage_json(raw: bytes, target: str, source_id: str, most: int = 64 << 20) -> dict:
    """Writes a feed's JSON with its digests and count; equal feeds give equal files."""
    value = strict_json(raw, most)
    if not re.fullmatch(ID, source_id) or not isinstance(value, (dict, list)):
        raise ValueError("malformed source id, or no JSON document")
    out = {
        "schema": STAGE, "version": 1, "source_id": source_id, "source_sha256": _sha(raw), "source_size": len(raw), "canonical_payload_sha256": _sha(canonical(value)),
        "record_count": len(value) if isinstance(value, list) else 1, "payload": value,
    }
    write_private(target, canonical(out))
    return out


def stage_batch(feeds_: dict[str, bytes], folder: str) -> dict:
    """Stages several feeds and a manifest of them; all are checked before any is written."""
    for raw in feeds_.values():
        strict_json(raw, 64 << 20)
    entries = []
    for source in sorted(feeds_):
        e = stage_json(feeds_[source], f"{folder}/{source}.json", source)
        entries.append({k: e[k] for k in ("source_id", "source_sha256", "record_count")} | {"path": f"{source}.json"})
    out = {"schema": BATCH, "version": 1, "entries": entries}
    write_private(f"{folder}/manifest.json", canonical(out))
    return out


def verify_staged(path: str) -> dict:
    d = strict_json(read_regular(path, 256 << 20, "staged artifact"), 256 << 20)
    fields = {"schema", "version", "source_id", "source_sha256", "source_size", "canonical_payload_sha256", "record_count", "payload"}
    if not isinstance(d, dict) or set(d) != fields or d["schema"] != STAGE or d["version"] != 1 or not re.fullmatch(ID, str(d["source_id"])):
        raise ValueError("not a staged artifact")
    p = d["payload"]
    if not isinstance(p, (dict, list)) or d["record_count"] != (len(p) if isinstance(p, list) else 1) or d["canonical_payload_sha256"] != _sha(canonical(p)):
        raise ValueError("staged artifact was changed")
    return d


# Snapshots


def tables_of(i: imports.Imported) -> dict[str, DataFrame]:
    flat = i.advisories.select("id", "aliases", "summary", "details", "published", "modified", "withdrawn", "source")
    return {"advisories": flat, "packages": i.packages, "ledger": i.ledger, "errors": i.errors}


def stage(store: Store, snapshot_id: str, source_id: str, source_digest: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Stages an import's tables with where they come from; errors of the import stop it."""
    if not re.fullmatch(ID, snapshot_id) or not re.fullmatch(ID, source_id) or not re.fullmatch("sha256:[0-9a-f]{64}", source_digest):
        raise ValueError("malformed id or digest")
    if "errors" in tables and (bad := tables["errors"].first()):
        raise ValueError(f"import has errors: {bad['reason']}")
    about = store.spark.createDataFrame([(snapshot_id, source_id, source_digest, VERSION)], "snapshot_id string, source_id string, source_digest string, schema_version int")
    return store.stage(snapshot_id, tables | {"about": about})


def stage_signed(store: Store, snapshot_id: str, source_id: str, tables: dict[str, DataFrame], envelope: dict, keys: dict[str, bytes]) -> DataFrame:
    """Stages tables if their digests are those of a manifest that a trusted key has signed."""
    if not signed(envelope, keys):
        raise ValueError("manifest is not signed by a trusted key")
    said = envelope["manifest"]
    for name, df in tables.items():
        if list(digest(df)) != list(said["tables"].get(name, ())):
            raise ValueError(f"{name} is not what the manifest states")
    return stage(store, snapshot_id, source_id, said["source_digest"], tables)


def manifest(store: Store, snapshot_id: str) -> dict:
    """The compact manifest: rows and an order-free digest of each table, and one digest of all."""
    rows = {r["name"]: [r["rows"], r["digest"]] for r in store.manifest(snapshot_id).collect()}
    about = store.table(snapshot_id, "about").first().asDict() if "about" in rows else {}
    out = {"schema_version": VERSION, "snapshot_id": snapshot_id, "source_id": about.get("source_id"), "source_digest": about.get("source_digest"), "tables": rows}
    return out | {"content_digest": _sha(canonical(rows)), "advisory_count": rows.get("advisories", [0])[0], "affected_package_count": rows.get("packages", [0])[0]}


def sign_manifest(store: Store, snapshot_id: str, key_id: str, private: bytes) -> dict:
    from .packs import sign

    return sign({"schema": "palisade.signed-manifest", "version": 1, "manifest": manifest(store, snapshot_id)}, key_id, private)


def quality_gate(store: Store, snapshot_id: str) -> dict:
    """Whether a snapshot is there, staged, what its manifest states, and without rows that lack their other table."""
    state = {r["snapshot_id"]: r["state"] for r in store.states().collect()}.get(snapshot_id)
    there = state in ("staged", "active", "retired")
    names = {r["name"] for r in store.manifest(snapshot_id).collect()} if there else set()
    wrong = [] if not there else store.verify(snapshot_id, {k: v for k, v in KEYS.items() if k in names})
    checks = {"snapshot_exists": there, "snapshot_state": state == "staged", "content": not any("content" in w for w in wrong), "references": not any("without" in w for w in wrong)}
    return {"healthy": all(checks.values()), "checks": checks, "issues": gate(checks) + wrong, "snapshot_id": snapshot_id}


def activate(store: Store, snapshot_id: str) -> str:
    """Activates a staged snapshot that passes the gate."""
    if not (g := quality_gate(store, snapshot_id))["healthy"]:
        raise ValueError("; ".join(g["issues"]))
    store.activate(snapshot_id, KEYS)
    return snapshot_id


def rollback(store: Store, snapshot_id: str) -> str:
    if store.active() == snapshot_id:
        raise ValueError("snapshot is active already")
    store.rollback(snapshot_id, KEYS)
    return snapshot_id


def health(store: Store, snapshot_id: str | None = None) -> dict:
    """Counts of the tables of a snapshot, the active one by default, and whether all can be read."""
    at = snapshot_id or store.active()
    counts, issues = {}, []
    for name in TABLES if at else ():
        try:
            counts[name] = store.table(at, name).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            issues.append(f"table:{name}")
    return {"healthy": not issues, "snapshot_id": at, "active_snapshot": "ok" if store.active() else "absent", "counts": counts, "issues": issues}


def schema_status(store: Store) -> DataFrame:
    """(snapshot_id, schema_version, status): current, older (still read), or newer, which is refused."""
    rows = []
    for r in store.states().where("state in ('staged', 'active', 'retired')").collect():  # a row a snapshot
        names = {m["name"] for m in store.manifest(r["snapshot_id"]).collect()}
        v = store.table(r["snapshot_id"], "about").first()["schema_version"] if "about" in names else None
        rows.append((r["snapshot_id"], v, "unknown" if v is None else "current" if v == VERSION else "older" if v < VERSION else "newer"))
    return store.spark.createDataFrame(rows, "snapshot_id string, schema_version int, status string")


def read(store: Store, name: str, snapshot_id: str | None = None) -> DataFrame:
    """A table of a snapshot, the active one by default. A snapshot of a newer schema than this code knows is refused,
    as what its columns mean is not known; an older one is read as it is (``migrate`` adds columns)."""
    at = snapshot_id or store.active()
    if at is None:
        raise KeyError("no snapshot is active")
    names = {r["name"] for r in store.manifest(at).collect()}
    version = store.table(at, "about").first()["schema_version"] if "about" in names else None
    if version is not None and version > VERSION:
        raise ValueError(f"snapshot {at} has schema {version}, newer than {VERSION}")
    return store.table(at, name)


def migrate(df: DataFrame, schema: str) -> DataFrame:
    """df in a newer schema of the same table: columns that it lacks are null, none is dropped or narrowed."""
    from pyspark.sql.types import StructType

    out = df
    for f in StructType.fromDDL(schema):
        out = out.withColumn(f.name, F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType))
    return out


def info(store: Store) -> dict:
    """What the active snapshot is, verified, without any advisory's content."""
    at = store.active()
    if at is None:
        raise KeyError("no snapshot is active")
    if wrong := store.verify(at, KEYS):
        raise ValueError("; ".join(wrong))
    return {"state": "ok", "active": True} | manifest(store, at)


def reconcile(store: Store) -> dict:
    """All snapshots that verify, and what is wrong with the others; reads only, and names no content."""
    good, issues, sources = [], [], {}
    for r in sorted(store.states().where("state in ('staged', 'active', 'retired')").collect(), key=lambda r: r["snapshot_id"]):
        try:
            m = manifest(store, r["snapshot_id"])
            wrong = store.verify(r["snapshot_id"], {k: v for k, v in KEYS.items() if k in m["tables"]})
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            wrong = ["files are missing"]
        if wrong:
            issues += [{"snapshot_id": r["snapshot_id"], "error": w} for w in wrong]
            continue
        good.append({"snapshot_id": r["snapshot_id"], "state": r["state"], **{k: m[k] for k in ("source_id", "content_digest", "advisory_count", "affected_package_count")}})
        sources[m["source_id"] or "?"] = sources.get(m["source_id"] or "?", 0) + 1
    active = store.active()
    if active is None:
        issues.append({"snapshot_id": "", "error": "no snapshot is active"})
    out = {"state": "reconciliation_failed" if issues else "ok", "active_snapshot_id": active, "valid_snapshot_count": len(good), "invalid_snapshot_count": len({i["snapshot_id"] for i in issues if i["snapshot_id"]}), "source_counts": sources, "snapshots": good, "issues": issues}
    return out | {"report_sha256": _sha(canonical(out))}


# Seeds: small partial databases with a manifest that says so.


def build_seed(store: Store, osv: DataFrame, sources: dict[str, tuple[int, int]], most: int = 500, least: int = 4) -> dict:
    """Stages a seed from OSV records (ecosystem, record): at most ``most`` of each known ecosystem, by id.

    sources: of cisa-kev, epss and ghsa the records and those imported.
    """
    known = osv.where(F.col("ecosystem").isin(*ECOSYSTEMS)).withColumn("id", F.get_json_object("record", "$.id"))
    part = imports.osv(top_of_each(known, "ecosystem", ["id"], most).select("record"))
    good = sorted(r[0] for r in known.select("ecosystem").distinct().collect())
    if len(good) < least:
        raise ValueError("too few ecosystems for a seed")
    tables = tables_of(part)
    n, content = digest(tables["advisories"])
    snapshot_id = f"seed-{content.split(':')[1][:32]}"
    reports = {s: {"status": "complete" if s == "cisa-kev" else "bounded", "records": r, "imported": i} for s, (r, i) in sources.items()}
    reports["osv"] = {"status": "partial", "imported": n, "successful_ecosystems": good, "failed_ecosystems": sorted(set(ECOSYSTEMS) - set(good)), "records_per_ecosystem": most}
    stage(store, snapshot_id, "seed", _sha(canonical(reports)), tables)
    out = {"profile": "seed", "completeness": "partial", "production_full_database": False, "sources": reports, **manifest(store, snapshot_id)}
    return out | {"manifest_sha256": _sha(canonical(out))}


def check_seed(m: dict) -> list[str]:
    """What a seed's manifest lacks."""
    s = m.get("sources") if isinstance(m.get("sources"), dict) else {}
    count = lambda x: type(x) is int and x > 0
    osv = s.get("osv") if isinstance(s.get("osv"), dict) else {}
    good, bad = osv.get("successful_ecosystems", []), osv.get("failed_ecosystems", [])
    checks = {
        "profile": m.get("profile") == "seed" and m.get("completeness") == "partial" and m.get("production_full_database") is False,
        "ecosystems": isinstance(good, list) and len(set(good)) == len(good) >= 4 and set(good) <= set(ECOSYSTEMS) and isinstance(bad, list) and not set(good) & set(bad),
        "advisories": count(m.get("advisory_count")),
        "content_digest": str(m.get("content_digest", "")).startswith("sha256:"),
    }
    for name, status in (("cisa-kev", "complete"), ("epss", "bounded"), ("ghsa", "bounded"), ("osv", "partial")):
        r = s.get(name) if isinstance(s.get(name), dict) else {}
        enough = name == "osv" or (type(r.get("records")) is int and count(r.get("imported")) and r["records"] >= r["imported"])
        checks[f"source {name}"] = r.get("status") == status and count(r.get("imported")) and enough
    return gate(checks)


def contract(store: Store, m: dict) -> list[str]:
    """Where a store's snapshot differs from a manifest of it."""
    states = {r["snapshot_id"]: r["state"] for r in store.states().collect()}
    if states.get(m.get("snapshot_id")) not in ("staged", "active"):
        return ["snapshot is missing"]
    have = manifest(store, m["snapshot_id"])
    wrong = [k for k in ("content_digest", "advisory_count", "affected_package_count", "tables", "source_digest") if k in m and m[k] != have[k]]
    return wrong + store.verify(m["snapshot_id"], KEYS)


def activate_seed(store: Store, m: dict, apply: bool = False) -> dict:
    """Plans, or with apply makes, a seed the active snapshot."""
    if wrong := check_seed(m) + contract(store, m):
        raise ValueError("; ".join(wrong))
    if not str(m["snapshot_id"]).startswith("seed-"):
        raise ValueError("not a seed")
    if apply:
        activate(store, m["snapshot_id"])
    return {"state": "active" if apply else "activation_planned", "profile": "seed", "snapshot_id": m["snapshot_id"]}


def check_global(m: dict, envelope: dict, keys: dict[str, bytes]) -> list[str]:
    """What is wrong with a global database's manifest against its signed copy."""
    digest_ = lambda x: isinstance(x, str) and bool(re.fullmatch("sha256:[0-9a-f]{64}", x))
    member, size = m.get("archive_member"), m.get("database_bytes")
    return gate({
        "signature": signed(envelope, keys) and envelope.get("manifest") == m,
        "profile": (m.get("profile"), m.get("completeness"), m.get("production_full_database")) == ("global-osv", "full-osv-source", False),
        "digests": digest_(m.get("asset_sha256")) and digest_(m.get("database_sha256")),
        "size": type(size) is int and 0 < size <= 32 << 30,
        "member": isinstance(member, str) and archives.safe_name(member) and "/" not in member,
        "snapshot_id": str(m.get("snapshot_id", "")).startswith("global-osv-"),
    })


def install(store: Store, archive: str, m: dict, envelope: dict, keys: dict[str, bytes], check: object = check_global) -> list[str]:
    """Checks a downloaded archive against its signed manifest; the archive's one member is unpacked beside it."""
    if wrong := check(m, envelope, keys):
        raise ValueError("; ".join(wrong))
    raw = hashlib.sha256()
    with open(archive, "rb") as f:
        while part := f.read(1 << 20):
            raw.update(part)
    if f"sha256:{raw.hexdigest()}" != m["asset_sha256"]:
        raise ValueError("archive is not the stated one")
    target = str(Path(archive).with_name(m["archive_member"]))
    archives.extract_single(archive, target, m["archive_member"], m["database_bytes"], m["database_sha256"])
    return [target]


# Bundles for machines without a network.


def export_bundle(store: Store, snapshot_id: str, path: str) -> dict:
    """A tar.gz of a snapshot's tables and manifest; for stores in a local folder."""
    m = manifest(store, snapshot_id)
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "manifest.json").write_bytes(canonical({"schema": BUNDLE, "version": 1, "manifest": m}))
        with tarfile.open(path, "x:gz") as t:
            t.add(f"{folder}/manifest.json", "manifest.json")
            t.add(store.folder(snapshot_id).removeprefix("file:"), "snapshot", filter=lambda i: None if i.name.endswith(".crc") else i)
    return m


def import_bundle(store: Store, path: str, bounds: archives.Bounds = archives.Bounds()) -> dict:
    """Stages a bundle's tables again, if they are what its manifest states; never activates."""
    with tempfile.TemporaryDirectory() as folder:
        archives.extract(path, f"{folder}/bundle", bounds)
        d = strict_json(read_regular(f"{folder}/bundle/manifest.json", 1 << 20, "manifest"), 1 << 20)
        if not isinstance(d, dict) or d.get("schema") != BUNDLE or d.get("version") != 1:
            raise ValueError("not a bundle")
        m = d["manifest"]
        tables = {n: store.spark.read.parquet(f"file:{folder}/bundle/snapshot/{n}") for n in m["tables"]}
        for n, df in tables.items():
            if list(digest(df)) != m["tables"][n]:
                raise ValueError(f"{n} is not what the manifest states")
        store.stage(m["snapshot_id"], tables)
    return m | {"activated": False}


# Release


def production_gate(snapshot: dict) -> list[str]:
    """What a snapshot lacks for a release."""
    text = lambda k: isinstance(snapshot.get(k), str) and bool(snapshot[k])
    r = snapshot.get("reproducibility")
    return gate({
        "build_id": text("build_id"),
        **{k: text(k) and snapshot[k].startswith("sha256:") for k in ("source_digest", "manifest_digest")},
        "reproducibility": isinstance(r, dict) and all(r.get(k) for k in ("deterministic", "python", "platform")),
        **{k: isinstance(snapshot.get(k), list) and bool(snapshot[k]) for k in ("licenses", "attributions")},
        **{k: isinstance(snapshot.get(k), dict) and snapshot[k].get("verified") is True for k in ("manifest_signature", "airgap_bundle")},
    })


def health_report(status: str, records: int, errors: int, invalid: int) -> bool:
    """Whether a database is healthy: active, with a count of records, and without errors or invalid ones."""
    return status == "active" and records >= 0 and not errors and not invalid


def rollback_ready(store: Store, keep: set[str]) -> dict:
    """Whether a snapshot that was active before still is what its manifest states, so that it could be again, and
    what a prune would delete; nothing is applied. A plan that would leave no such snapshot is not ready."""
    plan = store.prune(keep, apply=False)
    retired = sorted(r["snapshot_id"] for r in store.states().where("state = 'retired'").collect())
    wrong = {s: store.verify(s, {k: v for k, v in KEYS.items() if k in {m["name"] for m in store.manifest(s).collect()}}) for s in retired}
    good = [s for s, issues in wrong.items() if not issues]
    return {"ready": any(s not in plan for s in good), "applied": False, "plan": plan, "targets": good, "issues": {s: i for s, i in wrong.items() if i}}


def production_report(snapshot: dict, healthy: bool, sources: DataFrame, rollback: dict | None = None, recovery: dict | None = None, benchmark: dict | None = None) -> dict:
    """Ready if nothing fails: the gate, health, coverage (sources: source, records), and whichever of the rest is given."""
    total = quality.source_coverage(sources).agg(F.count("*").alias("n"), F.coalesce(F.sum("records"), F.lit(0)).alias("t")).first()
    failed = production_gate(snapshot) + gate({
        "database_health": healthy, "source_coverage": bool(total["n"] and total["t"]), "rollback": rollback is None or rollback.get("ready") is True,
        "disaster_recovery": recovery is None or (recovery.get("verified") is True and recovery.get("activated") is False), "benchmark": benchmark is None or benchmark.get("passed") is True,
    })
    return {"ready": not failed, "failed": sorted(failed)}


def default_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root if "://" in root else f"file:{Path(root).absolute()}")


def dumps(report: dict) -> str:
    return json.dumps(report, sort_keys=True, indent=2, default=str)

