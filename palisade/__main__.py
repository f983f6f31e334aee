"""The command line: ``python -m palisade``.

Exit codes: 0 nothing fails, 1 a failing secret or a policy that fails, 2 another failing finding, 3 bad input.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import catalogs, control
from palisade.functions.safefile import read_regular, write_private
from palisade.operators import inventory, lifecycle, policy
from palisade.plans import baselines, packs, reports, scans, store, updates, vulnreports
from palisade.sources import fetch, git, gitleaks, sbom, statements

DIFF_BYTES = 4 << 20


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palisade")
    commands = top.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan", help="findings of a diff, a folder, a history or another scanner's report")
    source = s.add_mutually_exclusive_group(required=True)
    for name in ("--diff", "--dir", "--gitleaks-report", "--gitleaks-binary"):
        source.add_argument(name, metavar="PATH")
    source.add_argument("--staged", action="store_true")
    source.add_argument("--git-history", action="store_true")
    for name in ("--since-ref", "--output", "--allowlist", "--baseline", "--write-baseline", "--config", "--rule-pack", "--rule-keyring", "--vulnerability-db", "--vulnerability-baseline", "--write-vulnerability-baseline", "--vulnerability-policy"):
        s.add_argument(name)
    s.add_argument("--max-commits", type=int, default=100)
    s.add_argument("--format", choices=("json", "markdown", "html", "sarif", "github"), default="json")
    s.add_argument("--profile", choices=tuple(policy.PROFILES))
    s.add_argument("--severity-threshold", choices=("low", "medium", "high", "critical"))
    s.add_argument("--config-check", action=argparse.BooleanOptionalAction, default=None)
    for name in ("--recursive", "--force-baseline", "--force-vulnerability-baseline", "--quiet"):
        s.add_argument(name, action="store_true")
    o = commands.add_parser("osv-import", help="one local advisory feed into a store")
    for name in ("--input", "--db", "--snapshot-id", "--source-id"):
        o.add_argument(name, required=True)
    o.add_argument("--activate", action="store_true")
    v = commands.add_parser("vuln").add_subparsers(dest="action", required=True)
    i = v.add_parser("inventory")
    which = i.add_mutually_exclusive_group(required=True)
    for name in ("--root", "--sbom", "--osv-scanner", "--trivy", "--grype"):
        which.add_argument(name)
    n = v.add_parser("scan")
    n.add_argument("--root", required=True)
    n.add_argument("--database", required=True)
    n.add_argument("--format", choices=("json", "sarif", "markdown", "html", "csv"), default="json")
    for name in ("--output", "--baseline", "--vex", "--suppressions"):
        n.add_argument(name)
    d = commands.add_parser("vuln-db").add_subparsers(dest="action", required=True)
    for action in ("reconcile", "status", "list-snapshots", "source-status", "database-info", "verify", "prune", "rollback", "update", "init-config", "activate", "explain", "fetch"):
        a = d.add_parser(action)
        for name in ("--root", "--snapshot-id", "--source-id", "--input", "--output", "--manifest", "--fingerprint", "--url", "--provenance", "--conditions"):
            a.add_argument(name)
        a.add_argument("--keep-snapshot-id", action="append", default=[])
        a.add_argument("--allowed-host", action="append", default=[])
        a.add_argument("--apply", action="store_true")
    r = commands.add_parser("rules").add_subparsers(dest="action", required=True)
    for action in ("install", "rollback"):
        a = r.add_parser(action)
        a.add_argument("--source", required=action == "install")
        a.add_argument("--destination", required=True)
        a.add_argument("--keyring", required=True)
    h = commands.add_parser("hook", help="scan an agent's change from standard input")
    h.add_argument("--config")
    h.add_argument("--baseline")
    return top


def session() -> SparkSession:
    """The running session, or a local one of all cores."""
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _text(path: str, most: int = DIFF_BYTES) -> str:
    return read_regular(path, most, "input").decode("utf-8", "replace")


def _out(text: str, path: str | None) -> None:
    if path:
        write_private(path, text.encode())
    else:
        sys.stdout.write(text + "\n")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(path, _text(path, 64 << 20))], "path string, text string")


def _config(a: argparse.Namespace) -> control.Config:
    from dataclasses import replace

    c = control.parse_config(read_regular(a.config, control.CONFIG_BYTES, "config")) if a.config else control.Config()
    if getattr(a, "profile", None):
        c = replace(c, profile=a.profile)
    if getattr(a, "severity_threshold", None):
        c = replace(c, threshold=a.severity_threshold)
    return replace(c, config_check=a.config_check) if getattr(a, "config_check", None) is not None else c


def _scan(a: argparse.Namespace, spark: SparkSession) -> int:
    config = _config(a)
    keys = control.parse_keyring(read_regular(a.rule_keyring, control.PACK_BYTES, "keyring")) if a.rule_keyring else {}
    more = control.parse_packs([read_regular(a.rule_pack, control.PACK_BYTES, "pack")], keys) if a.rule_pack else []
    options = {
        "config": config, "packs": more, "allow": policy.parse_allowlist(_text(a.allowlist)) if a.allowlist else [],
        "baseline": baselines.load(spark, a.baseline) if a.baseline else None,
    }
    one = lambda text: scans.diffs(spark.createDataFrame([("input", text)], "diff_id string, text string"), **options)
    if a.dir:
        result = scans.folder(spark, a.dir, a.recursive, **options)
    elif a.diff:
        result = one(_text(a.diff))
    elif a.staged:
        result = scans.diffs(git.staged(spark, "."), **options)
    elif a.git_history:
        result = scans.history(git.history(spark, ".", a.since_ref, a.max_commits), **options)
    else:
        found = gitleaks.load(spark, a.gitleaks_report) if a.gitleaks_report else gitleaks.run(spark, a.gitleaks_binary, ".")
        if options["baseline"] is not None:
            found = policy.apply_baseline(found, options["baseline"])
        result = scans.Result(found, spark.createDataFrame([], "type string, file string, severity string, change_type string, category string"), spark.createDataFrame([], "path string, line int, n_chars int, reason string"))
    if a.write_baseline:
        baselines.write(result.findings, a.write_baseline, overwrite=a.force_baseline)
    found = result.findings.withColumn("rule", F.coalesce("rule", F.lit("imported"))) if "rule" in result.findings.columns else result.findings.withColumn("rule", F.lit("imported"))
    counts = result.summary().first().asDict()
    shown = counts | (result.counters.first().asDict() if result.counters is not None else {})
    _out(reports.document(found, a.format, result.changes, counts=shown), a.output)
    if not a.quiet:
        sys.stderr.write(json.dumps(counts, sort_keys=True) + "\n")
    code = counts["exit_code"]
    if a.dir and a.vulnerability_db:
        vulnerable = _vulnerable(spark, a.dir, a.vulnerability_db)
        if a.write_vulnerability_baseline:
            baselines.write(vulnerable, a.write_vulnerability_baseline, "vulnerability", a.force_vulnerability_baseline)
        if a.vulnerability_baseline:
            vulnerable = inventory.with_baseline(vulnerable, baselines.load(spark, a.vulnerability_baseline, "vulnerability")).findings
        if a.vulnerability_policy and inventory.failed(vulnerable, inventory.load_policy(a.vulnerability_policy)):
            code = code or 1
    return code


def _vulnerable(spark: SparkSession, root: str, database: str) -> DataFrame:
    s = store.default_store(spark, database)
    at = s.active()
    if at is None:
        raise ValueError("no snapshot is active")
    advisories = store.read(s, "advisories", at)
    if "severity" not in advisories.columns:
        advisories = advisories.withColumn("severity", F.lit("unknown"))
    return inventory.findings(inventory.of_folder(spark, root), advisories, store.read(s, "packages", at), at).drop("bad_version")


def _vuln(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.action == "inventory":
        if a.root:
            counts, *rows = inventory.report(inventory.of_folder(spark, a.root))
            named = zip(("components", "unresolved", "warnings"), rows, strict=True)
            _out(store.dumps(counts.first().asDict() | {k: [json.loads(x) for x in df.toJSON().collect()] for k, df in named}), None)
            return 0
        kind = next(k for k in ("sbom", "osv_scanner", "trivy", "grype") if getattr(a, k))
        read = {"sbom": inventory.of_sbom, "osv_scanner": sbom.osv_scanner, "trivy": sbom.trivy, "grype": sbom.grype}[kind]
        rows = read(_texts(spark, getattr(a, kind))).drop("path")
        _out(store.dumps({"source": kind, "rows": sorted((json.loads(x) for x in rows.toJSON().collect()), key=lambda x: json.dumps(x, sort_keys=True))}), None)
        return 3 if kind == "sbom" and not rows.where("reject_reason is not null").isEmpty() else 0
    found = _vulnerable(spark, a.root, a.database)
    if a.vex or a.suppressions:
        vex = statements.vex(_texts(spark, a.vex)).where("reject_reason is null") if a.vex else spark.createDataFrame([], "vulnerability string, products array<string>, status string, justification string")
        quiet = statements.suppressions(_texts(spark, a.suppressions)).where("reject_reason is null") if a.suppressions else spark.createDataFrame([], "fingerprint string, reason string")
        found = lifecycle.annotate(found, vex, quiet)
    at = store.default_store(spark, a.database).active()
    base = baselines.load(spark, a.baseline, "vulnerability") if a.baseline else None
    _out(vulnreports.document(found, at, a.format, base), a.output)
    return 0 if found.isEmpty() else 1


def _store(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.action == "init-config":
        _out(store.dumps(catalogs.update_config()), a.output)
        return 0
    if a.action == "fetch":
        etag, modified = fetch.conditions(a.conditions) if a.conditions else (None, None)
        answer = fetch.download(a.url, a.output, fetch.Policy(frozenset(a.allowed_host)), etag=etag, last_modified=modified)
        said = fetch.provenance(a.source_id, a.url, answer)
        if a.provenance:
            write_private(a.provenance, control.canonical(said))
        _out(store.dumps(said), None)
        return 0
    s = store.default_store(spark, a.root)
    if a.action in ("reconcile", "status", "list-snapshots"):
        r = store.reconcile(s)
        _out(store.dumps(r if a.action == "reconcile" else {"active_snapshot_id": r["active_snapshot_id"], "snapshots": r["snapshots"]}), a.output)
        return 0 if r["state"] == "ok" else 3
    if a.action == "source-status":
        r = store.reconcile(s)
        _out(store.dumps({"sources": r["source_counts"], "issues": r["issues"]}), a.output)
    elif a.action == "database-info":
        _out(store.dumps(store.info(s)), a.output)
    elif a.action == "verify":
        wrong = s.verify(a.snapshot_id, store.KEYS)
        _out(store.dumps({"snapshot_id": a.snapshot_id, "issues": wrong}), a.output)
        return 3 if wrong else 0
    elif a.action == "prune":
        _out(store.dumps({"applied": a.apply, "snapshot_ids": s.prune(set(a.keep_snapshot_id), a.apply)}), a.output)
    elif a.action == "rollback":
        _out(store.dumps({"applied": a.apply, "snapshot_id": store.rollback(s, a.snapshot_id) if a.apply else a.snapshot_id}), a.output)
    elif a.action == "update":
        _out(store.dumps(updates.offline_update(s, a.input, a.source_id, a.snapshot_id, a.apply)), a.output)
    elif a.action == "activate":
        _out(store.dumps(store.activate_seed(s, json.loads(_text(a.manifest)), a.apply)), a.output)
    elif a.action == "explain":
        at = s.active()
        rows = _vulnerable(spark, a.input, a.root).where(F.col("fingerprint") == a.fingerprint).toJSON().collect() if at and a.input else []
        _out(store.dumps([json.loads(x) for x in rows]), a.output)
        return 0 if rows else 3
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "rules":
            keys = control.parse_keyring(read_regular(a.keyring, control.PACK_BYTES, "keyring"))
            rules = packs.install(a.source, a.destination, keys) if a.action == "install" else packs.rollback(a.destination, keys)
            _out(json.dumps({"rules": len(rules), "destination": a.destination}), None)
            return 0
        spark = session()
        if a.command == "scan":
            return _scan(a, spark)
        if a.command == "vuln":
            return _vuln(a, spark)
        if a.command == "vuln-db":
            return _store(a, spark)
        if a.command == "osv-import":
            _out(store.dumps(updates.offline_update(store.default_store(spark, a.db), a.input, a.source_id, a.snapshot_id, a.activate)), None)
            return 0
        diff = control.parse_hook(sys.stdin.buffer.read(control.HOOK_BYTES + 1))
        base = baselines.load(spark, a.baseline) if a.baseline else None
        result = scans.diffs(spark.createDataFrame([("hook", diff)], "diff_id string, text string"), config=_config(a), baseline=base)
        _out(reports.document(result.findings, "json"), None)
        return result.summary().first()["exit_code"]
    except (ValueError, KeyError, OSError) as e:
        sys.stderr.write(json.dumps({"state": "rejected", "error": str(e)}) + "\n")
        return 3


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    sys.exit(main())
