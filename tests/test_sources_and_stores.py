"""Folders, archives, downloads, decisions, stores, reports and the command line."""

import gzip
import io
import json
import os
import struct
import tarfile
import zipfile
from email.message import Message
from urllib.error import HTTPError, URLError

import pytest

from palisade import __main__ as cli
from palisade.functions import catalogs, control, ed25519, safefile
from palisade.operators import decisions, inventory
from palisade.plans import baselines, benchmarks, packs, scans, updates, vulnreports
from palisade.plans import store as stores
from palisade.sources import archives, fetch, files, gitleaks

KEY = bytes(range(32))
KEYS = {"key-one": ed25519.public_key(KEY)}
TOKEN = "ghp_" + "a1B2" * 9
OSV = [{"id": f"OSV-{i}", "modified": "2024", "aliases": [f"CVE-2024-{1000 + i}"], "affected": [{"package": {"ecosystem": "npm", "name": "left"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}]}]} for i in range(3)]


def test_files_are_read_and_written_with_care(tmp_path):
    at = tmp_path / "a"
    safefile.write_private(at, b"x")
    assert safefile.read_regular(at, 1) == b"x" and os.stat(at).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        safefile.write_private(at, b"y", overwrite=False)
    (tmp_path / "link").symlink_to(at)
    (tmp_path / "way").symlink_to(tmp_path)
    for bad in (tmp_path / "link", tmp_path / "way/a", tmp_path, tmp_path / "none"):
        with pytest.raises(ValueError):
            safefile.read_regular(bad, 10)
    with pytest.raises(ValueError):
        safefile.read_regular(at, 0)
    with pytest.raises(ValueError):
        safefile.write_private(tmp_path / "link", b"z")


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in {".env": f"token = {TOKEN}\n", "src/a.py": "x = 1\n", "node_modules/b.js": TOKEN, "pic.png": TOKEN, "package-lock.json": '{"lockfileVersion": 3, "packages": {"node_modules/left": {"version": "1.2.3"}}}', "Pipfile": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "src/big.txt").write_text("y" * (files.MAX_FILE_BYTES + 1))
    (root / "src/link").symlink_to(root / ".env")
    return root


def test_folder_scan(spark, repo):
    r = scans.folder(spark, str(repo), recursive=True)
    assert [(x.file, x.rule_id) for x in r.findings.collect()] == [(".env", "CRT-SEC-003")]
    assert [(x.path, x.reason) for x in r.rejected.collect()] == [("src/big.txt", "file-exceeds-limit")]
    assert {x.file for x in r.changes.collect()} == {".env"} and r.summary().first().exit_code == 1
    assert {x.path for x in files.listing(spark, str(repo)).collect()} == {".env", "pic.png", "package-lock.json", "Pipfile"}
    with pytest.raises(ValueError):
        files.listing(spark, str(repo / "src/link"))


def test_diff_and_history(spark):
    text = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,2 @@\n keep\n+k = '{TOKEN}'\n"
    rows = spark.createDataFrame([("c2", 0, text), ("c1", 1, text), ("bad", 2, "diff --git nonsense")], "diff_id string, seq int, text string")
    r = scans.diffs(rows.drop("seq"))
    assert r.findings.count() == 2 and r.rejected.count() == 1
    assert [(x.seq, x.file, x.line) for x in scans.history(rows).findings.collect()] == [(0, "x.py", 2)]


def test_gitleaks_is_strict(spark, tmp_path):
    good = [{"RuleID": "r", "File": "a.py", "StartLine": 3, "Fingerprint": "f", "Secret": "REDACTED"}] * 2
    at = tmp_path / "r.json"
    at.write_text(json.dumps(good))
    assert gitleaks.load(spark, str(at)).count() == 1
    for change in ({"Secret": "hunter2"}, {"File": "../a"}, {"File": "/a"}, {"StartLine": 0}, {"RuleID": "-"}):
        at.write_text(json.dumps([good[0] | change]))
        with pytest.raises(ValueError):
            gitleaks.load(spark, str(at))


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(3):
            z.writestr(f"{i}.json", json.dumps(OSV[i]))
    small = archives.Bounds(members=3, member_bytes=1000, total_bytes=3000)
    assert archives.directory_size(raw, small)[0] == 3
    with pytest.raises(ValueError):
        archives.directory_size(raw, archives.Bounds(members=2))
    broken = raw.getvalue()[:-22] + b"PK\x05\x06" + struct.pack("<4H2LH", 0, 0, 3, 4, 10, 0, 0)
    with pytest.raises(ValueError):
        archives.directory_size(io.BytesIO(broken), small)
    rows = archives.zip_records(spark.createDataFrame([("a", bytearray(raw.getvalue())), ("b", bytearray(b"none"))], "path string, content binary"), small).collect()
    assert [r.member for r in rows if r.path == "a"] == ["0.json", "1.json", "2.json"] and [r.reject_reason for r in rows if r.path == "b"] == ["no ZIP end record"]
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    assert archives.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"))[0] == 3 and (tmp_path / "out/2.json").exists()
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        t.addfile(tarfile.TarInfo("../x"), io.BytesIO())
    with pytest.raises(ValueError):
        archives.extract(str(tmp_path / "b.tar.gz"), str(tmp_path / "out2"))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"0" * 5000))
    with pytest.raises(ValueError):
        archives.extract(str(tmp_path / "c.gz"), str(tmp_path / "out3"), small)
    assert not (tmp_path / "out2").exists() and not (tmp_path / "out3").exists()


class Server:
    """An opener that answers from a list."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def open(self, request, timeout):
        self.asked.append(dict(request.header_items()))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        a.headers = Message()
        a.headers["ETag"] = "e1"
        a.geturl = lambda: "https://feeds.example/x"
        return a


def error(status, **headers):
    h = Message()
    for k, v in headers.items():
        h[k.replace("_", "-")] = v
    return HTTPError("https://feeds.example/x", status, "no", h, io.BytesIO())


def test_downloads(tmp_path):
    p = fetch.Policy(frozenset({"feeds.example"}), most=100, attempts=4, backoff=2.0)
    waits = []
    s = Server(error(503, Retry_After="7"), URLError("down"), error(429), io.BytesIO(b'{"a": 1}'))
    a = fetch.download("https://feeds.example/x", str(tmp_path / "f"), p, opener=s, sleep=waits.append)
    assert waits == [7.0, 4.0, 8.0] and a.size == 8 and (tmp_path / "f").read_bytes() == b'{"a": 1}'
    said = fetch.persist("osv", "https://feeds.example/x", a, b'{"a": 1}', str(tmp_path / "g"), str(tmp_path / "g.prov"))
    assert fetch.conditions(str(tmp_path / "g.prov")) == ("e1", None) and said["payload_sha256"] == a.digest
    (tmp_path / "g.prov").write_bytes((tmp_path / "g.prov").read_bytes().replace(b"e1", b"e2"))
    with pytest.raises(ValueError):
        fetch.conditions(str(tmp_path / "g.prov"))
    s = Server(error(304))
    assert fetch.fetch("https://feeds.example/x", p, etag="e1", opener=s)[1] is None and s.asked[0]["If-none-match"] == "e1"
    for url in ("http://feeds.example/x", "https://other.example/x", "https://u:p@feeds.example/"):
        with pytest.raises(ValueError):
            fetch.fetch(url, p, opener=Server())
    with pytest.raises(ValueError):
        fetch.fetch("https://feeds.example/x", p, opener=Server(io.BytesIO(b"0" * 101)))
    with pytest.raises(ConnectionError):
        fetch.fetch("https://feeds.example/x", p, opener=Server(error(404)))
    assert [fetch.retryable(x) for x in (408, 429, 500, 404)] == [True, True, True, False]


def test_decisions_are_exported(spark):
    adv = spark.createDataFrame([("A", ["CVE-1-1"], "x"), ("B", ["CVE-1-1"], "y")], "id string, aliases array<string>, source string")
    ledger = decisions.record(spark.createDataFrame([("merge", ["A", "B"], "same", ["me"])], "decision_type string, advisory_ids array<string>, reason string, provenance array<string>"), adv).drop("reject_reason")
    raw = decisions.export(ledger)
    assert decisions.load(raw, adv).collect() == ledger.collect()
    with pytest.raises(ValueError):
        decisions.load(raw.replace(b"same", b"sane"), adv)


def rule_pack(version):
    rule = {"name": "ACME_KEY", "regex": "acme_[a-z]{8}", "severity": "high", "description": "d", "rule_id": "CRT-SEC-900", "category": "secret", "confidence": "high", "remediation": "r", "kind": "secret", "file_globs": []}
    return packs.dumps(packs.sign({"schema": "palisade.rule-pack", "version": 1, "pack": {"pack_version": version, "rules": [rule]}}, "key-one", KEY))


def test_rule_packs(tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    for v in ("2024.01.1", "2024.02.1"):
        source.write_bytes(rule_pack(v))
        rules = packs.install(str(source), str(target), KEYS)
    assert b"2024.02.1" in target.read_bytes()
    packs.rollback(str(target), KEYS)
    assert b"2024.01.1" in target.read_bytes()
    assert packs.qualify(rules, {"CRT-SEC-900": (["acme_abcdefgh"], ["acme_1"])}) == {} and packs.qualify(rules, {}) != {}
    with pytest.raises(ValueError):
        packs.install(str(source), str(target), {"key-one": ed25519.public_key(bytes(32))})


def test_ed25519_of_the_rfc():
    private = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(private).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert ed25519.sign(private, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")


def test_store(spark, tmp_path):
    s = stores.default_store(spark, str(tmp_path / "db"))
    for k, feed in (("one", OSV[:2]), ("two", OSV)):
        (tmp_path / k).write_text(json.dumps({"vulns": feed}))
    m = updates.offline_update(s, str(tmp_path / "one"), "osv", "snap-one", apply=True)
    assert (m["advisory_count"], m["affected_package_count"], stores.info(s)["snapshot_id"]) == (2, 2, "snap-one")
    assert updates.offline_update(s, str(tmp_path / "two"), "osv", "snap-two")["state"] == "staged"
    assert stores.quality_gate(s, "snap-two")["healthy"] and not stores.quality_gate(s, "none")["healthy"]
    stores.activate(s, "snap-two")
    r = stores.reconcile(s)
    assert (r["state"], r["active_snapshot_id"], r["valid_snapshot_count"], r["source_counts"]) == ("ok", "snap-two", 2, {"osv": 2})
    assert stores.rollback(s, "snap-one") == s.active() == "snap-one"
    with pytest.raises(ValueError):
        stores.rollback(s, "snap-one")
    assert stores.health(s)["counts"]["advisories"] == 2 and {x.status for x in stores.schema_status(s).collect()} == {"current"}
    signed = stores.sign_manifest(s, "snap-two", "key-one", KEY)
    tables = {n: s.table("snap-two", n) for n in stores.TABLES}
    other = stores.default_store(spark, str(tmp_path / "db2"))
    stores.stage_signed(other, "snap-two", "osv", tables, signed, KEYS)
    with pytest.raises(ValueError):
        stores.stage_signed(other, "snap-three", "osv", tables | {"advisories": tables["advisories"].limit(1)}, signed, KEYS)
    stores.export_bundle(s, "snap-two", str(tmp_path / "b.tar.gz"))
    third = stores.default_store(spark, str(tmp_path / "db3"))
    assert stores.import_bundle(third, str(tmp_path / "b.tar.gz"))["activated"] is False and third.active() is None and stores.contract(third, stores.manifest(s, "snap-two")) == []
    assert stores.rollback_ready(s, {"snap-two"})["plan"] == []
    (tmp_path / "bad").write_text('[{"id": "X"}]')
    with pytest.raises(ValueError):
        updates.offline_update(s, str(tmp_path / "bad"), "osv", "snap-bad")


def test_seed_and_full_update(spark, tmp_path):
    s = stores.default_store(spark, str(tmp_path / "db"))
    rows = [(e, json.dumps({"id": f"{e}-{i}", "modified": "1", "affected": [{"package": {"ecosystem": e, "name": "n"}}]})) for e in ("PyPI", "npm", "Go", "Maven") for i in range(3)]
    m = stores.build_seed(s, spark.createDataFrame(rows, "ecosystem string, record string"), {"cisa-kev": (9, 2), "epss": (5, 1), "ghsa": (3, 3)}, most=2)
    assert m["advisory_count"] == 8 and stores.check_seed(m) == [] and stores.activate_seed(s, m)["state"] == "activation_planned"
    assert stores.activate_seed(s, m, apply=True)["snapshot_id"] == s.active()
    assert stores.check_seed(m | {"completeness": "full"}) == ["profile"]
    with pytest.raises(ValueError):
        stores.activate_seed(s, m | {"advisory_count": 7})
    kev = {"vulnerabilities": [{k: "x" for k in ("vendorProject", "product", "vulnerabilityName", "shortDescription", "requiredAction")} | {"cveID": c, "dateAdded": "2024-01-01", "dueDate": "2024-01-02"} for c in ("CVE-2024-1000", "CVE-1999-1000")]}
    paths = {"osv": OSV, "cisa-kev": kev, "nvd": {}}
    for name, value in paths.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    r = updates.Update(s, "snap-full", {n: str(tmp_path / f"{n}.json") for n in paths}).run()
    assert r["sources"] == ["cisa-kev", "osv"] and s.table(r["snapshot_id"], "kev").count() == s.table(r["snapshot_id"], "kev_unresolved").count() == 1


def test_staged_artifacts_and_catalogs(tmp_path):
    out = stores.stage_batch({"b": b'[{"x": 1}]', "a": b'{"y": 2}'}, str(tmp_path / "s"))
    assert [e["source_id"] for e in out["entries"]] == ["a", "b"] and stores.verify_staged(str(tmp_path / "s/b.json"))["record_count"] == 1
    (tmp_path / "s/b.json").write_bytes((tmp_path / "s/b.json").read_bytes().replace(b'"x":1', b'"x":2'))
    with pytest.raises(ValueError):
        stores.verify_staged(str(tmp_path / "s/b.json"))
    c = catalogs.with_profile(catalogs.update_config(), "core")
    assert {x["source_id"] for x in c["sources"] if x["enabled"]} == {"cisa-kev", "epss", "github-advisories", "osv"}
    ok = {"build_id": "b", "source_digest": "sha256:a", "manifest_digest": "sha256:b", "reproducibility": {"deterministic": True, "python": "3", "platform": "x"}, "licenses": [1], "attributions": [1], "manifest_signature": {"verified": True}, "airgap_bundle": {"verified": True}}
    assert stores.production_gate(ok) == [] and stores.production_gate(ok | {"licenses": [], "source_digest": "a"}) == ["licenses", "source_digest"]
    m = {"profile": "global-osv", "completeness": "full-osv-source", "production_full_database": False, "asset_sha256": "sha256:" + "0" * 64, "database_sha256": "sha256:" + "0" * 64, "database_bytes": 5, "archive_member": "x.db", "snapshot_id": "global-osv-1"}
    envelope = packs.sign({"manifest": m}, "key-one", KEY)
    assert stores.check_global(m, envelope, KEYS) == [] and stores.check_global(m | {"database_bytes": 0}, envelope, KEYS) == ["signature", "size"]


def test_baselines_and_benchmarks(spark, tmp_path):
    prints = spark.createDataFrame([("sha256:" + c * 64,) for c in "bab"], "fingerprint string")
    assert baselines.write(prints, str(tmp_path / "b")) == 2 and baselines.load(spark, str(tmp_path / "b")).count() == 2
    with pytest.raises(FileExistsError):
        baselines.write(prints, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        baselines.load(spark, str(tmp_path / "b"), "vulnerability")
    cases = [{"case_id": str(i), "expected": i < 8, "observed": i % 4 != 0, "elapsed_ms": float(i)} for i in range(10)]
    (tmp_path / "f").write_text(json.dumps({"schema": benchmarks.SCHEMA, "version": 1, "cases": cases, "golden": {"min_recall": 0.9}}))
    r = benchmarks.run_fixture(spark, str(tmp_path / "f"), max_p95_ms=5)
    assert r["failed"] == ["recall", "latency_p95"] and r["p95"] == 9.0
    (tmp_path / "p").write_text(json.dumps({"schema": inventory.POLICY_SCHEMA, "version": 1, "fail_on": "high", "unknown": "fail"}))
    assert inventory.load_policy(str(tmp_path / "p")) == {"fail_on": "high", "unknown": "fail"}


def test_command_line(spark, repo, tmp_path, capsys, monkeypatch):
    assert cli.main(["scan", "--dir", str(repo), "--recursive", "--format", "sarif", "--output", str(tmp_path / "o"), "--write-baseline", str(tmp_path / "base")]) == 1
    assert json.loads((tmp_path / "o").read_text())["runs"][0]["results"][0]["ruleId"] == "CRT-SEC-003"
    assert cli.main(["scan", "--dir", str(repo), "--baseline", str(tmp_path / "base"), "--no-config-check", "--quiet"]) == 0
    (tmp_path / "feed").write_text(json.dumps(OSV))
    assert cli.main(["osv-import", "--input", str(tmp_path / "feed"), "--db", str(tmp_path / "db"), "--snapshot-id", "s1", "--source-id", "osv", "--activate"]) == 0
    capsys.readouterr()
    assert cli.main(["vuln", "inventory", "--root", str(repo)]) == 0
    said = json.loads(capsys.readouterr().out)
    assert (said["component_count"], [w["path"] for w in said["warnings"]]) == (1, ["Pipfile"])
    assert cli.main(["vuln", "scan", "--root", str(repo), "--database", str(tmp_path / "db"), "--format", "csv"]) == 1
    assert capsys.readouterr().out.count("OSV-") >= 3
    assert cli.main(["vuln-db", "database-info", "--root", str(tmp_path / "db")]) == 0
    assert cli.main(["scan", "--diff", str(tmp_path / "none")]) == 3
    text = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,2 @@\n keep\n+k = '{TOKEN}'\n"
    hook = json.dumps({"schema": "s", "version": 1, "event": "post-change", "diff": text}).encode()
    monkeypatch.setattr("sys.stdin", type("S", (), {"buffer": io.BytesIO(hook)}))
    assert cli.main(["hook"]) == 1


def test_reports_are_strict(spark):
    row = {"type": "vulnerability", "advisory_id": "A", "aliases": ["b", "a", "a"], "component_purl": "pkg:npm/a@1", "manifest_path": "x|y.json", "status": "affected", "method": "m", "confidence": "high", "fixed_versions": ["2"], "explanation": "=1+1\nnext", "fingerprint": "sha256:1", "snapshot_id": "s1", "source": "osv", "severity": "odd", "extra": 5}
    df = spark.createDataFrame([row], "type string, advisory_id string, aliases array<string>, component_purl string, manifest_path string, status string, method string, confidence string, fixed_versions array<string>, explanation string, fingerprint string, snapshot_id string, source string, severity string, extra int")
    d = json.loads(vulnreports.document(df, "s1", "json"))
    assert d["summary"]["unknown"] == 1 and d["findings"][0]["aliases"] == ["a", "b"] and d["findings"][0]["extra"] == 5
    assert "x\\|y.json" in vulnreports.document(df, "s1", "markdown") and "<br>" in vulnreports.document(df, "s1", "markdown")
    assert "'=1+1" in vulnreports.document(df, "s1", "csv") and '{""extra"":5}' in vulnreports.document(df, "s1", "csv") and "<td>A</td>" in vulnreports.document(df, "s1", "html")
    gone = spark.createDataFrame([("sha256:2",)], "fingerprint string")
    assert json.loads(vulnreports.document(df, "s1", "json", gone))["resolved_fingerprints"] == ["sha256:2"]
    for bad in ({"snapshot_id": "s2"}, {"manifest_path": "../x"}, {"fingerprint": ""}):
        with pytest.raises(ValueError):
            vulnreports.document(spark.createDataFrame([row | bad], df.schema), "s1", "json")
    with pytest.raises(ValueError):
        vulnreports.validated(df.withColumnRenamed("extra", "raw_record"), "s1")
    assert control.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
