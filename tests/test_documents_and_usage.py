"""Report documents in parts, what executors took, and the operators of reports and inventories."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from palisade.operators import decisions, inventory, scan
from palisade.plans import benchmarks, reports
from palisade.plans import store as stores
from palisade.sources import sbom


def findings(spark, n):
    kind = F.when(F.col("id") % 3 == 0, "policy").otherwise("secret")
    return spark.range(n).select(
        kind.alias("type"), F.lit("P|N").alias("pattern_name"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("severity"), F.concat(F.lit("src/<a>"), F.col("id").cast("string")).alias("file"), F.col("id").cast("int").alias("line"),
        F.lit("secret value").alias("matched_text"), F.lit("a secret value").alias("line_content"), F.lit("r").alias("rule"), F.concat(F.lit("R-"), (F.col("id") % 4).cast("string")).alias("rule_id"), F.lit("c").alias("category"), F.lit("high").alias("confidence"),
        F.lit("do").alias("remediation"), F.concat(F.lit("sha256:"), F.sha2(F.col("id").cast("string"), 256)).alias("fingerprint"),
    )


CHANGES = [("config", ".env", "high", "modified", "ENV"), ("config", "a.yml", "low", "added", "CI")]


@pytest.fixture
def changes(spark):
    return spark.createDataFrame(CHANGES, "type string, file string, severity string, change_type string, category string")


def test_documents_of_every_kind(spark, changes, tmp_path):
    found = findings(spark, 20)
    texts = {k: reports.document(found, k, changes) for k in ("json", "sarif", "markdown", "html", "github")}
    assert not [k for k, t in texts.items() if "secret value" in t]
    d = json.loads(texts["json"])
    assert d["summary"]["total_findings"] == 22 and [x["fingerprint"] for x in d["findings"]] == sorted(x["fingerprint"] for x in d["findings"]) and len(d["findings"]) == 20
    assert {x["file"] for x in d["config_changes"]} == {".env", "a.yml"} and {x["matched_text"] for x in d["findings"]} == {"[REDACTED]"}
    run = json.loads(texts["sarif"])["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert len(run["results"]) == 20 and all(rules[r["ruleIndex"]] == r["ruleId"] for r in run["results"])
    m = texts["markdown"]
    assert m.index("## Secrets") < m.index("## Policies") < m.index("## Configuration changes") < m.index("## What to do") and m.count("P\\|N") == 13 and "| Total findings | 22 |" in m
    assert texts["html"].count("<tr>") >= 22 and "src/&lt;a&gt;1" in texts["html"] and "<h2>Policies</h2>" in texts["html"]
    ET.fromstring("<x>" + texts["html"].split("</h1>", 1)[1].replace("</html>", "") + "</x>")
    assert texts["github"].count("::") == 40
    none = reports.document(found.limit(0), "markdown")
    assert "## Secrets" not in none and json.loads(reports.document(found.limit(0), "json", changes.limit(0)))["findings"] == []
    with pytest.raises(ValueError):
        reports.document(found, "other")


def test_a_large_document_in_parts(spark, changes, tmp_path):
    found = findings(spark, 50_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_parts(reports.lines(found, "json", changes), f"file:{tmp_path}/parts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-")]) > 1
    n = reports.join_parts(spark, f"file:{tmp_path}/parts", f"file:{tmp_path}/report.json")
    raw = (tmp_path / "report.json").read_bytes()
    d = json.loads(raw)
    assert len(raw) == n and len(d["findings"]) == 50_000 and len({x["file"] for x in d["findings"]}) == 50_000 and len(d["config_changes"]) == 2
    assert [x["fingerprint"] for x in d["findings"]] == sorted(x["fingerprint"] for x in d["findings"])
    assert json.loads(reports.document(found, "json", changes)) == d


def test_usage_of_executors(spark):
    with benchmarks.Usage(spark) as usage:
        spark.range(300_000).withColumn("k", F.col("id") % 1000).groupBy("k").agg(F.sum("id").alias("s")).orderBy("s").collect()
    r = usage.table().first()
    assert r.stages >= 2 and r.tasks >= 2 and r.executor_cpu_ms > 0 and r.peak_execution_kib > 0 and r.shuffle_kib > 0 and r.executor_run_ms > 0
    with benchmarks.Usage(spark) as nothing:
        pass
    assert nothing.row["tasks"] == 0


def test_secret_matches_take_the_first_of_each_rule(spark):
    token = "ghp_" + "A" * 36
    rows = [("Dockerfile", 1, f"FROM python:latest {token} ghp_{'B' * 36}"), ("b", 2, "password=REDACTED_VALUE"), ("c", 3, "nothing")]
    got = scan.secret_matches(spark.createDataFrame(rows, "path string, line int, content string")).collect()
    assert [(g.line, g.text) for g in got if g.rule_id == "CRT-SEC-003"] == [(1, token)]
    assert not [g for g in got if not g.rule_id.startswith("CRT-SEC")] and [g.line for g in got if g.rule_id == "CRT-SEC-014"] == [2]


def test_reports_of_evidence_and_boms(spark):
    rows = spark.createDataFrame([("p", t, e, n, v, i, []) for t, e, n, v, i in (("b", "npm", "x", "1", "V2"), ("a", "npm", "x", "1", "V2"), ("a", "npm", "x", "1", "V1"), ("a", None, "z", "1", "V9"))], "path string, target string, ecosystem string, package string, version string, vulnerability string, aliases array<string>")
    counts, ordered = sbom.evidence_report(rows)
    assert [(r.target, r.vulnerability) for r in ordered.collect()] == [("a", "V9"), ("a", "V1"), ("a", "V2"), ("b", "V2")]
    assert counts.first().asDict() == {"path": "p", "finding_count": 4, "vulnerability_count": 3}
    boms = [("c", '{"bomFormat":"CycloneDX","specVersion":"1.5","components":[{"name":"b","version":"1"},{"name":"a","version":"1","purl":"pkg:npm/a@1"},{"name":"","version":"1"}]}'), ("s", '{"spdxVersion":"SPDX-2.3","packages":[{"name":"p","versionInfo":"2"}]}'), ("u", "{}")]
    reports_, parts = inventory.sbom_report(spark.createDataFrame(boms, "path string, text string"))
    assert {(r.path, r.format, r.spec_version, r.state, r.component_count, r.rejected_count) for r in reports_.collect()} == {("c", "cyclonedx", "1.5", "rejected", 2, 1), ("s", "spdx", "SPDX-2.3", "ok", 1, 0), ("u", "unknown", None, "unsupported", 0, 0)}
    assert [r.name for r in parts.collect()] == ["b", "p", "a"]


def test_cpe_mappings_are_reported_in_order(spark):
    cpe = "cpe:2.3:a:v:{}:1:*:*:*:*:*:*:*"
    rows = [(cpe.format(i), f"pkg:npm/a@{i}", "high", i != 2, "seen") for i in range(5)]
    frame = lambda r: spark.createDataFrame(r, "cpe string, purl string, confidence string, operator_approved boolean, rationale string")
    head, mappings = decisions.cpe_mapping_report(frame(rows))
    ids = [m.mapping_id for m in mappings.collect()]
    assert head.first().mapping_count == 4 and ids == sorted(ids)
    assert decisions.cpe_mapping_report(frame(rows[::-1]))[0].first() == head.first() != decisions.cpe_mapping_report(frame(rows[:4]))[0].first()
    assert decisions.cpe_mapping_report(frame(rows).limit(0))[0].first().mapping_count == 0


def test_a_newer_schema_is_refused(spark, tmp_path):
    s = stores.default_store(spark, f"{tmp_path}/db")
    about = lambda v: spark.createDataFrame([("x", "osv", "d", v)], "snapshot_id string, source_id string, source_digest string, schema_version int")
    t = spark.range(1)
    with pytest.raises(KeyError):
        stores.read(s, "t")
    s.stage("new", {"t": t, "about": about(stores.VERSION + 1)})
    s.stage("old", {"t": t, "about": about(stores.VERSION - 1)})
    s.activate("old")
    assert stores.read(s, "t").count() == 1
    with pytest.raises(ValueError, match="newer"):
        stores.read(s, "t", "new")


def test_inventories_of_many_repositories(spark):
    lock = '{"lockfileVersion": 3, "packages": {"node_modules/a": {"version": "1.0.0"}}}'
    rows = [("org/one", "package-lock.json", lock), ("org/two", "package-lock.json", lock), ("org/two", "sub/package-lock.json", lock), ("org/two", "requirements.txt", "a==1\n"), ("org/two", "Pipfile", "x"), ("org/two", "requirements/dev.txt", "a==1\n")]
    texts = spark.createDataFrame([(r, p, len(t), t) for r, p, t in rows], "repository string, path string, length long, text string")
    got = {(r.path, r.kind, r.ecosystem, r.name) for r in inventory.of_texts(texts).collect()}
    assert got == {("org/one/package-lock.json", "component", "npm", "a"), ("org/two/package-lock.json", "component", "npm", "a"), ("org/two/requirements.txt", "component", "pypi", "a"), ("org/two/Pipfile", "warning", None, None)}
