"""Findings as two tables: numbers, deltas and statements worked out on these equal those of the rows."""

from collections import Counter

import pytest
from palisade.operators import lifecycle, vuln
from palisade.plans import vulnreports
from pyspark.sql import functions as F


def _sides(spark, components, hits):
    """components: (name, version, path, purl); hits: (name, version, advisory, severity)."""
    key = F.struct(F.lit("npm").alias("ecosystem"), "name", "version").alias("__key")
    c = spark.createDataFrame(components, "name string, version string, manifest_path string, component_purl string")
    digests = (vuln.digest("c", F.col("component_purl")).alias("__c"), vuln.digest("d", F.col("component_purl"), F.col("manifest_path")).alias("__d"))
    h = spark.createDataFrame(hits, "name string, version string, advisory_id string, severity string")
    said = h.select(key, "advisory_id", F.array(F.concat(F.lit("CVE-"), "advisory_id")).alias("aliases"), F.lit("npm").alias("ecosystem"), "name", "version", F.lit("m").alias("method"), F.array(F.lit("2")).alias("fixed_versions"), F.lit("e").alias("explanation"), F.lit("osv").alias("source"), "severity", vuln.digest("a", F.col("advisory_id")).alias("__a"), F.lit("vulnerability").alias("type"), F.lit("snap").alias("snapshot_id"))
    return vuln.Findings(c.select(key, "manifest_path", "component_purl", *digests), said)


# one place of two versions, a path with two versions of a name, repeated components and hits, an advisory of two names
C = [("p", "1", "a", "x1"), ("p", "2", "a", "x2"), ("p", "1", "b", "x1"), ("p", "1", "b", "x1"), ("q", "1", "b", "y"), ("q", "2", "b", "y"), ("q", "1", "c", "z"), ("r", "1", "c", "w")]
H = [("p", "1", "A", "high"), ("p", "2", "A", "high"), ("p", "1", "B", "odd"), ("q", "1", "B", "odd"), ("q", "2", "B", "odd"), ("q", "1", "D", "low"), ("q", "1", "D", "low"), ("p", "1", "E", "high")]


def test_numbers_by_group(spark):
    found = _sides(spark, C, H)
    rows = [(r.advisory_id, r.manifest_path) for r in found.rows().collect()]
    assert len(rows) == 17
    assert {(r.advisory_id, r.manifest_path): r.n for r in found.counts(["advisory_id"], ["manifest_path"]).collect()} == Counter(rows)
    out = found.counts(["advisory_id"], ["manifest_path"]).collect()
    assert len({r[:2] for r in out}) == len(out)
    assert {r.advisory_id: r.n for r in found.counts(["advisory_id"]).collect()} == Counter(a for a, _ in rows)


def test_delta_against_findings_and_fingerprints(spark):
    found, base = _sides(spark, C, H), _sides(spark, [*C[1:6], ("p", "1", "gone", "x1")], H[1:6])
    own = [r.fingerprint for r in found.rows().collect()]
    for other in (base, vuln.Findings(found.components, found.hits.where("severity = 'high'")), vuln.Findings(found.components, found.hits.limit(0))):
        held = [r.fingerprint for r in other.rows().collect()]
        for more in ([], ["gone", "gone"], [*own[:9], *held[:2], "gone"]):
            all_ = {*held, *more}
            want = (sum(f not in all_ for f in own), sum(f in all_ for f in own), len(all_ & {*own}), len(all_ - {*own}))
            got = found.delta_counts(other, spark.createDataFrame([(f,) for f in more], "fingerprint string")).collect()
            assert [tuple(r) for r in got] == [want], (more, want)


def test_reports_by_side(spark):
    found = _sides(spark, [*C, ("none", "1", "/etc", "u")], H)  # nothing is found in the last, whose path is unsafe
    sides = vulnreports.checked_sides(found, "snap")
    rows = vulnreports.checked(found.rows(), "snap")
    text = Counter((r.advisory_id, r.severity, r.aliases, r.manifest_path) for r in vulnreports.text_rows(rows).collect())
    columns = ["advisory_id", "severity", "aliases", "manifest_path"]
    assert {tuple(r)[:4]: r.n for r in vulnreports.text_counts(sides, columns).collect()} == text
    told = vulnreports.sarif_results(rows).select(F.get_json_object("value", "$.ruleId"), F.get_json_object("value", "$.level")).collect()
    assert {tuple(r)[:2]: r.results for r in vulnreports.sarif_counts(sides).collect()} == Counter(map(tuple, told))
    bad = _sides(spark, [*C, ("p", "2", "x/../y", "u")], H)
    with pytest.raises(Exception, match="unsafe path"):
        vulnreports.sarif_counts(vulnreports.checked_sides(bad, "snap")).collect()
    with pytest.raises(Exception, match="another report"):
        vulnreports.sarif_counts(vulnreports.checked_sides(found, "other")).collect()


def test_statements_come_to_components(spark):
    found = _sides(spark, C, H)
    vex = spark.createDataFrame([("CVE-A", ["x1", "y"], "not_affected", "j"), ("B", ["y"], "fixed", None), ("B", ["y"], "affected", None)], "vulnerability string, products array<string>, status string, justification string")
    one = found.rows().where("advisory_id = 'D'").first().fingerprint
    for quiet in ([], [(one, "why")]):
        s = spark.createDataFrame(quiet, "fingerprint string, reason string")
        got, want = (lifecycle.annotate(x, vex, s) for x in (found, found.rows()))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert sum(r.suppressed for r in got.collect()) == 3 + 2 * bool(quiet)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [fingerprint" not in plan  # before, findings were dealt by fingerprint, and by purl
