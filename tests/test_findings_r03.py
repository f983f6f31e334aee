"""Faults that the third review found: cuts, and urls that the rules of the filter must judge as their contract says."""

import random
import re

from palisade.llm import urlfilter
from palisade.plans import catalog_sources


def test_import_ghsa_reads_every_supplier(spark, tmp_path):
    spark.range(9990, 10020).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(r.alias for r in catalog_sources.import_ghsa(spark, str(tmp_path)).collect()) == sorted(f"CVE-2020-{1000 + k}" for k in range(9990, 10020))


def _judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(at + starts), at + starts, verdict) for verdict, at, starts in urlfilter.RULES if (host == at or host.endswith(f".{at}")) and path.startswith(starts)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_by_a_plain_version(spark):
    r = random.Random(1)
    parts = ["http", "://", "com", ".", "example", "net", "org", "/en/", "/de/", "/es/", "7", "8", "?", "#", ":80", "..", "\n", "A", "\r", "/", "%", "\u0130", "\U0001f600"]
    urls = [None, "", "x", "://", "HTTP://Example.COM/en/7", "a://b://com/en/", "http://a\nb.com/en/\n", "http://.com/en/", "http://com/en/\x00", " http://x.org/es/ "]
    urls += [("http://" if r.random() < 0.7 else "") + "".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(1000)]
    rows = [(i, u, None if i % 3 else '<link rel="canonical" href="http://example.net/de/8">') for i, u in enumerate(urls)]
    got = {x.page_id: x for x in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, u, _ in rows:
        host, path, rule, verdict = _judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert verdict is None or got[i].verdict == verdict, u


def test_findings_are_dealt_and_no_side_is_broadcast(spark):
    from palisade.operators import vuln

    none = "cast(null as string)"
    c = spark.range(40).selectExpr("'npm' as ecosystem", "concat('m', id % 4) as name", "concat('1.', id % 5, '.0') as version", f"{none} as purl", "'lock' as manifest_path")
    event = f"array(array(named_struct('introduced', '1.1.0', 'fixed', {none}, 'last_affected', {none}), named_struct('introduced', {none}, 'fixed', '1.3.0', 'last_affected', {none})))"
    p = spark.range(12).selectExpr("concat('A', id) as advisory_id", "'npm' as ecosystem", "concat('m', id % 4) as name", "array('C-1') as aliases", f"{none} as withdrawn", "'osv' as source", "array('1.4.0') as versions", f"{event} as ranges")
    m = vuln.match(c, p)
    assert m.count() == 40 * 3 * 3 // 5
    plan = m._jdf.queryExecution().executedPlan().toString()
    # a range's start is a row a partition
    assert all("BroadcastHashJoin [__p" in x for x in plan.splitlines() if "BroadcastHashJoin" in x) and "REPARTITION_BY_NUM" in plan


def test_checked_report_refuses_as_it_reads(spark):
    import pytest

    from palisade.plans import vulnreports

    kinds = "type string, advisory_id string, aliases array<string>, component_purl string, manifest_path string, status string, method string, confidence string, fixed_versions array<string>, explanation string, fingerprint string, snapshot_id string, source string, severity string"
    row = ("vulnerability", "A", ["C"], "pkg:npm/a@1", "a/lock", "affected", "m", "high", ["2"], "x", "sha256:1", "s1", "osv", "high")
    two = (*row[:2], ["D"], *row[3:10], "sha256:2", *row[11:])
    good = vulnreports.checked(spark.createDataFrame([row, two], kinds), "s1")
    assert good.count() == 2
    assert [r[0] for r in vulnreports.sarif_rules(good).collect()] == ['{"id":"A","shortDescription":{"text":"A"},"properties":{"aliases":["D"]}}']
    bad = spark.createDataFrame([(*row[:4], "../x", *row[5:])], kinds)
    with pytest.raises(Exception, match="finding is refused: unsafe path"):
        vulnreports.severity_summary(vulnreports.checked(bad, "s1")).collect()
