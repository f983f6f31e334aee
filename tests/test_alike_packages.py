"""Packages of one name with the same versions and ranges are judged as one."""

from palisade.operators import vuln


def test_alike_packages_are_judged_once(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept = {}
    real = vuln.materialize
    monkeypatch.setattr(vuln, "materialize", lambda df, name="step": kept.setdefault(name, real(df, name)))
    monkeypatch.setattr(vuln, "PACK", 100)
    ranges = [[{"introduced": "1.0.0", "fixed": None, "last_affected": None}, {"introduced": None, "fixed": "2.0.0", "last_affected": None}]]
    row = lambda i, name, versions, ranges: (f"A{i}", "npm", name, [f"C{i}"], None, "osv", versions, ranges)
    rows = [row(i, "p", ["3.0.0"], ranges) for i in range(1000)] + [row(7, "P", ["3.0.0"], ranges), row("x", "p", None, ranges), row("y", "p", ["9"], None), row("z", "q", ["3.0.0"], ranges)]
    packages = spark.createDataFrame(rows, f"advisory_id string, ecosystem string, name string, aliases array<string>, withdrawn string, source string, versions array<string>, ranges {vuln.EVENTS}")
    components = spark.createDataFrame([("npm", "p", v, None, None) for v in ("1.5.0", "3.0.0", "2.0.0", "9", "x")], "ecosystem string, name string, version string, purl string, manifest_path string")
    got = [(r.version, r.advisory_id, r.method, r.aliases[0], r.fixed_versions) for r in vuln.match(components, packages).collect()]
    assert kept["packages"].count() == 4  # before, a row for each of 1,004 packages
    want = [(v, f"A{i}", m, f"C{i}", ["2.0.0"]) for i in [*range(1000), 7] for v, m in (("1.5.0", "ecosystem-range"), ("3.0.0", "exact-version"))]
    want += [("1.5.0", "Ax", "ecosystem-range", "Cx", ["2.0.0"]), ("9", "Ay", "exact-version", "Cy", [])]
    fixed = lambda rows: sorted((*r[:4], tuple(r[4] or ())) for r in rows)
    assert fixed(got) == fixed(want)
