"""Software bills of materials and other scanners' evidence, from JSON texts (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Package URL types, Syft types, and the ecosystems they stand for (fixed values).
PURL_TYPES = {"pypi": "PyPI", "npm": "npm", "golang": "Go", "cargo": "crates.io", "maven": "Maven", "nuget": "NuGet", "gem": "RubyGems", "composer": "Packagist", "deb": "Debian", "rpm": "RPM", "apk": "Alpine"}
SYFT_TYPES = {"python": "PyPI", "npm": "npm", "go-module": "Go", "rust-crate": "crates.io", "java-archive": "Maven", "dotnet": "NuGet", "gem": "RubyGems", "php-composer": "Packagist", "deb": "Debian", "rpm": "RPM", "apk": "Alpine"}
CYCLONEDX, SPDX = ("1.4", "1.5", "1.6", "1.7"), ("SPDX-2.2", "SPDX-2.3")


def _map(value: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in table.items()], other)


def _checked(rows: DataFrame) -> DataFrame:
    """Rows (path, name, version, purl, ecosystem) with a reject_reason: a missing name or version, an odd
    purl, or an identity that its file states twice."""
    ident = F.coalesce("purl", F.concat("name", F.lit("@"), "version"))
    n = rows.withColumn("__i", ident).groupBy("path", "__i").agg(F.count("*").alias("__n"))
    out = rows.withColumn("__i", ident).join(n, ["path", "__i"], "left")
    missing = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("version", F.lit("")).isin("", "NOASSERTION"))
    odd = F.col("purl").isNotNull() & ~F.col("purl").rlike(r"^pkg:[A-Za-z][A-Za-z0-9.+-]*/[^\s]+$")
    reason = F.when(missing, "missing name or version").when(odd, "malformed purl").when(F.col("__n") > 1, "repeated component")
    return out.select("path", "ecosystem", "name", "version", "purl", reason.alias("reject_reason"))


def _purl_ecosystem(purl: Column) -> Column:
    kind = F.regexp_extract(purl, "^pkg:([^/]+)/", 1)
    return _map(kind, PURL_TYPES, F.when(kind != "", kind))


def cyclonedx(files: DataFrame) -> DataFrame:
    d = F.from_json("text", "struct<bomFormat:string,specVersion:string,components:array<struct<name:string,version:string,purl:string>>>")
    rows = files.select("path", d.alias("d")).where(F.col("d.specVersion").isin(*CYCLONEDX)).select("path", F.explode("d.components").alias("c"))
    return _checked(rows.select("path", "c.name", "c.version", "c.purl", _purl_ecosystem(F.col("c.purl")).alias("ecosystem")))


def spdx(files: DataFrame) -> DataFrame:
    d = F.from_json("text", "struct<spdxVersion:string,packages:array<struct<name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>>")
    rows = files.select("path", d.alias("d")).where(F.col("d.spdxVersion").isin(*SPDX)).select("path", F.explode("d.packages").alias("p"))
    purl = F.get(F.filter("p.externalRefs", lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"]
    return _checked(rows.select("path", "p.name", F.col("p.versionInfo").alias("version"), purl.alias("purl"), _purl_ecosystem(purl).alias("ecosystem")))


def syft(files: DataFrame) -> DataFrame:
    d = F.from_json("text", "struct<artifacts:array<struct<name:string,version:string,type:string,purl:string>>>")
    rows = files.select("path", F.explode(d["artifacts"]).alias("a"))
    return _checked(rows.select("path", "a.name", "a.version", "a.purl", _map(F.col("a.type"), SYFT_TYPES, F.col("a.type")).alias("ecosystem")))


def osv_scanner(files: DataFrame) -> DataFrame:
    """(path, target, ecosystem, package, version, vulnerability, aliases)."""
    d = F.from_json("text", "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<struct<id:string,aliases:array<string>>>>>>>>")
    r = files.select("path", F.explode(d["results"]).alias("r")).select("path", F.col("r.source.path").alias("target"), F.explode("r.packages").alias("p"))
    return r.select("path", "target", "p.package.ecosystem", F.col("p.package.name").alias("package"), "p.package.version", F.explode("p.vulnerabilities").alias("v")).select(
        "path", "target", "ecosystem", "package", "version", F.col("v.id").alias("vulnerability"), _sorted("v.aliases").alias("aliases")
    )


def _sorted(x: str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))))


def trivy(files: DataFrame) -> DataFrame:
    d = F.from_json("text", "struct<SchemaVersion:int,Results:array<struct<Target:string,Type:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string>>>>>")
    r = files.select("path", d.alias("d")).where("d.SchemaVersion in (1, 2)").select("path", F.explode("d.Results").alias("r")).select("path", "r.Target", "r.Type", F.explode("r.Vulnerabilities").alias("v"))
    out = r.select("path", F.col("Target").alias("target"), F.col("Type").alias("ecosystem"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("version"), F.col("v.VulnerabilityID").alias("vulnerability"), F.lower("v.Severity").alias("severity"))
    n = out.groupBy("path", "target", "package", "version", "vulnerability").agg(F.count("*").alias("times"), F.min("ecosystem").alias("ecosystem"), F.min("severity").alias("severity"))
    return n.withColumn("reject_reason", F.when(F.col("times") > 1, "repeated finding")).drop("times")


def grype(files: DataFrame) -> DataFrame:
    d = F.from_json("text", "struct<matches:array<struct<vulnerability:struct<id:string,severity:string>,relatedVulnerabilities:array<struct<id:string>>,artifact:struct<name:string,version:string,type:string,locations:array<struct<path:string>>>>>>")
    m = files.select("path", F.explode(d["matches"]).alias("m"))
    return m.select(
        "path", F.get("m.artifact.locations", F.lit(0))["path"].alias("target"), F.col("m.artifact.type").alias("ecosystem"), F.col("m.artifact.name").alias("package"), "m.artifact.version",
        F.col("m.vulnerability.id").alias("vulnerability"), F.array_sort(F.array_distinct(F.transform(F.coalesce("m.relatedVulnerabilities", F.array().cast("array<struct<id:string>>")), lambda r: r["id"]))).alias("aliases"),
    )


def evidence_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, findings) of scanners' evidence: of each report (path) its findings and distinct vulnerabilities, and the findings
    by target, ecosystem, package, version and vulnerability, in ranges of that order; missing parts stand first."""
    counts = rows.groupBy("path").agg(F.count("*").alias("finding_count"), F.countDistinct("vulnerability").alias("vulnerability_count"))
    order = [F.coalesce(F.col(c), F.lit("")) for c in ("target", "ecosystem", "package", "version", "vulnerability")]
    return counts, rows.orderBy(*order, "path")


def gitleaks(files: DataFrame) -> DataFrame:
    """Findings of a redacted report, a JSON array; rows whose evidence is not redacted are rejected."""
    d = F.from_json("text", "array<struct<RuleID:string,File:string,StartLine:int,Fingerprint:string,Secret:string,Match:string>>")
    r = files.select(F.explode(d).alias("r")).select("r.*")
    clean = lambda c: F.coalesce(F.upper(F.col(c)), F.lit("")).isin("", "REDACTED", "[REDACTED]", "***")
    evidence = F.sha2(F.coalesce("Fingerprint", F.concat_ws(":", "File", "RuleID", F.col("StartLine").cast("string"))), 256)
    out = r.select(F.col("RuleID").alias("pattern_name"), F.col("File").alias("file"), F.coalesce("StartLine", F.lit(0)).alias("line"), F.lit("high").alias("severity"), F.lit("CRT-GL-001").alias("rule_id"), F.concat(F.lit("sha256:"), evidence).alias("fingerprint"), F.when(~(clean("Secret") & clean("Match")), "evidence is not redacted").alias("reject_reason"))
    return out.dropDuplicates(["fingerprint"])


def verified(reports: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Reports (path, content) whose SHA-256 is the one that a sidecar (path, source_sha256, collected_at,
    tool_version) states, with a time that names its zone."""
    have = reports.withColumn("source_sha256", F.sha2("content", 256))
    out = have.join(sidecars, ["path", "source_sha256"])
    return out.where(F.col("collected_at").rlike(r"(Z|[+-]\d\d:\d\d)$") & F.expr("try_to_timestamp(collected_at)").isNotNull())
