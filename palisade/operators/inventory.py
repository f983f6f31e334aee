"""Dependencies of a folder or an SBOM against advisories: inventory, findings, baseline and policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.control import strict_json
from palisade.functions.safefile import read_regular
from palisade.functions.tables import materialize
from palisade.sources import files, manifests, sbom

from . import lifecycle, vuln

MANIFEST_BYTES = 5 << 20
#: Root manifests that are read, and those that only warn (fixed values).
ROOT = r"^(?:requirements\.txt|requirements/[^/]+\.txt|package-lock\.json|Cargo\.lock|go\.mod|go\.sum|composer\.lock|poetry\.lock|uv\.lock)$"
UNSUPPORTED = r"^(?:pyproject\.toml|Pipfile|Pipfile\.lock)$"
POLICY_SCHEMA, POLICY_BYTES = "palisade.vulnerability-policy", 64 << 10


def of_texts(texts: DataFrame) -> DataFrame:
    """Rows (path, kind, ecosystem, name, version, requirement, reason, purl) of root manifests among texts
    (path, length, text); manifests that are too long or not supported are warnings. With a column ``repository`` the
    texts are those of many repositories, each an inventory of its own; path is then repository/path."""
    several = "repository" in texts.columns
    key = F.concat_ws("/", F.url_encode("repository"), "path") if several else F.col("path")
    ok = texts.where(F.col("path").rlike(ROOT) & (F.col("length") <= MANIFEST_BYTES))
    found = manifests.inventory(ok.select(key.alias("path"), "text"), repositories=several)
    odd = texts.where(F.col("path").rlike(UNSUPPORTED) | (F.col("path").rlike(ROOT) & (F.col("length") > MANIFEST_BYTES)))
    reason = F.when(F.col("path").rlike(UNSUPPORTED), "unsupported manifest").otherwise("manifest exceeds limit")
    null = F.lit(None).cast("string")
    warnings = odd.select(key.alias("path"), F.lit("warning").alias("kind"), null.alias("ecosystem"), null.alias("name"), null.alias("version"), null.alias("requirement"), reason.alias("reason"), null.alias("purl"))
    out = found.unionByName(warnings)
    parts = F.split("path", "/", 2)
    return out.withColumn("path", F.concat_ws("/", F.url_decode(parts[0]), parts[1])) if several else out


def of_folder(spark: SparkSession, root: str) -> DataFrame:
    here = files.listing(spark, root, recursive=True).where(F.col("path").rlike(ROOT) | F.col("path").rlike(UNSUPPORTED))
    return of_texts(files.contents(here, root))


def of_sbom(texts: DataFrame) -> DataFrame:
    """(path, format, ecosystem, name, version, purl, reject_reason) of SBOMs (path, text), each read as the format that it states."""
    kind = F.when(F.get_json_object("text", "$.bomFormat") == "CycloneDX", "cyclonedx").when(F.get_json_object("text", "$.spdxVersion").isNotNull(), "spdx").when(F.get_json_object("text", "$.descriptor.name") == "syft", "syft")
    told = texts.withColumn("format", kind)
    out = told.where("format is null").select("path", F.lit("unknown").alias("format"), *[F.lit(None).cast("string").alias(c) for c in ("ecosystem", "name", "version", "purl")], F.lit("unsupported SBOM format").alias("reject_reason"))
    for name, read in (("cyclonedx", sbom.cyclonedx), ("spdx", sbom.spdx), ("syft", sbom.syft)):
        out = out.unionByName(read(told.where(F.col("format") == name).select("path", "text")).withColumn("format", F.lit(name)))
    return out


def sbom_report(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, components) of SBOMs (path, text): of each its format, stated version, state and numbers of components
    and of rejected ones, and the components in the order of a report. A document of no known format has state unsupported."""
    rows = of_sbom(texts)
    stated = F.coalesce(*[F.get_json_object("text", f"$.{k}") for k in ("specVersion", "spdxVersion", "descriptor.version")])
    counts = rows.groupBy("path").agg(F.count_if(F.col("reject_reason").isNull()).alias("component_count"), F.count_if(F.col("reject_reason").isNotNull() & (F.col("format") != "unknown")).alias("rejected_count"), F.min("format").alias("format"))
    out = texts.select("path", stated.alias("spec_version")).join(counts, "path", "left")
    state = F.when(F.col("format") == "unknown", "unsupported").when(F.col("rejected_count") > 0, "rejected").otherwise("ok")
    reports = out.select("path", "format", "spec_version", state.alias("state"), F.coalesce("component_count", F.lit(0)).alias("component_count"), F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"))
    order = [F.coalesce(F.col(c), F.lit("")) for c in ("ecosystem", "name", "version", "purl")]
    return reports, rows.where("reject_reason is null").orderBy(*order, "path")


def report(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(counts, components, unresolved, warnings) in the order of a report."""
    by = lambda kind, *order: rows.where(F.col("kind") == kind).orderBy(*[F.coalesce(c, F.lit("")) for c in order])
    counts = rows.agg(*[F.count_if(F.col("kind") == k).alias(f"{n}_count") for k, n in (("component", "component"), ("unresolved", "unresolved"), ("warning", "warning"))])
    return counts, by("component", "ecosystem", "name", "version", "purl", "path"), by("unresolved", "ecosystem", "name", "requirement", "path", "reason"), by("warning", "path", "reason")


def findings(rows: DataFrame, advisories: DataFrame, packages: DataFrame, snapshot_id: str) -> DataFrame:
    """Findings of an inventory's components against a snapshot's advisories and packages, each a row."""
    return affected(rows, advisories, packages, snapshot_id).rows()


def affected(rows: DataFrame, advisories: DataFrame, packages: DataFrame, snapshot_id: str) -> vuln.Findings:
    """The same as ``vuln.Findings``, not written out."""
    if not snapshot_id:
        raise ValueError("no snapshot is active")
    # written, as it is read again and again and reading manifests is the dearest step
    c = materialize(rows.where("kind = 'component'").select("ecosystem", "name", "version", "purl", F.col("path").alias("manifest_path")), "components")
    out = vuln.affected(c, packages, advisories)
    return vuln.Findings(out.components, out.hits.withColumn("type", F.lit("vulnerability")).withColumn("snapshot_id", F.lit(snapshot_id)))


@dataclass
class Scan:
    findings: DataFrame
    counters: DataFrame


def with_baseline(found: DataFrame, baseline: DataFrame) -> Scan:
    """Findings that the baseline (fingerprint) does not hold, and one row of total, matched, suppressed and stale."""
    left = found.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    d = lifecycle.delta(found, baseline.select("fingerprint"))
    counts = d.agg(F.count_if(F.col("state") != "new").alias("total"), F.count_if(F.col("state") == "existing").alias("matched"), F.count_if(F.col("state") == "existing").alias("suppressed"), F.count_if(F.col("state") == "resolved").alias("stale"))
    return Scan(left, counts)


def load_policy(path: str) -> dict[str, str]:
    """The severity that fails, and what an unknown one does, of a policy document."""
    d = strict_json(read_regular(path, POLICY_BYTES, "policy"), POLICY_BYTES)
    if not isinstance(d, dict) or set(d) != {"schema", "version", "fail_on", "unknown"} or d["schema"] != POLICY_SCHEMA or d["version"] != 1:
        raise ValueError("not a vulnerability policy")
    if d["fail_on"] not in vuln.SEVERITIES or d["unknown"] not in ("allow", "fail"):
        raise ValueError("unknown severity or action")
    return {"fail_on": d["fail_on"], "unknown": d["unknown"]}


def failed(found: DataFrame, policy: dict[str, str]) -> int:
    return found.where(vuln.policy_fails(F.col("severity"), policy["fail_on"], policy["unknown"])).count()
