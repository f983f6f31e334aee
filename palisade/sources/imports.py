"""Feeds into tables: a ledger of every record seen, the advisories that hold, what was refused and why.

An import never stops at a bad record: it is a row of ``errors``. A snapshot is staged from the tables
(``plans/snapshots.py``), so a half-done import is never read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.control import signed, strict_json
from palisade.functions.safefile import read_regular
from palisade.operators import correlate, enrich
from palisade.operators.vuln import SPACES, digest

from . import archives, feeds

#: Bytes of a record and of a document that the driver reads.
RECORD_BYTES, FILE_BYTES = 5 << 20, 256 << 20


@dataclass
class Imported:
    """Tables of an import; all are lazy."""

    ledger: DataFrame
    advisories: DataFrame
    packages: DataFrame
    errors: DataFrame

    def stats(self) -> dict[str, int]:
        return {k: getattr(self, k).count() for k in ("ledger", "advisories", "packages", "errors")}


def ledger(rows: DataFrame, source: str, keep_payload: bool = True) -> DataFrame:
    """(source_id, native_record_id, content_digest, fingerprint, advisory_id, record) of records (id, record),
    one of each content; without keep_payload the record is left out."""
    body = F.col("record") if keep_payload else F.to_json(F.struct(F.lit(True).alias("_payload_omitted"), F.col("id")))
    out = rows.select(
        F.lit(source).alias("source_id"), F.col("id").alias("native_record_id"), F.concat(F.lit("sha256:"), F.sha2("record", 256)).alias("content_digest"),
        source_fingerprint(F.lit(source), F.col("id")).alias("fingerprint"), F.col("id").alias("advisory_id"), body.alias("record"),
    )
    return out.dropDuplicates(["source_id", "native_record_id", "content_digest"])


def source_fingerprint(source_id: Column, native_id: Column) -> Column:
    return digest(SPACES["source-record"], source_id, native_id)


def history(entries: DataFrame, source: str, native_id: str) -> DataFrame:
    """A record's revisions in the ledger, by digest."""
    return entries.where((F.col("source_id") == source) & (F.col("native_record_id") == native_id)).orderBy("content_digest")


def osv(rows: DataFrame, source: str = "osv", keep_payload: bool = True) -> Imported:
    """An import of OSV records (column record, one JSON object a row, as ``feeds.records`` or a JSON Lines file gives them)."""
    size = rows.withColumn("too_long", F.octet_length("record") > RECORD_BYTES)
    adv = feeds.osv(size.where("not too_long").select("record"), source)
    ident = F.get_json_object("record", "$.id")
    seen = size.select("record", "too_long", ident.alias("id"))
    bad = F.when(F.col("too_long"), "record-exceeds-limit").when(F.coalesce("id", F.lit("")) == "", "missing id").when(F.coalesce(F.get_json_object("record", "$.modified"), F.lit("")) == "", "missing modified")
    judged = seen.withColumn("reason", bad)
    errors = judged.where("reason is not null").select(F.lit(source).alias("source_id"), "id", F.concat(F.lit("sha256:"), F.sha2("record", 256)).alias("content_digest"), "reason")
    good = adv.where("reject_reason is null")
    return Imported(ledger(judged.where("reason is null").select("id", "record"), source, keep_payload), good, feeds.packages(good).where("ecosystem <> '' and trim(name) <> ''"), errors)


def from_lines(spark: SparkSession, path: str, source: str = "osv", keep_payload: bool = True) -> Imported:
    """A JSON Lines feed of any size: Spark splits the file, so no task reads it whole."""
    return osv(spark.read.text(path).select(F.col("value").alias("record")).where(F.trim("record") != ""), source, keep_payload)


def from_zip(spark: SparkSession, path: str, bounds: archives.Bounds = archives.Bounds(members=1_000_000, member_bytes=24 << 20, total_bytes=12 << 30), source: str = "osv", most_errors: int = 1000) -> Imported:
    """ZIP files of one advisory a member; the ledger keeps digests only. More refused members than the budget is an error."""
    rows = archives.zip_records(spark.read.format("binaryFile").load(path), bounds)
    out = osv(rows.where("record is not null").select("record"), source, keep_payload=False)
    refused = rows.where("reject_reason is not null").select(F.lit(source).alias("source_id"), F.col("member").alias("id"), F.lit(None).cast("string").alias("content_digest"), F.col("reject_reason").alias("reason"))
    out.errors = out.errors.unionByName(refused)
    if out.errors.count() > most_errors:
        raise ValueError("more refused members than the budget")
    return out


def ghsa(rows: DataFrame) -> Imported:
    """GitHub advisories; one malformed record refuses the batch."""
    return _normal(feeds.ghsa(rows), rows, "github-advisory", F.upper(F.get_json_object("record", "$.ghsa_id")), strict=True)


def cve_v5(rows: DataFrame) -> Imported:
    return _normal(feeds.cve_v5(rows), rows, "cve-v5", F.get_json_object("record", "$.cveMetadata.cveId"), strict=True)


def _normal(adv: DataFrame, rows: DataFrame, source: str, ident: Column, strict: bool) -> Imported:
    bad = adv.where("reject_reason is not null")
    if strict and (first := bad.first()):
        raise ValueError(f"batch is refused: {first['reject_reason']}")
    good = adv.where("reject_reason is null")
    packages = good.select(F.col("id").alias("advisory_id"), "aliases", "withdrawn", "source", F.explode("affected").alias("a")) if "struct" in dict(good.dtypes)["affected"] else None
    if packages is None:
        packages = good.sparkSession.createDataFrame([], "advisory_id string, ecosystem string, name string, events array<struct<introduced:string,fixed:string,last_affected:string>>")
    else:
        packages = packages.select("advisory_id", F.lower("a.ecosystem").alias("ecosystem"), F.lower("a.name").alias("name"), F.col("a.events").alias("events"))
    return Imported(ledger(rows.select("record", ident.alias("id")), source), good, packages, bad.select(F.lit(source).alias("source_id"), "id", F.lit(None).cast("string").alias("content_digest"), F.col("reject_reason").alias("reason")))


def enrichment(rows: DataFrame, index: DataFrame, strict: bool = True, ambiguous_is_error: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, unresolved, errors) of enrichment rows (cve_id, ..., maybe reject_reason) against an alias index.

    A row of a CVE that names exactly one advisory is resolved. Of the rest, strict makes all errors; else
    those not found are unresolved, and ambiguous ones too unless they are errors.
    """
    bad = rows.where("reject_reason is not null").select("cve_id", F.col("reject_reason").alias("reason")) if "reject_reason" in rows.columns else None
    good = rows.where("reject_reason is null").drop("reject_reason") if bad is not None else rows
    hit, rest = enrich.resolved(good, index)
    error = F.lit(True) if strict else (F.col("reason") == "advisory-ambiguous") & F.lit(ambiguous_is_error)
    errors = rest.where(error).select("cve_id", "reason")
    return hit, rest.where(~error), errors if bad is None else errors.unionByName(bad)


def kev(rows: DataFrame, index: DataFrame, allow_unresolved: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return enrichment(feeds.kev(rows), index, strict=not allow_unresolved, ambiguous_is_error=True)


def epss(rows: DataFrame, index: DataFrame, allow_unresolved: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return enrichment(feeds.epss(rows), index, strict=not allow_unresolved, ambiguous_is_error=False)


def vulnrichment(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return enrichment(feeds.vulnrichment(rows), index)


def nvd(rows: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """Revisions and their CVSS metrics, weaknesses and CPE matches, of CVEs that name exactly one advisory; the rest are errors."""
    head = F.from_json("record", "struct<cve:struct<id:string,lastModified:string,published:string,vulnStatus:string>>")
    base = rows.select("record", head.alias("d"), F.concat(F.lit("sha256:"), F.sha2("record", 256)).alias("digest"))
    reason = F.when(~F.col("d.cve.id").rlike(r"^CVE-\d{4}-\d{4,}$") | F.col("d.cve.id").isNull(), "malformed id")
    revisions = base.select("record", "digest", F.upper("d.cve.id").alias("cve_id"), F.col("d.cve.lastModified").alias("modified"), F.col("d.cve.vulnStatus").alias("vuln_status"), reason.alias("reject_reason"))
    hit, _, errors = enrichment(revisions, index)
    own = hit.select("record", "digest", "cve_id", "advisory_id").dropDuplicates(["cve_id", "digest"])
    metrics = feeds.nvd_metrics(own.select("record")).where("version is not null").drop("modified").withColumn("digest", F.concat(F.lit("sha256:"), F.col("digest")))
    return {"revisions": hit.dropDuplicates(["cve_id", "digest"]).drop("record"), "cvss": metrics, "weaknesses": feeds.nvd_weaknesses(own.select("record")), "cpe_matches": nvd_cpe_matches(own.select("record")), "errors": errors}


def nvd_cpe_matches(rows: DataFrame) -> DataFrame:
    """(cve_id, cpe, vulnerable, start_including, start_excluding, end_including, end_excluding) of configurations' nodes."""
    m = "array<struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>"
    d = F.from_json("record", f"struct<cve:struct<id:string,configurations:array<struct<nodes:array<struct<cpeMatch:{m}>>>>>>")
    x = rows.select(d.alias("d")).select(F.upper("d.cve.id").alias("cve_id"), F.explode("d.cve.configurations").alias("c")).select("cve_id", F.explode("c.nodes").alias("n")).select("cve_id", F.explode("n.cpeMatch").alias("m"))
    return x.select("cve_id", F.col("m.criteria").alias("cpe"), "m.vulnerable", F.col("m.versionStartIncluding").alias("start_including"), F.col("m.versionStartExcluding").alias("start_excluding"), F.col("m.versionEndIncluding").alias("end_including"), F.col("m.versionEndExcluding").alias("end_excluding")).distinct()


def nvd_normalized(tables: dict[str, DataFrame]) -> DataFrame:
    """The active revision of each CVE (the last by modified, then digest) with its metrics, the preferred one, weaknesses and CPE names."""
    top = enrich.latest(tables["revisions"].select("cve_id", F.coalesce("modified", F.lit("")).alias("modified"), "digest", "advisory_id", "vuln_status"), ["cve_id"], ["modified", "digest"])
    cvss = tables["cvss"].join(top.select("cve_id", "digest"), ["cve_id", "digest"], "left_semi")
    best = enrich.preferred_cvss(cvss.select("cve_id", "version", "type", "score")).select("cve_id", F.struct("version", "type", "score").alias("preferred_cvss"))
    listed = lambda df, value, name: df.groupBy("cve_id").agg(F.array_sort(F.collect_set(value)).alias(name))
    out = top.join(listed(cvss, F.struct("version", "type", "score"), "cvss"), "cve_id", "left").join(best, "cve_id", "left")
    return out.join(listed(tables["weaknesses"], "cwe", "weaknesses"), "cve_id", "left").join(listed(tables["cpe_matches"], "cpe", "cpes"), "cve_id", "left")


def provenance(entries: DataFrame, sources: tuple[str, ...] = ("nvd", "kev")) -> DataFrame:
    """(native_record_id, source_id, records, digests): the ledger's revisions of each record by source."""
    return entries.where(F.col("source_id").isin(*sources)).groupBy("native_record_id", "source_id").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("content_digest")).alias("digests"))


def acceptance(files: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """(path, source_digest, state, records, reason) of acquired feeds (path, text): accepted if there is a
    list under key that is not too long. Nothing is activated."""
    listed = F.from_json(F.get_json_object("text", f"$.{key}"), "array<string>")
    # what is no JSON has no type
    valid = F.get_json_object("text", "$").isNotNull()
    n = F.size(listed)
    reason = F.when(~valid, "invalid JSON").when(listed.isNull() | ~F.get_json_object("text", f"$.{key}").startswith("["), "missing list").when(n > most, "record limit exceeded")
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("source_digest"), F.when(reason.isNull(), "accepted").otherwise("rejected").alias("state"), F.when(listed.isNotNull(), n).otherwise(0).alias("records"), reason.alias("reason"))


def read_signed(path: str, keys: dict[str, bytes], most: int = FILE_BYTES) -> str:
    """The feed inside a signed envelope, as JSON text."""
    d = strict_json(read_regular(path, most, "feed"), most)
    if not isinstance(d, dict) or not {"key_id", "signature", "payload"} <= set(d) or not signed(d, keys):
        raise ValueError("feed is not signed by a trusted key")
    return json.dumps(d["payload"])


# CSAF providers: what their last tries came to, and whether a document holds together.


def provider_health(providers: DataFrame, tries: DataFrame) -> DataFrame:
    """(provider_id, status, successes, failures, last_success, last_failure) of providers (provider_id, enabled) and
    tries (provider_id, success, at): disabled, healthy if the last success is not before the last failure,
    unhealthy if there was a failure, else unknown."""
    t = tries.groupBy("provider_id").agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.max(F.when(F.col("success"), F.col("at"))).alias("last_success"), F.max(F.when(~F.col("success"), F.col("at"))).alias("last_failure"))
    out = providers.join(t, "provider_id", "left")
    ok = F.col("last_success").isNotNull() & (F.col("last_failure").isNull() | (F.col("last_success") >= F.col("last_failure")))
    status = F.when(~F.col("enabled"), "disabled").when(ok, "healthy").when(F.col("failures") > 0, "unhealthy").otherwise("unknown")
    return out.select("provider_id", status.alias("status"), F.coalesce("successes", F.lit(0)).alias("successes"), F.coalesce("failures", F.lit(0)).alias("failures"), "last_success", "last_failure")


def csaf_quality(rows: DataFrame) -> DataFrame:
    """(doc, problem, detail) of CSAF documents: malformed ids, products that the tree lacks, malformed remediations."""
    products, said = feeds.csaf_products(rows), feeds.csaf_assertions(rows)
    lost = feeds.dangling(said, products).select("doc", F.lit("unknown product").alias("problem"), F.col("product_id").alias("detail"))
    ids = said.where(F.col("cve").isNull() | ~F.col("cve").rlike("^(CVE|GHSA)-[A-Za-z0-9._-]+$")).select("doc", F.lit("malformed id").alias("problem"), F.coalesce("cve", F.lit("")).alias("detail")).distinct()
    d = F.from_json("record", "struct<vulnerabilities:array<struct<remediations:array<struct<category:string,details:string,product_ids:array<string>>>>>>")
    r = rows.select(F.sha2("record", 256).alias("doc"), F.explode(d["vulnerabilities"]).alias("v")).select("doc", F.explode("v.remediations").alias("r"))
    shape = r.where("r.category is null or r.details is null").select("doc", F.lit("malformed remediation").alias("problem"), F.lit("").alias("detail"))
    named = r.select("doc", F.explode("r.product_ids").alias("product_id")).join(products.select("doc", "product_id"), ["doc", "product_id"], "left_anti").select("doc", F.lit("remediation of an unknown product").alias("problem"), F.col("product_id").alias("detail"))
    return lost.unionByName(ids).unionByName(shape).unionByName(named)


def alias_tables(imported: Imported) -> tuple[DataFrame, DataFrame]:
    """(index, conflicts) rebuilt from an import's advisories."""
    index = correlate.alias_index(imported.advisories.select("id", "aliases", "source"))
    return index, correlate.alias_conflicts(index)
