"""VEX documents, suppressions and baselines as tables, from JSON texts (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What CycloneDX's analysis states stand for (fixed values).
STATES = {"false_positive": "not_affected", "resolved": "fixed", "exploitable": "affected", "in_triage": "under_investigation", "not_affected": "not_affected"}
STATUSES = ("not_affected", "affected", "fixed", "under_investigation")
_DIGEST = "^sha256:[0-9a-f]{64}$"


def vex(files: DataFrame) -> DataFrame:
    """(path, vulnerability, products, status, justification, impact, source_format, reject_reason)."""
    op = F.from_json("text", "struct<statements:array<struct<vulnerability:string,products:array<string>,status:string,justification:string,impact_statement:string>>>")
    s = files.where(F.get_json_object("text", "$.statements").isNotNull()).select("path", F.explode(op["statements"]).alias("s"))
    ident = F.coalesce(F.get_json_object("s.vulnerability", "$['@id']"), F.get_json_object("s.vulnerability", "$.name"), "s.vulnerability")
    product = F.transform("s.products", lambda p: F.coalesce(F.get_json_object(p, "$['@id']"), p))
    rows = s.select("path", ident.alias("vulnerability"), product.alias("products"), "s.status", "s.justification", F.col("s.impact_statement").alias("impact"), F.lit("openvex").alias("source_format"))
    cy = F.from_json("text", "struct<vulnerabilities:array<struct<id:string,analysis:struct<state:string,justification:string,response:string>,affects:array<struct<ref:string>>>>>")
    v = files.where(F.get_json_object("text", "$.bomFormat") == "CycloneDX").select("path", F.explode(cy["vulnerabilities"]).alias("v"))
    status = F.coalesce(*[F.when(F.col("v.analysis.state") == k, F.lit(s)) for k, s in STATES.items()])
    rows = rows.unionByName(v.select("path", F.col("v.id").alias("vulnerability"), F.transform("v.affects", lambda a: a["ref"]).alias("products"), status.alias("status"), F.col("v.analysis.justification").alias("justification"), F.col("v.analysis.response").alias("impact"), F.lit("cyclonedx").alias("source_format")))
    lacks = (F.col("source_format") == "openvex") & (F.col("status") == "not_affected") & (F.coalesce("justification", F.lit("")) == "")
    reason = F.when(F.coalesce("vulnerability", F.lit("")) == "", "missing vulnerability").when(F.size("products") < 1, "no products").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status").when(lacks, "not_affected without a justification")
    return rows.withColumn("reject_reason", reason)


def suppressions(files: DataFrame) -> DataFrame:
    """(path, fingerprint, reason, owner, ticket, scope, expires_at, reject_reason) of versions 1 and 2."""
    d = F.from_json("text", "struct<version:int,entries:array<struct<fingerprint:string,reason:string,owner:string,ticket:string,scope:string,expires_at:string>>>")
    rows = files.select("path", d.alias("d")).select("path", F.col("d.version").alias("version"), F.explode("d.entries").alias("e")).select("path", "version", "e.*")
    n = rows.groupBy("path", "fingerprint").agg(F.count("*").alias("times"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    lifecycle = (F.col("version") == 2) & (blank("owner") | blank("ticket") | blank("scope") | F.expr("try_to_date(expires_at, 'yyyy-MM-dd')").isNull())
    reason = F.when(~F.col("version").isin(1, 2), "unknown version").when(~F.col("fingerprint").rlike(_DIGEST) | F.col("fingerprint").isNull(), "malformed fingerprint").when(blank("reason"), "missing reason").when(lifecycle, "incomplete lifecycle").when(F.col("times") > 1, "repeated entry")
    return rows.join(n, ["path", "fingerprint"], "left").select("path", "fingerprint", "reason", "owner", "ticket", "scope", "expires_at", reason.alias("reject_reason"))


def baseline(files: DataFrame) -> DataFrame:
    """(path, fingerprint, reject_reason) of baseline documents."""
    rows = files.select("path", F.explode(F.from_json("text", "struct<version:int,fingerprints:array<string>>")["fingerprints"]).alias("fingerprint"))
    n = rows.groupBy("path", "fingerprint").agg(F.count("*").alias("times"))
    return n.select("path", "fingerprint", F.when(~F.col("fingerprint").rlike(_DIGEST), "malformed fingerprint").when(F.col("times") > 1, "repeated entry").alias("reject_reason"))
