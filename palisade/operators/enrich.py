"""Exploitation data of vulnerabilities: latest revisions, preferred scores, policies, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: CVSS versions from the most to the least preferred (fixed values).
CVSS = {"4.0": 4, "40": 4, "3.1": 3, "31": 3, "3.0": 2, "30": 2, "2.0": 1, "20": 1}
RANSOMWARE = {"known": ("known", "yes", "true"), "unknown": ("unknown", "no", "false")}


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is greatest by the order's columns; nulls are least. An aggregate, so no
    key's rows meet in one task unreduced."""
    rest = [c for c in df.columns if c not in key and c not in order]
    top = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return top.select(*key, *[F.col(f"x.{c}").alias(c) for c in (*order, *rest)])


def preferred_cvss(metrics: DataFrame) -> DataFrame:
    """Of each cve_id the metric to show: by version, Primary type, score, then its JSON text."""
    rank = F.coalesce(*[F.when(F.col("version") == v, F.lit(r)) for v, r in CVSS.items()], F.lit(0))
    text = F.to_json(F.struct("score", "type", "version"), {"ignoreNullFields": "false"})
    key = F.struct((-rank).alias("a"), F.when(F.col("type") == "Primary", -1).otherwise(0).alias("b"), (-F.coalesce("score", F.lit(-1.0))).alias("c"), text.alias("d"), "version", "type", "score")
    return metrics.groupBy("cve_id").agg(F.min(key).alias("x")).select("cve_id", "x.version", "x.type", "x.score")


def ransomware(value: Column) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin(*RANSOMWARE["known"]), "known").when(low.isin(*RANSOMWARE["unknown"]), "unknown").otherwise("not_evaluable")


def resolved(enrichment: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose cve_id names exactly one advisory, and the rest with a reason: advisory-not-found or advisory-ambiguous."""
    n = index.groupBy("alias").agg(F.countDistinct("advisory_id").alias("n"), F.min("advisory_id").alias("advisory_id"))
    j = enrichment.join(n, F.upper("cve_id") == F.col("alias"), "left").drop("alias")
    rest = j.where("n is null or n > 1").withColumn("reason", F.when(F.col("n").isNull(), "advisory-not-found").otherwise("advisory-ambiguous"))
    return j.where("n = 1").drop("n"), rest.drop("n", "advisory_id")


def intelligence(cves: DataFrame, epss: DataFrame, kev: DataFrame, ssvc: DataFrame) -> DataFrame:
    """(cve_id, epss, percentile, in_kev, ransomware, exploitation) by three left joins to latest revisions."""
    e = latest(epss, ["cve_id"], ["score_date", "digest"]).select("cve_id", "epss", "percentile")
    k = latest(kev, ["cve_id"], ["digest"]).select("cve_id", F.lit(True).alias("in_kev"), ransomware(F.col("ransomware_use")).alias("ransomware"))
    s = latest(ssvc, ["cve_id"], ["digest"]).select("cve_id", "exploitation")
    out = cves.join(e, "cve_id", "left").join(k, "cve_id", "left").join(s, "cve_id", "left")
    return out.withColumn("in_kev", F.coalesce("in_kev", F.lit(False))).withColumn("ransomware", F.coalesce("ransomware", F.lit("not_evaluable")))


def exploitation_policy(report: DataFrame, epss_fail: float = 0.10, fail_on_ransomware: bool = True) -> DataFrame:
    """(cve_id, ransomware_check, epss_check, ssvc_check, status): failed outweighs not_evaluable, that passed.

    A known ransomware campaign fails; so does a score at the threshold or above, and one that is
    missing cannot be evaluated. SSVC records (column ssvc_complete, if there is one) state no
    decision of their own, so the check passes only where all are marked complete.
    """
    r = F.when((F.col("ransomware") == "known") & F.lit(fail_on_ransomware), "failed").otherwise("passed")
    e = F.when(F.col("epss").isNull(), "not_evaluable").when(F.col("epss") >= epss_fail, "failed").otherwise("passed")
    s = F.when(F.coalesce(F.col("ssvc_complete") if "ssvc_complete" in report.columns else F.lit(False), F.lit(False)), "passed").otherwise("not_evaluable")
    out = report.select("cve_id", r.alias("ransomware_check"), e.alias("epss_check"), s.alias("ssvc_check"))
    each = F.array("ransomware_check", "epss_check", "ssvc_check")
    return out.withColumn("status", F.when(F.array_contains(each, "failed"), "failed").when(F.array_contains(each, "not_evaluable"), "not_evaluable").otherwise("passed"))


def coverage(cves: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(cve_id, source, status) for each requested source: available or missing."""
    out = None
    for name, df in sources.items():
        have = df.select("cve_id").distinct().withColumn("__h", F.lit(True))
        one = cves.join(have, "cve_id", "left").select("cve_id", F.lit(name).alias("source"), F.when(F.col("__h"), "available").otherwise("missing").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out
