"""Findings over time: deltas, VEX statements, suppressions, and the chain from finding to incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.registry import SEVERITIES
from palisade.functions.tables import maybe_broadcast
from palisade.operators import incidents, vuln

CONFIDENCE = ("low", "medium", "high")
NOT_AFFECTED = "not_affected"


def delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fingerprint, state): new, existing or resolved, by a full outer join of distinct fingerprints."""
    c = current.select("fingerprint").distinct().withColumn("c", F.lit(True))
    b = baseline.toDF("fingerprint").distinct().withColumn("b", F.lit(True))
    j = c.join(b, "fingerprint", "full_outer")
    return j.select("fingerprint", F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("existing").alias("state"))


def annotate(found: DataFrame | vuln.Findings, vex: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings with vex_status, vex_justification, suppressed and suppression_reason.

    vex: vulnerability, products array, status, justification; a statement applies if it names the
    advisory or an alias, and the component's purl. found: fingerprint, advisory_id, aliases,
    component_purl. Where several apply, ``vex_ambiguous`` is true and the least is shown. Statements are gathered for
    each purl, and each finding looks through those of its own. Of ``vuln.Findings`` the components get their statements, so that
    findings, which may be far more, do not travel for them; nor do they for suppressions that are few or none.
    Expired suppressions still suppress; ``suppression_lifecycle`` reports them.
    """
    said = vex.select("vulnerability", F.explode("products").alias("component_purl"), "status", "justification")
    of_purl = said.groupBy("component_purl").agg(F.collect_set(F.struct("vulnerability", "status", "justification")).alias("__said"))
    told = lambda df: df.join(of_purl.hint("merge"), "component_purl", "left")
    names = F.array_union(F.array("advisory_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    apply = F.filter("__said", lambda x: F.array_contains("__names", x["vulnerability"]))
    least = F.array_min(F.transform("__hit", lambda x: F.struct(x["status"].alias("status"), x["justification"].alias("justification"))))
    kinds = F.array_distinct(F.transform(F.filter("__hit", lambda x: x["status"].isNotNull()), lambda x: F.struct(x["vulnerability"], x["status"], F.coalesce(x["justification"], F.lit("")))))
    if isinstance(found, vuln.Findings):
        judged = vuln.Findings(told(found.components), found.hits.withColumn("__names", names)).rows()
    else:
        judged = told(found.withColumn("__names", names))
    columns = [c for c in (judged if isinstance(found, vuln.Findings) else found).columns if c not in ("__said", "__names")]
    judged = judged.withColumn("__hit", apply)
    judged = judged.withColumns({"v": least, "vex_ambiguous": F.size(kinds) > 1})
    s = suppressions.groupBy("fingerprint").agg(F.min("reason").alias("suppression_reason"))
    quieted = s.count()
    out = judged.join(maybe_broadcast(s, quieted), "fingerprint", "left") if quieted else judged.withColumn("suppression_reason", F.lit(None).cast(dict(s.dtypes)["suppression_reason"]))
    quiet = F.col("suppression_reason").isNotNull() | (F.col("v.status") == NOT_AFFECTED)
    return out.select(*columns, F.col("v.status").alias("vex_status"), F.col("v.justification").alias("vex_justification"), F.coalesce("vex_ambiguous", F.lit(False)).alias("vex_ambiguous"), F.coalesce(quiet, F.lit(False)).alias("suppressed"), "suppression_reason")


def suppression_lifecycle(suppressions: DataFrame, observed: DataFrame, as_of: str) -> DataFrame:
    """(fingerprint, expired, used): expired from its expires_at date on; used if observed."""
    seen = observed.select("fingerprint").distinct().withColumn("__u", F.lit(True))
    out = suppressions.join(seen, "fingerprint", "left")
    return out.select("fingerprint", F.coalesce(F.lit(as_of).cast("date") >= F.col("expires_at").cast("date"), F.lit(False)).alias("expired"), F.coalesce("__u", F.lit(False)).alias("used"))


def facts(observations: DataFrame, family: list[str]) -> DataFrame:
    """A fact for each family: greatest severity, least confidence, distinct observations in order."""
    s = sum((F.when(F.col("severity") == x, i).otherwise(0) for i, x in enumerate(SEVERITIES)), F.lit(0))
    c = sum((F.when(F.col("confidence") == x, i).otherwise(0) for i, x in enumerate(CONFIDENCE)), F.lit(0))
    out = observations.groupBy(*family).agg(F.max(s).alias("s"), F.min(c).alias("c"), F.array_sort(F.collect_set("observation_id")).alias("observation_ids"))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), F.col(i))
    return out.select(*family, pick(SEVERITIES, "s").alias("severity"), pick(CONFIDENCE, "c").alias("confidence"), "observation_ids")


def _id(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}-sha256:"), F.sha2(F.concat_ws("\u0000", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256))


def graph(found: DataFrame, scope: str, changes: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """Observation, fact, delta and incident ids of every finding, configuration change and good observation of another
    tool (see ``incidents``); an id never holds the evidence's text. A change's id comes from what changed and the file."""
    kind = F.when(F.col("type") == "secret", "native-line-rule").otherwise("native-context-rule")
    o = _id("obs", kind, F.col("rule_id"), F.col("file"), F.col("line").cast("string"), F.col("fingerprint"))
    out = found.select("rule_id", "file", "line", "severity", "confidence", "category", kind.alias("source_kind"), o.alias("observation_id"))
    if changes is not None or external is not None:
        more = incidents.observations(None, changes, external)
        out = out.unionByName(more.select(F.col("source_id").alias("rule_id"), F.col("path").alias("file"), "line", "severity", "confidence", "category", "source_kind", "observation_id"))
    out = out.withColumn("fact_id", _id("fact", F.col("rule_id"), F.col("category"), scope, F.col("observation_id")))
    out = out.withColumn("delta_id", _id("delta", "added", F.col("fact_id"), scope)).withColumn("delta", F.lit("added"))
    return out.withColumn("incident_id", _id("incident", "open", scope, F.col("fact_id"), F.col("delta_id"))).withColumn("status", F.lit("open"))
