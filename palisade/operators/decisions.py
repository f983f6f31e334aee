"""Decisions to merge or split advisories: a ledger of content-addressed rows, what they rest on, and
the relations that applying them makes. Every state is a new table; nothing is changed in place."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.control import canonical

from .correlate import alias_index

RULES = "exact-ledger-1"
LEDGER = "decision_id string, decision_type string, advisory_ids array<string>, reason string, provenance array<string>, rules_version string"
RELATIONS = "relation_id string, decision_id string, relation_type string, advisory_ids array<string>, evidence_aliases array<string>, active boolean"
CORRECTIONS = "palisade.correlation-corrections"


def _digest(kind: str, value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"palisade-{kind}-v1\0"), value), 256))


def record(proposals: DataFrame, advisories: DataFrame) -> DataFrame:
    """Ledger rows of proposals (decision_type, advisory_ids, reason, provenance), with a reject_reason
    for those that are refused: fewer than two sorted different ids, an unknown kind or advisory, no
    reason or provenance. Equal decisions have equal ids, so a union of ledgers is made distinct by id."""
    p = proposals.withColumn("reason", F.trim("reason")).withColumn("provenance", F.array_sort("provenance")).withColumn("rules_version", F.lit(RULES))
    body = F.to_json(F.struct("advisory_ids", "decision_type", "provenance", "reason", "rules_version"))
    p = p.withColumn("decision_id", _digest("merge-decision", body))
    known = advisories.select(F.col("id").alias("m")).distinct().withColumn("known", F.lit(True))
    lacks = p.select("decision_id", F.explode("advisory_ids").alias("m")).distinct().join(known, "m", "left").groupBy("decision_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"))
    out = p.join(lacks, "decision_id", "left")
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(F.col("decision_type").isin("merge", "split"), F.lit(False)), "unknown decision type")
        .when((F.size("advisory_ids") < 2) | (F.array_sort(F.array_distinct("advisory_ids")) != F.col("advisory_ids")), "advisory ids are not sorted and different")
        .when(blank(F.col("reason")), "missing reason")
        .when((F.size("provenance") < 1) | F.exists("provenance", lambda x: blank(F.trim(x))), "missing provenance")
        .when(F.col("unknown") > 0, "unknown advisory")
    )
    return out.select(*[c.split(" ")[0] for c in LEDGER.split(", ")], reason.alias("reject_reason")).dropDuplicates(["decision_id"])


def validate(ledger: DataFrame, advisories: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(decision_id, status, evidence_aliases, missing_advisory_ids, conflict_types) of each decision: stale if
    an advisory is gone, invalid if its advisories share no alias, else valid. conflicts: advisory_ids, conflict_type."""
    index = alias_index(advisories)
    each = ledger.select("decision_id", F.size("advisory_ids").alias("m"), F.explode("advisory_ids").alias("advisory_id"))
    shared = each.join(index, "advisory_id").groupBy("decision_id", "m", "alias").agg(F.countDistinct("advisory_id").alias("n")).where("n = m")
    evidence = shared.groupBy("decision_id").agg(F.array_sort(F.collect_set("alias")).alias("evidence_aliases"))
    gone = each.join(advisories.select(F.col("id").alias("advisory_id")), "advisory_id", "left_anti").groupBy("decision_id").agg(F.array_sort(F.collect_set("advisory_id")).alias("missing_advisory_ids"))
    none = F.array().cast("array<string>")
    out = ledger.select("decision_id", "decision_type", "advisory_ids").join(evidence, "decision_id", "left").join(gone, "decision_id", "left")
    out = out.withColumn("missing_advisory_ids", F.coalesce("missing_advisory_ids", none))
    stale = F.size("missing_advisory_ids") > 0
    out = out.withColumn("evidence_aliases", F.when(stale, none).otherwise(F.coalesce("evidence_aliases", none)))
    status = F.when(stale, "stale").when(F.size("evidence_aliases") == 0, "invalid").otherwise("valid")
    if conflicts is None:
        out = out.withColumn("conflict_types", none)
    else:
        # a conflict concerns a decision if it holds all its advisories: met by the first, then checked
        c = conflicts.select(F.explode("advisory_ids").alias("first"), F.col("advisory_ids").alias("group"), "conflict_type")
        met = out.select("decision_id", "advisory_ids", F.get("advisory_ids", F.lit(0)).alias("first")).join(c, "first").where(F.size(F.array_except("advisory_ids", "group")) == 0)
        out = out.join(met.groupBy("decision_id").agg(F.array_sort(F.collect_set("conflict_type")).alias("conflict_types")), "decision_id", "left").withColumn("conflict_types", F.coalesce("conflict_types", none))
    return out.withColumn("status", status)


def apply(decisions: DataFrame, relations: DataFrame, ledger: DataFrame, advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations after, outcomes): decisions (decision_id) that are valid become active relations; outcomes are
    applied, already-applied, or rejected with a reason."""
    v = validate(ledger, advisories)
    asked = decisions.select("decision_id").distinct().join(v, "decision_id", "left").join(relations.select("decision_id", F.col("active").alias("was")), "decision_id", "left")
    outcome = F.when(F.coalesce("status", F.lit("not-found")) != "valid", "rejected").when(F.col("was"), "already-applied").otherwise("applied")
    reason = F.when(F.col("status").isNull(), "not-found").when(F.col("status") == "invalid", "no-exact-alias-evidence").when(F.col("status") != "valid", F.col("status"))
    asked = asked.withColumn("outcome", outcome).withColumn("reason", reason)
    fresh = asked.where("outcome = 'applied'").select(_digest("advisory-relation", F.col("decision_id")).alias("relation_id"), "decision_id", F.col("decision_type").alias("relation_type"), "advisory_ids", "evidence_aliases", F.lit(True).alias("active"))
    after = relations.join(fresh.select("decision_id"), "decision_id", "left_anti").select(*relations.columns).unionByName(fresh)
    return after, asked.select("decision_id", "outcome", "reason")


def rollback(decisions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations after, outcomes): rolled-back, already-rolled-back or not-applied."""
    asked = decisions.select("decision_id").distinct()
    outcomes = asked.join(relations.select("decision_id", "active"), "decision_id", "left").select("decision_id", F.when(F.col("active").isNull(), "not-applied").when(F.col("active"), "rolled-back").otherwise("already-rolled-back").alias("outcome"))
    hit = relations.join(asked.withColumn("__hit", F.lit(True)), "decision_id", "left")
    return hit.withColumn("active", F.col("active") & F.col("__hit").isNull()).select(*relations.columns), outcomes


def relation_report(relations: DataFrame, advisories: DataFrame, active_only: bool = True) -> DataFrame:
    """Relations with the sources of their advisories, in order of id."""
    r = relations.where("active") if active_only else relations
    each = r.select("relation_id", F.explode("advisory_ids").alias("id")).join(advisories.select("id", "source"), "id")
    return r.join(each.groupBy("relation_id").agg(F.array_sort(F.collect_set("source")).alias("sources")), "relation_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).orderBy("relation_id")


def export(ledger: DataFrame) -> bytes:
    """All decisions as one document with a digest of itself; decisions are made by hand, so they are few."""
    rows = [r.asDict() for r in ledger.select(*[c.split(" ")[0] for c in LEDGER.split(", ")]).orderBy("decision_id").toLocalIterator()]
    out = {"schema": CORRECTIONS, "version": 1, "corrections": rows}
    return canonical(out | {"content_digest": f"sha256:{hashlib.sha256(canonical(out)).hexdigest()}"})


def load(raw: bytes, advisories: DataFrame) -> DataFrame:
    """The ledger of an exported document; its digest, every id and every advisory are checked, and nothing is applied."""
    d = json.loads(raw)
    if not isinstance(d, dict) or d.get("schema") != CORRECTIONS or d.get("version") != 1 or not isinstance(d.get("corrections"), list):
        raise ValueError("not a document of corrections")
    said = d.pop("content_digest", None)
    if said != f"sha256:{hashlib.sha256(canonical(d)).hexdigest()}":
        raise ValueError("corrections were changed")
    given = advisories.sparkSession.createDataFrame([tuple(x[c.split(" ")[0]] for c in LEDGER.split(", ")) for x in d["corrections"]], LEDGER)
    made = record(given.select("decision_type", "advisory_ids", "reason", "provenance"), advisories)
    if bad := made.where("reject_reason is not null").first():
        raise ValueError(f"correction is refused: {bad['reject_reason']}")
    if not given.select("decision_id").exceptAll(made.select("decision_id")).isEmpty():
        raise ValueError("a correction's id is not that of its content")
    return made.drop("reject_reason")


def index_more(index: DataFrame, advisories: DataFrame) -> DataFrame:
    """An alias index with further advisories' names; those that it has stay."""
    return index.unionByName(alias_index(advisories)).groupBy("alias", "advisory_id").agg(F.min("source").alias("source"))


# CPE names: what a binding says, and package URLs that an operator has approved for one.

CPE_FIELDS = ("part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other")
#: Characters that a backslash may precede (fixed values), as a pattern's class.
_ESCAPED = r"[!\"#$%&'()+,\-./:;<=>@\[\]^_`{|}~*?\\]"
PURL = r"^pkg:[a-z0-9][a-z0-9.+-]*/[^/?#@\s]+(?:@[^?#\s]+)?(?:\?[^#\s]+)?(?:#[^\s]+)?$"


def parse_cpe(names: DataFrame, column: str = "cpe") -> DataFrame:
    """names with the eleven fields of a CPE 2.3 binding, is_wildcard and reject_reason. A colon that a
    backslash precedes is no separator; fields are shown without their backslashes."""
    text = F.substring(F.col(column), 9, 1 << 30)
    parts = F.regexp_extract_all(text, F.lit(r"(?:^|:)((?:\\.|[^\\:])*)"), F.lit(1))
    bare = F.regexp_replace(text, rf"\\{_ESCAPED}", "")
    plain = lambda p: F.regexp_replace(p, r"\\(.)", "$1")
    # escaped marks are cut out, but an escaped wildcard is not allowed inside a longer field, as in the data this follows
    odd = F.exists(parts, lambda p: ~p.isin("*", "-") & F.regexp_replace(p, r"\\(?![*?])", "").rlike(r"[\s*?]"))
    reason = (
        F.when(F.col(column).isNull() | ~F.col(column).startswith("cpe:2.3:"), "not a cpe:2.3 binding").when(bare.contains("\\"), "invalid escape")
        .when(F.size(parts) != 11, "not eleven fields").when(F.exists(parts, lambda p: p == ""), "empty field").when(odd, "wildcard or space inside a field")
        .when(~F.get(parts, F.lit(0)).isin("a", "o", "h", "*", "-"), "unknown part")
    )
    out = names.withColumn("reject_reason", reason)
    fields = [F.when(F.col("reject_reason").isNull(), plain(F.get(parts, F.lit(i)))).alias(f"cpe_{f}") for i, f in enumerate(CPE_FIELDS)]
    wild = F.when(F.col("reject_reason").isNull(), F.exists(parts, lambda p: p.isin("*", "-")))
    return out.select(*names.columns, *fields, wild.alias("is_wildcard"), "reject_reason")


def cpe_mappings(proposals: DataFrame) -> DataFrame:
    """Mappings of proposals (cpe, purl, confidence, operator_approved, rationale), in order of id, with a
    reject_reason where the binding, purl or confidence is malformed or no operator has approved it."""
    p = parse_cpe(proposals).select(*proposals.columns, F.col("reject_reason").alias("__cpe")).withColumn("rationale", F.trim("rationale"))
    body = F.to_json(F.struct("confidence", "cpe", "purl", "rationale"))
    reason = (
        F.when(F.col("__cpe").isNotNull(), F.col("__cpe")).when(F.col("purl").isNull() | ~F.col("purl").rlike(PURL), "malformed purl").when(~F.coalesce(F.col("confidence").isin("low", "medium", "high"), F.lit(False)), "unknown confidence")
        .when(~F.coalesce("operator_approved", F.lit(False)) | (F.coalesce("rationale", F.lit("")) == ""), "not approved with a rationale")
    )
    out = p.select(F.concat(F.lit("cpe-map-"), F.substring(F.sha2(body, 256), 1, 24)).alias("mapping_id"), "cpe", "purl", "confidence", "rationale", F.lit("operator").alias("source"), reason.alias("reject_reason"))
    return out.dropDuplicates(["mapping_id"]).orderBy("mapping_id")


def cpe_mapping_report(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, mappings): the recorded mappings in order of id, and one row of their count and a digest of them, which
    sums of the tasks make."""
    held = cpe_mappings(proposals).where("reject_reason is null").drop("reject_reason")
    row = F.sha2(F.to_json(F.struct(*sorted(held.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", i * 8 + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(8)]
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256))
    return held.select(row.alias("h")).agg(F.count("*").alias("mapping_count"), digest.alias("content_digest")), held.orderBy("mapping_id")
