"""Advisories that speak of the same vulnerability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.tables import materialize

from .components import components


def normal_alias(x: Column) -> Column:
    up = F.upper(F.trim(x))
    return F.when(up.rlike("^[A-Z][A-Z0-9_.:-]{1,127}$"), up)


def alias_index(advisories: DataFrame) -> DataFrame:
    """Distinct (alias, advisory_id, source): ids and aliases in normal form. advisories: id, aliases, source."""
    names = F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
    out = advisories.select(F.explode(F.transform(names, normal_alias)).alias("alias"), F.col("id").alias("advisory_id"), "source")
    return out.where("alias is not null").groupBy("alias", "advisory_id").agg(F.min("source").alias("source"))


def alias_conflicts(index: DataFrame) -> DataFrame:
    """Aliases of more than one advisory, with their advisories in order."""
    return index.groupBy("alias").agg(F.array_sort(F.collect_set("advisory_id")).alias("advisory_ids")).where(F.size("advisory_ids") > 1)


def lookup(identifiers: DataFrame, index: DataFrame) -> DataFrame:
    """(identifier, status, advisory_ids): not-found, exact or ambiguous. identifiers: one column."""
    q = identifiers.toDF("identifier").withColumn("alias", normal_alias(F.col("identifier")))
    hits = q.join(index, "alias", "left").groupBy("identifier").agg(F.array_sort(F.collect_set("advisory_id")).alias("advisory_ids"))
    n = F.size("advisory_ids")
    return hits.select("identifier", F.when(n == 0, "not-found").when(n == 1, "exact").otherwise("ambiguous").alias("status"), "advisory_ids")


def groups(index: DataFrame, advisories: DataFrame) -> DataFrame:
    """(root, advisory_id) of every advisory: the least id that shared aliases lead to.

    Each alias links its advisories to the least of them, so an alias of many gives a star.
    """
    least = index.groupBy("alias").agg(F.min("advisory_id").alias("b"))
    found = components(index.join(least, "alias").select(F.col("advisory_id").alias("a"), "b"))
    return advisories.select(F.col("id").alias("node")).join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), F.col("node").alias("advisory_id"))


def reconciliation(index: DataFrame, advisories: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Groups with members, evidence (aliases that two members share), sources, scope and, of a ledger
    (source_id, advisory_id), how many records each has."""
    g = materialize(groups(index, advisories), "groups")
    members = g.join(advisories.select(F.col("id").alias("advisory_id"), "source"), "advisory_id")
    by = members.groupBy("root").agg(F.array_sort(F.collect_set("advisory_id")).alias("advisory_ids"), F.array_sort(F.collect_set("source")).alias("sources"))
    shared = index.groupBy("alias").agg(F.countDistinct("advisory_id").alias("n"), F.min("advisory_id").alias("advisory_id")).where("n > 1")
    evidence = shared.join(g, "advisory_id").groupBy("root").agg(F.array_sort(F.collect_set("alias")).alias("evidence_aliases"))
    out = by.join(evidence, "root", "left").withColumn("evidence_aliases", F.coalesce("evidence_aliases", F.array().cast("array<string>")))
    body = F.to_json(F.struct("advisory_ids", "evidence_aliases"))
    out = out.select(
        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("group_id"), "root", "advisory_ids", "evidence_aliases", "sources",
        F.when(F.size("sources") > 1, "cross-source").otherwise("single-source").alias("source_scope"), (F.size("advisory_ids") > 1).alias("ambiguous"),
    )
    if records is not None:
        n = records.join(g, "advisory_id").groupBy("root").agg(F.count("*").alias("records"))
        out = out.join(n, "root", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return out


def field_conflicts(grouped: DataFrame, values: DataFrame) -> DataFrame:
    """(root, field, digests, advisory_ids) of fields that a group's members state differently.

    grouped: root, advisory_id; values: advisory_id and string columns, one a field.
    """
    fields = [c for c in values.columns if c != "advisory_id"]
    each = values.select("advisory_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}), 256)).alias("digest")) for f in fields])).alias("x"))
    out = each.join(grouped, "advisory_id").groupBy("root", "x.field").agg(F.array_sort(F.collect_set("x.digest")).alias("digests"), F.array_sort(F.collect_set("advisory_id")).alias("advisory_ids"))
    return out.where(F.size("digests") > 1)


def decide(kind: str, members: DataFrame, index: DataFrame) -> DataFrame:
    """A merge or split decision, one row: id by content, members and the aliases that all of them have."""
    names = index.join(members.toDF("advisory_id"), "advisory_id")
    n = members.count()
    common = names.groupBy("alias").agg(F.countDistinct("advisory_id").alias("n")).where(F.col("n") == n).agg(F.array_sort(F.collect_set("alias")).alias("evidence"))
    who = members.toDF("m").agg(F.array_sort(F.collect_set("m")).alias("advisory_ids"))
    out = who.crossJoin(common).withColumn("decision_type", F.lit(kind))  # one row each
    return out.withColumn("decision_id", F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct("advisory_ids", "decision_type", "evidence")), 256)))


def decision_status(decisions: DataFrame, index: DataFrame) -> DataFrame:
    """(decision_id, status): valid if the members still share the evidence, stale if not, invalid
    for a merge without evidence or a decision of fewer than two members."""
    each = decisions.select("decision_id", F.explode("advisory_ids").alias("advisory_id")).join(index, "advisory_id", "left")
    now = each.groupBy("decision_id", "alias").agg(F.countDistinct("advisory_id").alias("n"))
    now = now.join(decisions.select("decision_id", F.size("advisory_ids").alias("m")), "decision_id").groupBy("decision_id").agg(F.array_sort(F.collect_set(F.when((F.col("n") == F.col("m")) & F.col("alias").isNotNull(), F.col("alias")))).alias("now"))
    out = decisions.join(now, "decision_id", "left")
    bad = (F.size("advisory_ids") < 2) | ((F.col("decision_type") == "merge") & (F.size("evidence") == 0))
    return out.select("decision_id", F.when(bad, "invalid").when(F.col("now") == F.col("evidence"), "valid").otherwise("stale").alias("status"))
