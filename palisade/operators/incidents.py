"""Observations, facts and incidents, and incidents over successive scans.

An observation says what a scan or another tool saw and where; its id never holds the evidence. All
observations of one subject (what was seen in which file, on whatever line) make a fact, and a fact
that is there is an open incident. A later scan leaves an incident open if its fact is the same, resolves
it if its subject is gone, and supersedes it if the fact has changed. Closed incidents stay as they are:
a subject that comes back is a new incident.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.paths import normal
from palisade.functions.registry import SEVERITIES

CONFIDENCE = ("low", "medium", "high")
EXTERNAL = "external-adapter"
#: Words that may not stand in an incident's summary, as they come with evidence (fixed values).
RAW = r"(?i)matched_text|line_content|synthetic|password|api[_ -]?key"
INCIDENTS = (
    "incident_id string, subject string, scope string, status string, severity string, confidence string, summary string, fact_id string, observation_ids array<string>, "
    "occurrence int, opened_run long, seen_run long, closed_run long, next_id string"
)
DELTAS = "run long, delta_id string, kind string, scope string, subject string, before string, after string, reason string"


def digest(kind: str, *parts: Column | str) -> Column:
    """kind-sha256: of the parts, a zero character between them; a null part differs from an empty one."""
    said = [F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("\u0001")) for p in parts]
    return F.concat(F.lit(f"{kind}-sha256:"), F.sha2(F.concat_ws("\u0000", *said), 256))


def observation_id(line: Column, end_line: Column, hunk: Column, stated: Column) -> Column:
    """The id over columns source_kind, source_id, kind, category, severity, confidence and path, a place and
    what else is stated."""
    return digest("obs", *[F.col(c) for c in ("source_kind", "source_id", "kind", "category", "severity", "confidence", "path")], line, end_line, hunk, stated)


def _shaped(rows: DataFrame, stated: Column) -> DataFrame:
    out = rows.withColumn("observation_id", observation_id(F.col("line"), F.col("end_line"), F.col("hunk"), stated))
    return out.select("observation_id", "source_kind", "source_id", "kind", "category", "severity", "confidence", "path", "line", "end_line", "hunk", "evidence_digest", "evidence_length")


def of_findings(found: DataFrame) -> DataFrame:
    """Observations of findings: a line rule's if it is of a secret, else an ordered rule's."""
    text = F.coalesce("matched_text", F.lit(""))
    line = F.greatest(F.col("line").cast("int"), F.lit(0))
    rows = found.select(
        F.when(F.col("type") == "secret", "native-line-rule").otherwise("native-context-rule").alias("source_kind"), F.coalesce("rule_id", "pattern_name").alias("source_id"), F.col("type").alias("kind"), "category", "severity", "confidence",
        normal(F.col("file")).alias("path"), line.alias("line"), line.alias("end_line"), F.lit(None).cast("string").alias("hunk"), F.sha2(text, 256).alias("evidence_digest"), F.char_length(text).alias("evidence_length"), "pattern_name",
    )
    return _shaped(rows, F.col("pattern_name"))


def of_changes(changes: DataFrame) -> DataFrame:
    """Observations of configuration changes (file, severity, change_type): at line 0, named by change and file."""
    said = F.concat_ws(" ", "change_type", "file")
    rows = changes.select(
        F.lit("config-classifier").alias("source_kind"), F.concat_ws(":", F.lit("config"), "change_type", "file").alias("source_id"), F.lit("config-change").alias("kind"), F.lit("config").alias("category"), "severity", F.lit("high").alias("confidence"),
        normal(F.col("file")).alias("path"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), F.lit(None).cast("string").alias("hunk"), F.sha2(said, 256).alias("evidence_digest"), F.char_length(said).alias("evidence_length"), "change_type",
    )
    return _shaped(rows, F.col("change_type"))


def of_external(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejected) of another tool's rows: source_kind, source_id, kind, category, severity, confidence,
    path, line, end_line, hunk, evidence_digest, evidence_length. A row that is not from an adapter or lacks or
    misstates a part is rejected with a reject_reason."""
    path = normal(F.col("path"))
    odd = path.startswith("/") | path.startswith("../") | path.isin("", ".", "..")
    reason = (
        F.when(F.col("source_kind").isNull() | (F.col("source_kind") != EXTERNAL), "not from an adapter")
        .when(F.greatest(*[F.coalesce(F.col(c), F.lit("")) == "" for c in ("source_id", "kind", "category")]), "missing name")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "unknown severity").when(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "unknown confidence")
        .when(F.col("path").isNull() | odd, "path is not relative").when(F.coalesce((F.col("line") < 0) | (F.col("end_line") < F.col("line")), F.lit(True)), "bad lines")
        .when(~F.coalesce(F.col("evidence_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad evidence digest")
    )
    judged = rows.withColumn("reject_reason", reason)
    good = judged.where("reject_reason is null").withColumn("path", path)
    return _shaped(good, F.lit(None).cast("string")), judged.where("reject_reason is not null")


def observations(found: DataFrame | None = None, changes: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """All observations of a run, each id once; external rows must be good (``of_external`` tells them apart)."""
    parts = [f(x) for f, x in ((of_findings, found), (of_changes, changes), (lambda x: of_external(x)[0], external)) if x is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["observation_id", "evidence_digest"])


def _ranked(names: tuple[str, ...], column: str) -> Column:
    return sum((F.when(F.col(column) == x, i).otherwise(0) for i, x in enumerate(names)), F.lit(0))


def facts(seen: DataFrame, scope: str) -> DataFrame:
    """A fact for each subject: source, kind, path and evidence, whatever the lines. It has the greatest severity,
    the least confidence and the distinct observations in order."""
    subject = digest("subject", scope, *[F.col(c) for c in ("source_kind", "source_id", "kind", "category", "path", "evidence_digest")])
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), c)
    # the subject tells source and category; dealt by it alone, facts meet incidents where they are
    by = seen.groupBy(subject.alias("subject")).agg(F.min("source_id").alias("source_id"), F.min("category").alias("category"), F.max(_ranked(SEVERITIES, "severity")).alias("s"), F.min(_ranked(CONFIDENCE, "confidence")).alias("c"), F.array_sort(F.collect_set("observation_id")).alias("observation_ids"))
    out = by.select("subject", F.lit(scope).alias("scope"), "source_id", "category", pick(SEVERITIES, F.col("s")).alias("severity"), pick(CONFIDENCE, F.col("c")).alias("confidence"), "observation_ids")
    return out.withColumn("fact_id", digest("fact", F.col("source_id"), F.col("category"), F.col("severity"), F.col("confidence"), scope, F.array_join("observation_ids", ",")))


def none_yet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INCIDENTS)


def merge(stored: DataFrame, current: DataFrame, run: int, scope: str, summary: str = "[REDACTED]", unread: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(incidents, deltas) after a run: stored incidents (INCIDENTS) merged with the run's facts of a scope.

    Only the scope's open incidents change. unread: (subject) that the run could not look at; their incidents stay open.
    A full outer join on the subject, which one open incident and one fact at most have; all sides are dealt by it once,
    and both rows of an incident that gives way come from one joined row. Applying the same run again changes nothing.
    """
    if not summary or len(summary) > 1024 or re.search(RAW, summary):
        raise ValueError("a summary must be short and hold no evidence")
    own = (F.col("scope") == scope) & (F.col("status") == "open")
    old = stored.where(own).select(*[F.col(c).alias(f"old_{c}") for c in stored.columns])
    # how many incidents a subject has had tells a new one from those
    before = stored.where(F.col("scope") == scope).groupBy(F.col("subject").alias("had")).agg(F.max("occurrence").alias("times"))
    now = current.select("subject", "severity", "confidence", "fact_id", "observation_ids")
    now = now.join(before, F.col("subject") == F.col("had"), "left")
    if unread is not None:
        hidden = unread.select(F.col("subject").alias("hidden")).distinct()
        old = old.join(hidden, F.col("old_subject") == F.col("hidden"), "left")
    else:
        old = old.withColumn("hidden", F.lit(None).cast("string"))
    j = old.join(now, F.col("old_subject") == F.col("subject"), "full_outer")
    is_old, is_now = F.col("old_subject").isNotNull(), F.col("subject").isNotNull()
    same = is_old & is_now & (F.col("old_fact_id") == F.col("fact_id"))
    state = F.when(same, "unchanged").when(is_old & is_now, "changed").when(is_now, "added").when(F.col("hidden").isNotNull(), "unread").otherwise("removed")
    next_ = F.coalesce("times", F.lit(0)) + 1
    delta = lambda kind, a, b: digest("delta", kind, a, b, scope)
    j = j.select("*", state.alias("state"), next_.cast("int").alias("occurrence"))
    j = j.withColumn("delta_id", delta(F.col("state"), F.col("old_fact_id"), F.col("fact_id")))
    new_id = digest("incident", scope, F.col("subject"), F.col("fact_id"), F.col("delta_id"), F.col("occurrence"), summary)
    j = j.withColumn("new_id", F.when(F.col("state").isin("added", "changed"), new_id))
    n = F.lit(run).cast("long")
    closes = F.col("state").isin("changed", "removed")
    # the old incident as it is now, then the new one
    opens = F.col("state").isin("added", "changed")
    each = j.withColumn("fresh", F.explode(F.when(is_old & opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(opens))))
    pick = lambda new, was: F.when(F.col("fresh"), new).otherwise(was)
    status = F.when(F.col("state") == "changed", "superseded").when(F.col("state") == "removed", "resolved").otherwise("open")
    was = lambda c: F.col(f"old_{c}")
    merged = each.select(
        pick(F.col("new_id"), was("incident_id")).alias("incident_id"), pick(F.col("subject"), was("subject")).alias("subject"), pick(F.lit(scope), was("scope")).alias("scope"), pick(F.lit("open"), status).alias("status"),
        *[pick(F.col(c), was(c)).alias(c) for c in ("severity", "confidence")], pick(F.lit(summary), was("summary")).alias("summary"), *[pick(F.col(c), was(c)).alias(c) for c in ("fact_id", "observation_ids", "occurrence")],
        pick(n, was("opened_run")).alias("opened_run"), pick(n, F.when(same, F.greatest(was("seen_run"), n)).otherwise(was("seen_run"))).alias("seen_run"),
        pick(F.lit(None), F.when(closes, n)).cast("long").alias("closed_run"), pick(F.lit(None), F.col("new_id")).cast("string").alias("next_id"),
    )
    names = [c.split(" ")[0] for c in INCIDENTS.split(", ")]
    incidents = stored.where(~own).select(*names).unionByName(merged.select(*names))
    reason = F.when(F.col("state") == "added", "observed").when(F.col("state") == "removed", "no longer observed").otherwise("observed otherwise")
    deltas = j.where(F.col("state").isin("added", "removed", "changed")).select(n.alias("run"), "delta_id", F.col("state").alias("kind"), F.lit(scope).alias("scope"), F.coalesce("subject", "old_subject").alias("subject"), F.col("old_fact_id").alias("before"), F.col("fact_id").alias("after"), reason.alias("reason"))
    return incidents, deltas


def can_transition(current: Column, target: Column) -> Column:
    return (current == "open") & target.isin("resolved", "superseded")
