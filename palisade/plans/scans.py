"""Scans from end to end: a folder, a diff, a history or another scanner's report to findings and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.control import Config, configured
from palisade.functions.registry import ContextRule, Rule, builtin_context_rules, builtin_rules, numbered
from palisade.operators import classify, context, policy, scan
from palisade.sources import diff, files


@dataclass
class Result:
    findings: DataFrame
    changes: DataFrame
    rejected: DataFrame
    counters: DataFrame | None = None
    fail_on: str = "medium"
    warn_on: str = "low"

    def summary(self) -> DataFrame:
        return policy.summary(self.findings, self.changes, self.fail_on, self.warn_on, self.rejected)


def scanner(config: Config | None = None, packs: list[Rule] = ()) -> tuple[list[Rule], list[ContextRule], str, bool]:
    """(line rules, ordered rules, threshold, whether configuration is classified) of a configuration and rule
    packs; a threshold or check that it states goes before its profile's."""
    config = config or Config()
    threshold, check = policy.PROFILES[config.profile]
    rules = numbered([*configured(builtin_rules(), config), *packs])
    ordered = [] if config.profile == "secrets-only" else builtin_context_rules()
    return rules, ordered, config.threshold or threshold, check if config.config_check is None else config.config_check


def context_findings(lines: DataFrame, rules: list[ContextRule], added: DataFrame | None = None, unit: list[str] = ("path",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Matches of ordered rules as findings; with added only those that touch an added line. keep: columns of the unit that stay."""
    hits = context.context_matches(lines, rules, list(unit))
    if added is not None:
        hits = context.touching(hits, added, list(unit))
    table = lines.sparkSession.createDataFrame([(r.rule_id, r.category, r.confidence, r.remediation) for r in rules], "rule_id string, category string, confidence string, remediation string")
    out = hits.join(F.broadcast(table), "rule_id")  # a row a rule
    return out.select(
        F.lit("policy").alias("type"), "pattern_name", "severity", F.col("path").alias("file"), F.col("line").cast("int").alias("line"), F.lit(0).alias("start"), "matched_text", "line_content", F.lit("context-pattern").alias("rule"),
        "rule_id", "category", "confidence", "remediation", scan.fingerprint(F.col("rule_id"), F.col("path"), F.col("matched_text")).alias("fingerprint"), *keep,
    )


def _result(lines: DataFrame, context_lines: DataFrame, changes: DataFrame, config: Config | None, packs: list[Rule], allow: list[policy.Allow], baseline: DataFrame | None, added: DataFrame | None = None, unit: list[str] = ("path",), keep: tuple[str, ...] = ()) -> Result:
    config = config or Config()
    rules, ordered, threshold, check = scanner(config, packs)
    found = scan.findings(lines, rules, keep)
    if ordered:
        found = found.unionByName(context_findings(context_lines, ordered, added, unit, keep))
    found = policy.apply_policy(found, threshold=threshold, ignore=list(config.ignore), high=list(config.high), medium=list(config.medium), allow=list(allow))
    raised = changes.withColumn("severity", policy.elevated(F.col("file"), F.col("severity"), list(config.high), list(config.medium)))
    out = Result(found, raised if check else raised.where("false"), scan.rejected(lines), None, config.fail_on, config.warn_on)
    if baseline is not None:
        out.counters = policy.baseline_counters(found, baseline)
        out.findings = policy.apply_baseline(found, baseline)
    return out


def texts(rows: DataFrame, config: Config | None = None, packs: list[Rule] = (), allow: list[policy.Allow] = (), baseline: DataFrame | None = None) -> Result:
    """A scan of whole texts (path, length, text): those that ``files.accepted`` takes; too long ones are reported."""
    judged = files.accepted(rows, list((config or Config()).ignore))
    taken = judged.where("skip_reason is null and reject_reason is null")
    lines = scan.file_lines(taken)
    out = _result(lines, lines.select("path", "line", "content"), classify.config_changes(taken.select("path")), config, packs, allow, baseline)
    long_ = judged.where("reject_reason is not null").select("path", F.lit(0).alias("line"), F.col("length").cast("int").alias("n_chars"), F.col("reject_reason").alias("reason"))
    out.rejected = out.rejected.unionByName(long_)
    return out


def folder(spark: SparkSession, root: str, recursive: bool = False, **options: object) -> Result:
    """A scan of a folder's files; contents are read by executors, of files that are not passed over."""
    here = files.accepted(files.listing(spark, root, recursive), list(getattr(options.get("config"), "ignore", ()) or ()))
    read = files.contents(here.where("skip_reason is null and reject_reason is null"), root)
    rest = here.where("reject_reason is not null").select("path", "length", F.lit("").alias("text"))
    return texts(read.unionByName(rest), **options)


def diffs(rows: DataFrame, config: Config | None = None, packs: list[Rule] = (), allow: list[policy.Allow] = (), baseline: DataFrame | None = None, keep: tuple[str, ...] = ()) -> Result:
    """A scan of the added lines of diffs (diff_id, text); ordered rules see a hunk's new side. A diff that is
    malformed is reported as rejected, as is a line that is too long. keep may be diff_id, which findings then have."""
    parsed = diff.diff_files(rows)
    lines = diff.diff_lines(parsed)
    side = lines.where("line_type in ('added', 'context')").select("diff_id", "path", "hunk", "line", "content", "line_type")
    fresh = side.where("line_type = 'added'").select(*keep, "path", "line", "content", (F.char_length("content") > scan.MAX_LINE_CHARS).alias("too_long"))
    unit = ["diff_id", "path", "hunk"]
    good = parsed.where("reject_reason is null")
    change = F.when(F.col("operation") == "create", "added").when(F.col("operation") == "delete", "deleted").otherwise("modified")
    changes = classify.config_changes(good.select("path", change.alias("change")), F.col("change"))
    out = _result(fresh, side.drop("line_type"), changes, config, packs, allow, baseline, side.where("line_type = 'added'").select(*unit, "line"), unit, keep)
    bad = parsed.where("reject_reason is not null").select(F.coalesce("path", "diff_id").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("n_chars"), F.col("reject_reason").alias("reason"))
    out.rejected = out.rejected.unionByName(bad)
    return out


def history(rows: DataFrame, baseline: DataFrame | None = None, **options: object) -> Result:
    """A scan of commits' diffs (diff_id, seq, text), each as a whole: of each fingerprint the finding of the newest commit (the
    least seq), of each configuration change one row, and what any commit's scan had to reject, without which a
    clean result would be an incomplete one. The baseline is applied to the history's findings together.
    """
    out = diffs(rows, keep=("diff_id",), **options)
    seq = rows.select(F.col("diff_id").cast("string").alias("diff_id"), "seq")
    out.findings = policy.first_seen(out.findings.join(seq, "diff_id"), ["seq", "line", "start"]).orderBy("fingerprint")
    out.changes = out.changes.dropDuplicates(["type", "file", "severity", "change_type", "category"])
    if baseline is not None:
        out.counters = policy.baseline_counters(out.findings, baseline)
        out.findings = policy.apply_baseline(out.findings, baseline)
    return out
