"""Findings of another secret scanner's redacted report: a JSON array, or SARIF 2.1.0."""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.paths import normal
from palisade.functions.safefile import read_regular
from palisade.operators.scan import NAMESPACE

REPORT_BYTES, FINDINGS, LINES = 8 << 20, 10_000, 10_000_000
# What redacted evidence looks like, and what no message may hold.
REDACTED = ("", "REDACTED", "[REDACTED]", "***")
TOKENS = r"(?i)(?:ghp_|AKIA|glpat-|xox[bp]-|sk_live_)"
RULE = "CRT-GL-001"


def _finding(rule: Column, path: Column, line: Column, identity: Column, reason: Column) -> list[Column]:
    place = F.concat_ws(":", path, rule, line.cast("string"))
    known = F.when(F.char_length(identity) <= 512, identity).otherwise(place)
    evidence = F.concat(F.lit("external:gitleaks:"), rule, F.lit(":"), F.sha2(F.coalesce(known, place), 256))
    parts = F.split(path, "/")
    unsafe = path.isNull() | (path == "") | path.contains("\\") | path.contains("\0") | path.startswith("/") | F.array_contains(parts, "..")
    bad = (
        F.when(reason.isNotNull(), reason).when(rule.isNull() | ~rule.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), "malformed rule id")
        .when(F.coalesce(unsafe, F.lit(True)), "unsafe path").when(line.isNull() | (line < 1) | (line > LINES), "malformed line")
    )
    fp = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\0", F.lit(NAMESPACE), F.lit(RULE), normal(path), evidence), 256))
    return [
        F.lit("secret").alias("type"), rule.alias("pattern_name"), F.lit("high").alias("severity"), normal(path).alias("file"), line.cast("int").alias("line"), evidence.alias("matched_text"), F.lit("[REDACTED]").alias("line_content"),
        F.lit(RULE).alias("rule_id"), F.lit("gitleaks").alias("category"), F.lit("high").alias("confidence"), F.lit("Rotate the credential, clean the history and run the other scanner again.").alias("remediation"), fp.alias("fingerprint"), bad.alias("reject_reason"),
    ]


def json_findings(files: DataFrame) -> DataFrame:
    d = F.from_json("text", "array<struct<RuleID:string,File:string,StartLine:long,Fingerprint:string,Secret:string,Match:string>>")
    r = files.where(F.ltrim("text").startswith("[")).select(F.explode(d).alias("r")).select("r.*")
    shown = ~F.coalesce("Secret", F.lit("")).isin(*REDACTED) | ~F.coalesce("Match", F.lit("")).isin(*REDACTED)
    return r.select(*_finding(F.col("RuleID"), F.col("File"), F.col("StartLine"), F.col("Fingerprint"), F.when(shown, "evidence is not redacted")))


def sarif_findings(files: DataFrame) -> DataFrame:
    """Results of all runs, each at its first location."""
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long>>>"
    d = F.from_json("text", f"struct<version:string,runs:array<struct<results:array<struct<ruleId:string,message:struct<text:string>,fingerprints:struct<gitleaksFingerprint:string>,locations:array<{place}>>>>>>")
    r = files.where(F.ltrim("text").startswith("{")).select(d.alias("d")).where("d.version = '2.1.0'").select(F.explode("d.runs").alias("run")).select(F.explode("run.results").alias("r")).select("r.*")
    at = F.get("locations", F.lit(0))["physicalLocation"]
    said = F.coalesce(F.col("message.text"), F.lit(""))
    reason = F.when(said.rlike(TOKENS) | (F.char_length(said) > 2048), "evidence is not redacted")
    return r.select(*_finding(F.col("ruleId"), at["artifactLocation"]["uri"], at["region"]["startLine"], F.col("fingerprints.gitleaksFingerprint"), reason))


def findings(files: DataFrame) -> DataFrame:
    """Findings of reports (path, text), one of each fingerprint; rows with a reject_reason are those that a strict import refuses."""
    return json_findings(files).unionByName(sarif_findings(files)).dropDuplicates(["fingerprint"])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The findings of one report; it is refused as a whole if a finding is, or if it has too many."""
    text = read_regular(path, REPORT_BYTES, "report").decode("utf-8")
    out = findings(spark.createDataFrame([(path, text)], "path string, text string"))
    if bad := out.where("reject_reason is not null").first():
        raise ValueError(f"report is refused: {bad['reject_reason']}")
    if out.count() > FINDINGS:
        raise ValueError("report has too many findings")
    return out.drop("reject_reason")


def run(spark: SparkSession, binary: str, repo: str, seconds: int = 60) -> DataFrame:
    """Runs a scanner that the operator names by its full path, redacting, and loads its report."""
    program, source = Path(binary), Path(repo)
    if not program.is_absolute() or not program.is_file() or not source.is_dir():
        raise ValueError("the program or the folder is missing")
    with tempfile.TemporaryDirectory() as folder:
        report = f"{folder}/report.json"
        done = subprocess.run([str(program), "detect", "--source", str(source.resolve()), "--report-format", "json", "--report-path", report, "--redact", "--no-banner"], capture_output=True, timeout=seconds, check=False, env={"PATH": "/usr/bin:/bin"})
        if done.returncode not in (0, 1):
            raise ValueError(f"the program failed with {done.returncode}")
        return load(spark, report)
