"""Reports: rows of text, and whole documents of them, that tasks write in numbered parts.

Evidence is never shown. A document is a table of numbered lines: a head, a section for each type that has rows,
ordered by fingerprint, and a tail. Tasks write ranges of it, so that the parts in order of name are the document; the
driver sees only the counts.
"""

from __future__ import annotations

import html as html_lib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import escape
from palisade.functions.tables import numbered
from palisade.operators.policy import summary

HIDDEN = "[REDACTED]"
#: SARIF's level and security severity of each severity (fixed values).
LEVELS = {"critical": ("error", "9.5"), "high": ("error", "8.0"), "medium": ("warning", "5.0"), "low": ("note", "2.0"), "unknown": ("note", "0.0")}
FIELDS = ("type", "pattern_name", "severity", "file", "line", "rule", "rule_id", "category", "confidence", "remediation", "fingerprint")
VULN_FIELDS = ("fingerprint", "advisory_id", "aliases", "component_purl", "manifest_path", "status", "method", "confidence", "fixed_versions", "explanation", "source", "severity")


def _level(severity: Column, i: int) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(v[i])) for s, v in LEVELS.items()], F.lit("note" if i == 0 else "0.0"))


def json_rows(found: DataFrame, fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """A JSON object a row, evidence hidden, arrays sorted and distinct; with keep in any order, and with those columns."""
    kinds = dict(found.dtypes)
    cols = [F.array_sort(F.array_distinct(c)).alias(c) if kinds[c].startswith("array") else F.col(c) for c in fields if c in kinds]
    hidden = [F.lit(HIDDEN).alias(c) for c in ("matched_text", "line_content") if c in kinds]
    value = F.to_json(F.struct(*cols, *hidden), {"ignoreNullFields": "false"}).alias("value")
    return found.orderBy("fingerprint").select(value) if keep is None else found.select(*keep, value)


def vulnerability_csv(found: DataFrame) -> DataFrame:
    """Text columns, arrays joined, formulas disarmed; for ``write.csv``."""
    kinds = dict(found.dtypes)
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ";") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return found.orderBy("fingerprint").select(*[escape.csv_safe(text(c)).alias(c) for c in VULN_FIELDS if c in kinds])


def github_rows(found: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Workflow commands: error for high and critical, warning for medium, else notice; keep as in ``json_rows``."""
    kind = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    ordered = found.orderBy("fingerprint") if keep is None else found
    return ordered.select(
        *(keep or ()), F.concat(F.lit("::"), kind, F.lit(" file="), escape.github(F.col("file")), F.lit(",line="), F.greatest(F.lit(1), "line").cast("string"), F.lit("::"), escape.github(F.concat_ws(" ", "rule_id", "pattern_name"))).alias("value")
    )


def sarif_results(found: DataFrame) -> DataFrame:
    """SARIF results, one JSON a row; rules are numbered by their first finding in order of fingerprint."""
    first = found.groupBy("rule_id").agg(F.min("fingerprint").alias("f"))  # a row for each rule
    earlier = first.select("rule_id", (F.row_number().over(Window.orderBy("f", "rule_id")) - 1).alias("rule_index"))
    x = found.join(F.broadcast(earlier), "rule_id")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine")).alias("region")).alias("physicalLocation"))
    body = F.struct(
        escape.rule_slug("", F.col("rule_id")).alias("ruleId"), F.col("rule_index").alias("ruleIndex"), _level(F.col("severity"), 0).alias("level"), F.struct(F.col("pattern_name").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), F.struct(_level(F.col("severity"), 1).alias("security-severity")).alias("properties"),
    )
    return x.orderBy("fingerprint").select(F.to_json(body).alias("value"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """SARIF rules, one JSON a row, in the order that ``sarif_results`` numbers them in."""
    by = found.groupBy("rule_id").agg(F.min("pattern_name").alias("name"), F.min("severity").alias("severity"), F.min("fingerprint").alias("f"))
    body = F.struct(F.col("rule_id").alias("id"), "name", F.struct(_level(F.col("severity"), 0).alias("level")).alias("defaultConfiguration"))
    return by.orderBy("f", "rule_id").select(F.to_json(body).alias("value"))


# Whole documents

#: Metrics that a report's summary shows, and how.
METRICS = (
    ("total_findings", "Total findings"), ("critical", "Critical"), ("high", "High"), ("medium", "Medium"), ("low", "Low"), ("secret_findings", "Secret findings"), ("policy_findings", "Policy findings"), ("config_findings", "Configuration changes"),
    ("rejected_lines", "Not scanned"), ("suppressed", "Suppressed by the baseline"), ("total", "Baseline entries"), ("matched", "Baseline entries matched"), ("stale", "Baseline entries stale"),
)
#: Of each section: its title, and its columns with their titles.
SECTIONS = {
    "secret": ("Secrets", (("rule_id", "Rule"), ("severity", "Severity"), ("pattern_name", "Pattern"), ("file", "File"), ("line", "Line"), (None, "Evidence"))),
    "policy": ("Policies", (("rule_id", "Rule"), ("severity", "Severity"), ("category", "Category"), ("file", "File"), ("line", "Line"), ("remediation", "Advice"))),
    "config": ("Configuration changes", (("severity", "Severity"), ("file", "File"), ("change_type", "Change"), ("category", "Category"))),
    "vulnerability": ("Vulnerabilities", (("advisory_id", "Advisory"), ("severity", "Severity"), ("component_purl", "Component"), ("manifest_path", "Manifest"), ("status", "Status"), ("fixed_versions", "Fixed in"))),
}
ADVICE = {
    "secret": "Replace every exposed credential at its provider, and keep the new one out of the repository.",
    "policy": "Follow each rule's advice, or record why the finding is accepted.",
    "config": "Have each change reviewed by whoever owns what it configures.",
    "vulnerability": "Move to a fixed version, or state why the component is not affected.",
}
LINE = "section int, rank long, value string"


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with rank, a row's number in the order; rows that are equal in it are told apart by all they hold."""
    return numbered(df.withColumn("__all", F.to_json(F.struct(*df.columns))), *order, "__all").drop("__all")


def _table(df: DataFrame, fields: tuple[tuple[str | None, str], ...], cell: object, start: str, between: str, end: str) -> Column:
    kinds = dict(df.dtypes)
    shown = [F.lit(HIDDEN) if c is None else F.lit("") if c not in kinds else F.array_join(F.col(c), ", ") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, _ in fields]
    return F.concat(F.lit(start), F.concat_ws(between, *[cell(x) for x in shown]), F.lit(end))


def _sections(found: DataFrame, changes: DataFrame | None, vulnerable: DataFrame | None) -> list[tuple[str, DataFrame, tuple[str, ...]]]:
    out = [(t, found.where(F.col("type") == t), ("fingerprint",)) for t in ("secret", "policy")]
    if changes is not None:
        out.append(("config", changes, ("file", "category", "change_type")))
    if vulnerable is not None:
        out.append(("vulnerability", vulnerable, ("fingerprint",)))
    return out


def lines(found: DataFrame, kind: str, changes: DataFrame | None = None, vulnerable: DataFrame | None = None, title: str = "Findings", counts: dict | None = None) -> DataFrame:
    """A document as numbered lines (section, rank, value): a report of findings, configuration changes and
    vulnerabilities as json, sarif, markdown, html or github. counts: a summary's row, else of the findings."""
    spark = found.sparkSession
    counts = summary(found, changes).first().asDict() if counts is None else counts
    fixed: list[tuple[int, int, str]] = []
    parts: list[DataFrame] = []

    def say(section: int, *texts: str) -> None:
        fixed.extend((section, i, x) for i, x in enumerate(texts))

    def rows(section: int, df: DataFrame, value: Column) -> None:
        parts.append(df.select(F.lit(section).alias("section"), "rank", value.alias("value")))

    listed = lambda: F.concat(F.when(F.col("rank") > 0, ",").otherwise(""), "value")
    if kind == "json":
        say(0, '{"summary": ' + json.dumps(counts, sort_keys=True, default=str))
        for i, (name, df, order) in enumerate((("findings", found, ("fingerprint",)), ("config_changes", changes, ("file", "category", "change_type")), ("vulnerability_findings", vulnerable, ("fingerprint",)))):
            if df is None:
                continue
            say(3 * i + 1, f', "{name}": [')
            rows(3 * i + 2, _ranked(json_rows(df, FIELDS if name == "findings" else (*SECTION_FIELDS["config"], "type") if name == "config_changes" else VULN_FIELDS, keep=order), *order), listed())
            say(3 * i + 3, "]")
        say(99, "}")
    elif kind == "sarif":
        say(0, '{"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "palisade", "rules": [')
        rules = found.groupBy("rule_id").agg(F.min("fingerprint").alias("f"))
        by = sarif_rules(found).withColumn("rule_id", F.get_json_object("value", "$.id")).join(rules, "rule_id").select("f", "rule_id", "value")
        rows(1, _ranked(by, "f", "rule_id"), listed())
        say(2, ']}}, "results": [')
        results = sarif_results(found).withColumn("f", F.get_json_object("value", "$.partialFingerprints.primary"))
        rows(3, _ranked(results, "f"), listed())
        say(4, "]}]}")
    elif kind == "github":
        rows(1, _ranked(github_rows(found, keep=("fingerprint",)), "fingerprint"), F.col("value"))
    elif kind in ("markdown", "html"):
        shown = [(label, counts[k]) for k, label in METRICS if k in counts]
        page = kind == "html"
        esc = html_lib.escape
        if page:
            say(0, f"<!doctype html><html lang=en><meta charset=utf-8><title>{esc(title)}</title>", f"<h1>{esc(title)}</h1>", "<table>", *[f"<tr><th>{esc(k)}</th><td>{v}</td></tr>" for k, v in shown], "</table>")
        else:
            say(0, f"# {title}", "", "| Metric | Count |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in shown], "")
        there = []
        for i, (name, df, order) in enumerate(_sections(found, changes, vulnerable)):
            if df.isEmpty():
                continue
            there.append(name)
            head, fields = SECTIONS[name]
            labels = [label for _, label in fields]
            if page:
                say(10 * i + 10, f"<h2>{head}</h2>", "<table>", "<tr>" + "".join(f"<th>{x}</th>" for x in labels) + "</tr>")
                cell = lambda x: F.concat(F.lit("<td>"), escape.html(x), F.lit("</td>"))
                rows(10 * i + 11, (r := _ranked(df, *order)), _table(r, fields, cell, "<tr>", "", "</tr>"))
                say(10 * i + 12, "</table>")
            else:
                say(10 * i + 10, f"## {head}", "", f"| {' | '.join(labels)} |", f"|{' --- |' * len(labels)}")
                rows(10 * i + 11, (r := _ranked(df, *order)), _table(r, fields, escape.markdown_cell, "| ", " | ", " |"))
                say(10 * i + 12, "")
        if there:
            say(90, *(["<h2>What to do</h2>", "<ul>", *[f"<li>{esc(ADVICE[n])}</li>" for n in there], "</ul>"] if page else ["## What to do", "", *[f"- {ADVICE[n]}" for n in there]]))
        if page:
            say(99, "</html>")
    else:
        raise ValueError(f"unknown report: {kind}")
    out = spark.createDataFrame(fixed, LINE)
    for x in parts:
        out = out.unionByName(x)
    return out


SECTION_FIELDS = {k: tuple(c for c, _ in fields if c) for k, (_, fields) in SECTIONS.items()}


def write_parts(document: DataFrame, path: str) -> None:
    """Writes a document's lines (``lines``) to a new folder of text files, whose contents in order of name are the document."""
    document.repartitionByRange("section", "rank").sortWithinPartitions("section", "rank").select("value").write.text(path)


def join_parts(spark: SparkSession, folder: str, target: str) -> int:
    """Joins a folder's parts to one new file of any store, in bytes: they pass through a small buffer, none is held. Returns the length."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    at, to = path(folder), path(target)
    fs = at.getFileSystem(conf)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    out, n = to.getFileSystem(conf).create(to, False), 0
    try:
        for p in parts:
            stream = fs.open(path(p))
            try:
                n += spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
            finally:
                stream.close()
    finally:
        out.close()
    return n


def document(found: DataFrame, kind: str, changes: DataFrame | None = None, vulnerable: DataFrame | None = None, title: str = "Findings", counts: dict | None = None) -> str:
    """A whole report as one text, for results that a person reads; larger ones are written with ``write_parts``."""
    return "\n".join(r["value"] for r in lines(found, kind, changes, vulnerable, title, counts).orderBy("section", "rank").toLocalIterator())
