"""Ordered multi-line rules: a pattern on a line, the next on a later one, all within a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import regexdialect as rx
from palisade.functions.registry import ContextRule, builtin_context_rules


def _component(line: Column, low: Column, pattern: str) -> Column:
    literals = rx.required(pattern, True)
    test = line.rlike(rx.java(pattern, True))
    if not literals:
        return test
    holds = F.lit(False)
    for x in literals:
        holds = holds | F.contains(low, F.lit(x))
    return holds & test


def component_lines(lines: DataFrame, rules: list[ContextRule], keep: list[str]) -> DataFrame:
    """(keep, line, content, rule, parts) of the lines that hold a component of a rule whose globs fit: the rule's place
    among rules and the places of its patterns that the line holds. Nothing is shuffled."""
    path = rx.normal_path(F.col("path"))
    low = rx.folded(F.col("content"))
    globs = list(dict.fromkeys(r.globs for r in rules))
    out = lines
    for i, g in enumerate(globs):
        out = out.withColumn(f"__g{i}", rx.any_glob(path, g, relaxed=False))
    distinct = list(dict.fromkeys(p for r in rules for p in r.patterns))
    out = out.withColumn("__low", low)
    out = out.select(*lines.columns, *[f"__g{i}" for i in range(len(globs))], F.explode(F.array(F.array(*[_component(F.col("content"), F.col("__low"), p) for p in distinct]))).alias("__c"))
    tests = []
    for n, r in enumerate(rules):
        own = F.array(*[F.get(F.col("__c"), F.lit(distinct.index(p))) for p in r.patterns])
        tests.append(F.when(F.col(f"__g{globs.index(r.globs)}") & F.array_contains(own, True), F.struct(F.lit(n).alias("rule"), F.filter(F.transform(own, lambda h, i: F.when(h, i)), lambda i: i.isNotNull()).alias("parts"))))
    return out.select(*keep, "line", "content", F.explode(F.array_compact(F.array(*tests))).alias("h")).select(*keep, "line", "content", "h.rule", "h.parts")


def described(found: DataFrame, rules: list[ContextRule], unit: list[str]) -> DataFrame:
    """Matches (unit, rule, line, content, got) with the rules' data; the rules' table has a row a rule."""
    table = found.sparkSession.createDataFrame([(n, r.rule_id, r.name, r.severity, rx.java(r.patterns[0], True)) for n, r in enumerate(rules)], "rule int, rule_id string, pattern_name string, severity string, anchor string")
    out = found.join(F.broadcast(table), "rule")
    return out.select(
        *unit, "rule_id", "pattern_name", "severity", "line", F.regexp_extract_all("content", F.col("anchor"), F.lit(0))[0].alias("matched_text"),
        F.col("content").alias("line_content"), F.concat(F.array(F.col("line").cast("int")), "got").alias("components"),
    )


def context_matches(lines: DataFrame, rules: list[ContextRule] | None = None, unit: list[str] = ("path",)) -> DataFrame:
    """(unit, rule_id, name, severity, line, matched_text, line_content, components) of each match.

    lines: unit columns (a file, or a file and hunk; one is path), line and content. Only lines
    that hold a component of a rule whose globs fit are gathered, by unit and rule. A
    match takes, for each anchor, the first later line of every further pattern; of
    matches with the same further lines that of the first anchor stays.
    """
    rules = builtin_context_rules() if rules is None else rules
    hits = component_lines(lines, rules, list(unit))
    groups = hits.groupBy(*unit, "rule").agg(F.array_sort(F.collect_list(F.struct("line", "parts", F.when(F.array_contains("parts", 0), F.col("content")).alias("content")))).alias("ls"))
    spans, counts = F.array(*[F.lit(r.span) for r in rules]), F.array(*[F.lit(len(r.patterns)) for r in rules])
    groups = groups.withColumn("__span", F.get(spans, F.col("rule"))).withColumn("__n", F.get(counts, F.col("rule")))

    def sequence(anchor: Column, at: Column) -> Column:
        """Lines of the further patterns after the anchor at a place, in order; fewer if one is missing.
        No more lines than the span can follow within it."""
        zero = F.struct(anchor["line"].alias("at"), F.array().cast("array<int>").alias("got"))

        def step(acc: Column, x: Column) -> Column:
            want = F.size(acc["got"]) + 1
            fits = (x["line"] > acc["at"]) & (x["line"] - anchor["line"] <= F.col("__span")) & (want < F.col("__n")) & F.array_contains(x["parts"], want)
            return F.when(fits, F.struct(x["line"].alias("at"), F.concat(acc["got"], F.array(x["line"].cast("int"))).alias("got"))).otherwise(acc)

        return F.aggregate(F.slice("ls", at + 2, F.col("__span")), zero, step, lambda acc: acc["got"])

    starts = lambda x: F.array_contains(x["parts"], 0)
    each = F.filter(F.transform("ls", lambda a, i: F.when(starts(a), F.struct(sequence(a, i).alias("got"), a["line"].alias("line"), a["content"].alias("content")))), lambda m: m.isNotNull())
    found = groups.select(*unit, "rule", "__n", F.explode(F.array(each)).alias("e")).select(*unit, "rule", "__n", F.explode("e").alias("m")).where(F.size("m.got") == F.col("__n") - 1)
    first = found.groupBy(*unit, "rule", F.col("m.got").alias("got")).agg(F.min(F.struct("m.line", "m.content")).alias("a"))
    return described(first.select(*unit, "rule", F.col("a.line").alias("line"), F.col("a.content").alias("content"), "got"), rules, list(unit))


def touching(found: DataFrame, added: DataFrame, unit: list[str] = ("path",)) -> DataFrame:
    """Matches of a diff that hold at least one added line; added: unit columns and line."""
    held = found.select(*found.columns, F.explode("components").alias("__line"))
    some = held.join(added.select(*unit, F.col("line").alias("__line")), [*unit, "__line"], "left_semi")
    return some.drop("__line").distinct()
