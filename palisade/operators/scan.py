"""The rule scan: lines to findings.

All rules' literals are looked for in a line at once; the line is then tested against the patterns whose
literal it holds; only lines that match go on to spans, overlap resolution and policy. Nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import regexdialect as rx
from palisade.functions.paths import normal
from palisade.functions.registry import ASSIGNED, GENERIC, SEVERITIES, Rule, builtin_rules
from palisade.functions.tables import built, constant

MAX_LINE_CHARS = 256 * 1024
#: The first part of every finding's fingerprint.
NAMESPACE = "palisade-finding-v1"
PLACEHOLDER = r"(?di)^(?:REDACTED|MASKED|PLACEHOLDER)(?:[_-][A-Z0-9]+)+$"
SPAN = "array<struct<start:int,negative:int,order:int,text:string,end:int>>"


def file_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, content, too_long): lines from 1, of whole texts; carriage returns stay.

    A null text has no lines; a line over MAX_LINE_CHARS is marked: ``matches`` leaves it out and
    ``rejected`` reports it.
    """
    split = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n", -1)).alias("at", "content"))
    return split.select("path", (F.col("at") + 1).alias("line"), "content", (F.char_length("content") > MAX_LINE_CHARS).alias("too_long"))


def rejected(lines: DataFrame) -> DataFrame:
    """(path, line, n_chars, reason) of the lines that the scan leaves out, which makes its result incomplete."""
    n = F.char_length("content")
    return lines.where(n > MAX_LINE_CHARS).select("path", "line", n.alias("n_chars"), F.lit("line-exceeds-limit").alias("reason"))


def _spans(line: Column, pattern: Column) -> Column:
    """All matches of a pattern as structs of start, end and text, in characters."""
    found, between = F.regexp_extract_all(line, pattern, F.lit(0)), F.split(line, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        return F.struct((start + F.char_length(x["text"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["text"].alias("text")))).alias("out"))

    each = F.transform(found, lambda m, i: F.struct(F.get(between, i).alias("gap"), m.alias("text")))
    return F.when(F.size(found) == 0, zero["out"]).otherwise(F.aggregate(each, zero, step, lambda acc: acc["out"]))


def _crc32_valid(text: Column) -> Column:
    """Whether the last six characters are the base64 of the little-endian CRC-32 of the 54 before."""
    crc = F.lpad(F.hex(F.crc32(F.substring(text, 5, 54).cast("binary"))), 8, "0")
    swapped = F.concat(F.substring(crc, 7, 2), F.substring(crc, 5, 2), F.substring(crc, 3, 2), F.substring(crc, 1, 2))
    return F.substring(F.base64(F.unhex(swapped)), 1, 6) == F.substring(text, 59, 6)


#: Checks beyond a pattern, by name.
VALIDATORS = {"crc32": _crc32_valid}


def candidates(low: Column, rules: list[Rule]) -> Column:
    """Orders of the rules of which a line holds a literal, and of those without one; all literals are
    looked for at once."""
    of: dict[str, set[int]] = {}
    free = []
    for r in rules:
        own = rx.required(r.regex, r.ignore_case)
        for x in own:
            of.setdefault(x, set()).add(r.order)
        if not own:
            free.append(r.order)
    always = F.array(*map(F.lit, free)).cast("array<int>")
    if not of:
        return always
    # a literal that another begins with is at its place, too
    known = {x: sorted(set().union(*[o for y, o in of.items() if x.startswith(y)])) for x in of}
    held, names = constant(list(known.values()), "array<array<int>>"), constant(list(known), "array<string>")
    each = F.transform(rx.literals_in(low, list(known)), lambda x: F.get(held, F.array_position(names, x).cast("int") - 1))
    return F.array_distinct(F.concat(always, F.flatten(each)))


def rule_hits(line: Column, few: Column, path: Column, rules: list[Rule], relaxed: bool) -> Column:
    """Orders of the candidate rules that match a line in a file whose path fits the rule's globs. Only a candidate's tests
    are run; they are found in two steps, by groups of orders."""
    width = max(1, int(len(rules) ** 0.5))

    def test(r: Rule) -> Column:
        own = line.rlike(rx.java(r.regex, r.ignore_case))
        return rx.any_glob(path, r.globs, relaxed) & own if r.globs else own

    def told(order: Column) -> Column:
        out = None
        for start in range(0, len(rules), width):
            inner = None
            for r in rules[start : start + width]:
                inner = F.when(order == r.order, test(r)) if inner is None else inner.when(order == r.order, test(r))
            out = F.when(order < start + width, inner) if out is None else out.when(order < start + width, inner)
        return F.coalesce(out, F.lit(False))

    return F.filter(few, told) if rules else F.array().cast("array<int>")


def resolve(spans: Column, rules: list[Rule]) -> Column:
    """Of the spans of a line, those that stay: a generic secret gives way to a specific one that it
    overlaps; then, by start, greater length and order, spans that overlap none taken before."""
    generic = constant([r.name in GENERIC for r in rules], "array<boolean>")
    specific = constant([r.kind == "secret" and r.name not in GENERIC for r in rules], "array<boolean>")
    providers = F.filter(spans, lambda s: F.get(specific, s["order"]))
    kept = F.filter(spans, lambda s: ~(F.get(generic, s["order"]) & F.exists(providers, lambda p: (s["start"] < p["end"]) & (p["start"] < s["end"]))))
    zero = F.struct(F.lit(0).alias("upto"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.struct(s["end"].alias("upto"), F.concat(acc["out"], F.array(s)).alias("out"))
        return F.when(s["start"] >= acc["upto"], more).otherwise(acc)

    return F.aggregate(F.array_sort(kept), zero, step, lambda acc: acc["out"])


def matches(lines: DataFrame, rules: list[Rule] | None = None, first_only: bool | str = False, resolved: bool = True) -> DataFrame:
    """(lines' columns, start, order, text) for every match that stays on a line.

    first_only takes each rule's first match and does no more than drop generic secrets from
    lines with a vendor token of CRT-SEC-021 to 134, the older way of scanning; first_only="each" drops none.
    """
    rules = builtin_rules() if rules is None else rules
    rules = [Rule(**{**r.__dict__, "order": i}) for i, r in enumerate(rules)]
    path = rx.normal_path(F.col("path"))
    out = lines.where(F.char_length("content") <= MAX_LINE_CHARS)
    out = out.withColumn("__path", path).withColumn("__low", rx.folded(F.col("content")))
    name = (tuple(rules), first_only, resolved)
    out = _once(out, "__few", built(("few", name), lambda: candidates(F.col("__low"), rules))).where(F.size("__few") > 0)
    out = _once(out, "__hits", built(("hits", name), lambda: rule_hits(F.col("content"), F.col("__few"), F.col("__path"), rules, not first_only))).where(F.size("__hits") > 0)
    out = _once(out, "__all", built(("all", name), lambda: _all_spans(rules)))
    if first_only:
        out = _first_spans(out, rules, first_only)
    kept = built(("kept", name), lambda: resolve(F.col("__all"), rules)) if resolved and not first_only else F.col("__all")
    out = out.withColumn("__m", F.explode(kept))
    return out.select(*lines.columns, F.col("__m.start").alias("start"), F.col("__m.order").alias("order"), F.col("__m.text").alias("text"))


def _all_spans(rules: list[Rule]) -> Column:
    """Spans of the rules in __hits, checked."""
    patterns = constant([rx.java(r.regex, r.ignore_case) for r in rules], "array<string>")
    each = F.flatten(
        F.transform("__hits", lambda h: F.transform(
            _spans(F.col("content"), F.get(patterns, h)),
            lambda s: F.struct(s["start"].alias("start"), (-F.char_length(s["text"])).alias("negative"), h.alias("order"), s["text"].alias("text"), (s["start"] + F.char_length(s["text"])).alias("end")),
        ))
    )
    for r in rules:
        if r.validator:
            each = _checked(each, r.order, VALIDATORS[r.validator])
    return each


def _first_spans(df: DataFrame, rules: list[Rule], first_only: bool | str) -> DataFrame:
    """df whose __all are the spans of the older way. Each step is a column of its own: inside a filter it
    would be worked out, patterns and all, for each span of a line."""
    out = _once(df, "__sorted", F.array_sort("__all")).drop("__all")
    out = _once(out, "__orders", F.transform("__sorted", lambda x: x["order"]))
    out = _once(out, "__all", F.filter("__sorted", lambda s, i: F.coalesce(F.array_position("__orders", s["order"]) == i + 1, F.lit(False))))
    if first_only is True:
        vendor = constant(["CRT-SEC-021" <= r.rule_id <= "CRT-SEC-134" for r in rules], "array<boolean>")
        generic = constant([r.name in GENERIC for r in rules], "array<boolean>")
        out = _once(out, "__some", F.exists("__all", lambda s: F.get(vendor, s["order"])))
        out = out.withColumn("__all", F.filter("__all", lambda s: ~(F.col("__some") & F.get(generic, s["order"]))))
    return out


def secret_matches(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(lines' columns, start, rule_id, pattern_name, text): each secret rule's first match that passes its check, in any
    file; policy rules, file globs, overlaps and placeholders play no part."""
    own = [Rule(**{**r.__dict__, "globs": ()}) for r in (builtin_rules() if rules is None else rules) if r.kind == "secret"]
    found = matches(lines, own, first_only="each", resolved=False).join(F.broadcast(rule_table(lines.sparkSession, own)), "order")
    return found.select(*lines.columns, "start", "rule_id", "pattern_name", "text")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that the optimizer computes in one place: a generator ends the push-down
    of predicates, which would otherwise repeat a costly expression in each."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _checked(spans: Column, order: int, check: object) -> Column:
    return F.filter(spans, lambda s: (s["order"] != order) | check(s["text"]))


def rule_table(spark: object, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.rule_id, r.name, r.severity, r.kind, r.category, r.confidence, r.remediation) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "order int, rule_id string, pattern_name string, severity string, type string, category string, confidence string, remediation string")


def is_placeholder(name: Column, text: Column) -> Column:
    """Whether a generic assignment's value is a canonical placeholder."""
    value = F.regexp_replace(F.trim(F.get(F.split(text, "[=:]", 2), F.lit(1))), "^['\"]+|['\"]+$", "")
    return name.isin(sorted(ASSIGNED)) & F.coalesce(value.rlike(PLACEHOLDER), F.lit(False))


def rank(severity: Column) -> Column:
    return sum((F.when(severity == s, F.lit(i)).otherwise(F.lit(0)) for i, s in enumerate(SEVERITIES)), F.lit(0))


def fingerprint(rule_id: Column, path: Column, text: Column, namespace: str = NAMESPACE) -> Column:
    """A digest of rule, path and evidence that does not depend on the line."""
    evidence = F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u0000", F.lit(namespace), rule_id, normal(path), evidence), 256))


def findings(lines: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = (), **options: object) -> DataFrame:
    """Findings before policy: a row for each match, with its rule's data and fingerprint, and the lines' columns in keep.

    The rules' table is of a size that is known (a few hundred rows) and is broadcast.
    """
    rules = builtin_rules() if rules is None else rules
    found = matches(lines, rules, **options).join(F.broadcast(rule_table(lines.sparkSession, rules)), "order")
    found = found.where(~is_placeholder(F.col("pattern_name"), F.col("text")))
    kind = F.when(F.col("type") == "secret", "secret-pattern").otherwise("policy-pattern")
    return found.select(
        "type", "pattern_name", "severity", F.col("path").alias("file"), "line", "start", F.col("text").alias("matched_text"), F.col("content").alias("line_content"),
        kind.alias("rule"), "rule_id", "category", "confidence", "remediation", fingerprint(F.col("rule_id"), F.col("path"), F.col("text")).alias("fingerprint"), *keep,
    )
