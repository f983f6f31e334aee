"""Measures: confusion counts, precision and recall, nearest-rank percentiles, gates and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.tables import materialize, running


def confusion(cases: DataFrame, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn and tn of (expected, observed) cases."""
    e, o = F.col("expected"), F.col("observed")
    return cases.groupBy(*by).agg(F.count_if(e & o).alias("tp"), F.count_if(~e & o).alias("fp"), F.count_if(e & ~o).alias("fn"), F.count_if(~e & ~o).alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where nothing is to be divided by."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nearest_rank(values: Column, percent: int) -> Column:
    """The value at ceil(percent * n) of an array, 0 if it is empty."""
    at = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(percent) / F.lit(100)).cast("int"))
    return F.when(F.size(values) == 0, 0.0).otherwise(F.element_at(F.array_sort(values), at))


def percentiles(df: DataFrame, value: str, percents: tuple[int, ...], by: list[str] = ()) -> DataFrame:
    """Nearest-rank percentiles of a column from running counts of its distinct values, dealt in
    ranges, so that no group's values meet in one task. Null values are left out."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = materialize(running(n, list(by), value, "n"), "upto")
    total = upto.groupBy(*by).agg(F.max("upto").alias("total"))
    if by:
        total = total.toDF(*[f"__{c}" for c in by], "total")
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        upto = upto.join(total, on).drop(*[f"__{c}" for c in by])
    else:
        upto = upto.crossJoin(F.broadcast(total))  # one row
    return upto.groupBy(*by).agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col(value))).alias(f"p{p}") for p in percents])


def regression(current: DataFrame, baseline: DataFrame, most_fp: int = 0, most_fn: int = 0) -> DataFrame:
    """One row: new false positives and negatives against a baseline of the same cases, and whether they pass."""
    kind = F.when(F.col("observed") & ~F.col("expected"), "fp").when(~F.col("observed") & F.col("expected"), "fn")
    new = current.withColumn("kind", kind).where("kind is not null").join(baseline.withColumn("kind", kind).where("kind is not null"), ["case_id", "kind"], "left_anti")
    out = new.agg(F.count_if(F.col("kind") == "fp").alias("new_fp"), F.count_if(F.col("kind") == "fn").alias("new_fn"))
    return out.withColumn("passed", (F.col("new_fp") <= most_fp) & (F.col("new_fn") <= most_fn))


def compare_external(internal: DataFrame, tools: DataFrame) -> DataFrame:
    """(tool, both, internal_only, tool_only) counts of ids; tools: tool, id."""
    i = internal.toDF("id").distinct()
    t = tools.select("tool", "id").distinct()
    n = i.count()
    out = t.join(i.withColumn("__i", F.lit(True)), "id", "left").groupBy("tool").agg(F.count("__i").alias("both"), F.count_if(F.col("__i").isNull()).alias("tool_only"))
    return out.withColumn("internal_only", F.lit(n) - F.col("both"))


def source_coverage(sources: DataFrame) -> DataFrame:
    """(source, records, share of all)."""
    by = sources.groupBy("source").agg(F.sum("records").alias("records"))
    total = by.agg(F.sum("records").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("source", "records", (F.col("records") / F.col("t")).alias("share"))  # one row


def source_status(snapshots: DataFrame) -> DataFrame:
    """(source, snapshots, ids, active) of snapshots (source, snapshot_id, state)."""
    return snapshots.groupBy("source").agg(F.count("*").alias("snapshots"), F.array_sort(F.collect_list("snapshot_id")).alias("ids"), F.max(F.col("state") == "active").alias("active"))


def advisory_metrics(advisories: DataFrame, packages: DataFrame) -> DataFrame:
    """One row of counts: advisories, withdrawn, distinct CVEs, packages, events with a fix."""
    a = advisories.agg(F.count("*").alias("advisories"), F.count("withdrawn").alias("withdrawn"))
    c = advisories.select(F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("x")).where(F.upper("x").startswith("CVE-")).agg(F.countDistinct(F.upper("x")).alias("unique_cves"))
    p = packages.agg(F.count("*").alias("packages"), F.coalesce(F.sum(F.size(F.filter(F.flatten("ranges"), lambda e: e["fixed"].isNotNull()))), F.lit(0)).alias("fixed_events"))
    return a.crossJoin(c).crossJoin(p)  # one row each


def thresholds(metrics: DataFrame, least: dict[str, int]) -> DataFrame:
    """(metric, value, minimum, status) of each minimum: passed, failed, or not_evaluable for an unknown metric."""
    out = None
    for name, low in sorted(least.items()):
        value = F.col(name).cast("long") if name in metrics.columns else F.lit(None).cast("long")
        one = metrics.select(F.lit(name).alias("metric"), value.alias("value"), F.lit(low).cast("long").alias("minimum"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_evaluable").when(F.col("value") >= F.col("minimum"), "passed").otherwise("failed"))
