"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, numbered

#: Weights of the sources, in order, repeating.
WEIGHTS = (1, 2, 3)
#: White space between words (fixed value).
SPACES = " \t\n\x0b\x0c\r"
#: A draw is a whole number below DRAWS; bins by which draws are counted; classes of size that a doubling of it spans.
DRAWS, BINS, CLASSES = 1 << 52, 4096, 4
#: Rows of a plan that may be broadcast.
PLAN_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts as none."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from (source, size): the target words of each source.

    Sources in code point order, null last, take the weights in turn and share all words by
    them; a target stops at ``most`` times its source's words, and what is left over is shared
    again by weight. All targets are least(most * size, level * weight); the level is raised
    by aggregates until it no longer changes, so no table of sources reaches the driver or one task.
    """
    each = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("__n", F.lit(len(weights))) + 1).cast("int")).cast("double")
    each = materialize(each.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total, weight = each.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = total / weight if weight else 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        held, free = each.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        higher = (total - held) / free if free else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(cap, F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(0.0)
    return each.select("source", "source_size", target.alias("target"), rate.alias("rate"))


#: What rows of one document have in common; among them they are numbered.
SAME = ("doc_id", "source", "__h")


def draw(seed: int) -> Column:
    """A whole number below DRAWS by a hash of seed, doc_id, text (``__h``) and a row's number among equal ones (``__o``)."""
    return F.pmod(F.xxhash64(F.lit(f"mix {seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.col("__h"), F.col("__o")), F.lit(DRAWS))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__h", F.coalesce(F.xxhash64("text"), F.lit(0)))


def _apart(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs with their rows' numbers among those of equal SAME, of which counts has how many there are (c). Only
    repeated rows are numbered, dealt in ranges, so many copies are no task's alone."""
    many = counts.where("c > 1").select(*[F.col(c).alias(f"{c}_many") for c in SAME])
    if many.isEmpty():
        return docs.withColumn("__o", F.lit(0).cast("long"))
    on = _key("doc_id", "doc_id_many") & _key("source", "source_many") & (F.col("__h") == F.col("__h_many"))
    rest = docs.join(many, on, "left_anti").withColumn("__o", F.lit(0).cast("long"))
    repeated = docs.join(many, on, "left_semi").withColumn("__all", F.to_json(F.struct(*docs.columns)))
    placed = numbered(repeated, *[F.col(c).asc_nulls_last() for c in SAME], F.col("__all")).drop("__all")
    first = placed.groupBy(*SAME).agg(F.min("__n").alias("__first")).select(*[F.col(c).alias(f"{c}_many") for c in SAME], "__first")
    placed = placed.join(first, on).withColumn("__o", F.col("__n") - F.col("__first"))
    return rest.unionByName(placed.select(*docs.columns, "__o"))


def _stratum(size: Column) -> Column:
    """Class of a document's size; the sizes of one differ by a fifth at most, and empty ones are -1."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) * CLASSES)).otherwise(-1).cast("int")


def _key(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """(__source, __stratum, source_size, target, whole, bound) of rows (source, size, drawn).

    The documents of a source are stratified by size, longest first. A stratum gives as many of its
    documents one more copy as bring the words given so far to the fraction of the words seen so
    far, rounded up or down by a hash of seed, source and stratum so that the expected number is
    exact; within it those of the least draws are taken, that is those below ``bound``.
    """
    rows = rows.withColumn("stratum", _stratum(F.col("size")))
    cells = materialize(rows.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "cells")
    known = materialize(targets(cells.select("source", "size"), weights, most), "targets").withColumnRenamed("source", "__source")
    known = known.withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.floor("rate"))
    unit = F.pmod(F.xxhash64(F.lit(f"round {seed}"), F.coalesce("source", F.lit("\x00")), "stratum"), F.lit(DRAWS)) / F.lit(float(DRAWS))
    # one row of some dozens of strata for each source
    lists = cells.where("size > 0").groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("stratum")).alias("down"), "n", "size", unit.alias("u")))).alias("strata"))
    lists = lists.join(known.select("__source", "fraction"), _key("source", "__source"))

    def step(acc: Column, s: Column) -> Column:
        mean, seen = s["size"] / s["n"], acc["seen"] + s["size"]
        k = F.greatest(F.lit(0), F.least(s["n"], F.floor((F.col("fraction") * seen - acc["given"]) / mean + s["u"]))).cast("long")
        return F.struct(seen.cast("double").alias("seen"), (acc["given"] + k * mean).cast("double").alias("given"), F.concat(acc["ks"], F.array(F.struct((-s["down"]).alias("stratum"), k.alias("k"), s["n"].alias("n")))).alias("ks"))

    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0.0).alias("given"), F.array().cast("array<struct<stratum:int,k:bigint,n:bigint>>").alias("ks"))
    wanted = materialize(lists.select("__source", F.explode(F.aggregate("strata", start, step)["ks"]).alias("x")).select("__source", F.col("x.stratum").alias("__stratum"), "x.k", "x.n"), "wanted")
    some = wanted.where("k > 0 and k < n")
    some = maybe_broadcast(some, some.count(), PLAN_ROWS)
    # the k-th least draw: first its bin, then its place in the bin
    width = DRAWS // BINS
    of = rows.join(some, _key("source", "__source") & (F.col("stratum") == F.col("__stratum"))).withColumn("bin", F.floor(F.col("drawn") / F.lit(width)).cast("int"))
    bins = of.groupBy("__source", "__stratum", "k", "bin").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__source", "__stratum").orderBy("bin"))
    at = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    at = materialize(at.select("__source", "__stratum", "bin", (F.col("k") - F.col("upto") + F.col("c")).cast("int").alias("place")), "bins")
    near = at.toDF("s", "t", "in_bin", "place")
    inside = rows.withColumn("bin", F.floor(F.col("drawn") / F.lit(width)).cast("int")).join(maybe_broadcast(near, at.count(), PLAN_ROWS), _key("source", "s") & (F.col("stratum") == F.col("t")) & (F.col("bin") == F.col("in_bin")))
    bound = inside.groupBy("s", "t", "place").agg(F.sort_array(F.collect_list("drawn")).alias("draws")).select("s", "t", (F.element_at("draws", F.col("place")) + 1).alias("found"))
    plan = wanted.join(bound, _key("__source", "s") & (F.col("__stratum") == F.col("t")), "left")
    plan = plan.select("__source", "__stratum", F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") == F.col("n"), F.lit(DRAWS)).otherwise(F.col("found")).alias("bound"))
    strata = cells.select(F.col("source").alias("s"), F.col("stratum").alias("t"))
    full = strata.join(known.select("__source", "source_size", "target", "whole"), _key("s", "__source")).drop("__source")
    out = full.join(plan, _key("s", "__source") & (F.col("t") == F.col("__stratum")), "left")
    return materialize(out.select(F.col("s").alias("__source"), F.col("t").alias("__stratum"), "source_size", "target", "whole", F.coalesce("bound", F.lit(0)).alias("bound")), "plan")


def _counted(docs: DataFrame) -> DataFrame:
    """(SAME, size, c) of distinct documents and how many rows are each."""
    return materialize(_hashed(docs).select(*SAME, word_count(F.col("text")).alias("size")).groupBy(*SAME, "size").agg(F.count("*").alias("c")), "counted")


def _sized(counts: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, drawn), a row for each row of the documents; equal ones have draws of their own."""
    each = counts.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    return materialize(each.select("doc_id", "source", "size", draw(seed).alias("drawn")), "sizes")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """Every row of docs as (doc_id, size, source_size, target, taken, copies).

    Each document is taken floor(rate) times, rate being target / source_size, and once more
    with probability equal to the fraction: by a hash of seed, doc_id and text, in strata of size
    (see ``_plan``), so that the words taken come within a few short documents of the target. The
    probability deviates only where a stratum of a small source cannot make up for the longer
    documents before it. Reruns agree; of rows repeated in both as many are taken once
    more as the fraction says, each by its number among them. Null texts
    have size 0; a null source is a source of its own; a source without words has target 0. An
    empty table gives no rows; other columns are ignored.
    """
    rows = _sized(_counted(docs), seed)
    plan = _plan(rows, weights, most, seed)
    out = rows.join(maybe_broadcast(plan, plan.count(), PLAN_ROWS), _key("source", "__source") & (_stratum(F.col("size")) == F.col("__stratum")))
    out = out.withColumn("copies", (F.col("whole") + (F.col("drawn") < F.col("bound")).cast("int")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """docs with each row as many times as ``mixture`` takes it, docs' columns kept; the same holds
    for nulls, repeated rows and empty tables. Documents without words get no copy beyond floor(rate)."""
    counts = _counted(docs)
    plan = _plan(_sized(counts, seed), weights, most, seed)
    plan = plan.select("__source", "__stratum", F.col("whole").alias("__whole"), F.col("bound").alias("__bound"))
    sized = _apart(_hashed(docs), counts).withColumn("__size", word_count(F.col("text"))).withColumn("__class", _stratum(F.col("__size")))
    out = sized.join(maybe_broadcast(plan, plan.count(), PLAN_ROWS), _key("source", "__source") & _key("__class", "__stratum"))
    out = out.withColumn("__times", (F.col("__whole") + (draw(seed) < F.col("__bound")).cast("int")).cast("int")).where("__times > 0")
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
