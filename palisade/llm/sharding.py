"""Shards of near equal bytes from sampled splitters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

#: Micro-ranges for each shard, and bytes that one task numbers together.
MICRO, MICRO_BYTES = 256, 64 << 20
#: Sampled keys for each micro-range.
DRAWS = 16


def _keys(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "__size": F.octet_length(text).cast("long") + 1,
        "__crc": F.crc32(text.cast("binary")),
        "__k1": F.xxhash64(text),
        "__k2": F.xxhash64(F.lit("second"), text),
        "__k3": F.xxhash64(F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text),
    }


def assign(docs: DataFrame, shards: int = 8, carry: bool = False) -> DataFrame:
    """Every row of docs with its shard and its slot in the shard, gapless from 0.

    The law is ``bytes``: a row weighs its UTF-8 bytes plus one, and the shards' sums are near
    equal. Keys are hashes of the text. A sample drawn in proportion to size gives splitters at
    its quantiles, hence micro-ranges; ranges over twice their share are subdivided by a second
    hash of the text, and texts that alone hold an eighth of a shard by a hash of the row. Whole
    micro-ranges are then dealt in key order to the shards, so equal texts stay in one shard
    unless their copies hold an eighth of it. Micro-ranges number MICRO a shard whatever the
    input, and only their sums reach the driver; slots are numbered in smaller parts of them, of
    about MICRO_BYTES, whose starts are summed up where the parts are.

    Null texts count as empty; null and repeated doc_ids and repeated rows are rows like any
    other; an empty table gives no rows. With carry, docs' own columns are kept and ``shard``
    and ``slot`` are added (or replaced); without it the columns are those of op10.
    """
    spark = docs.sparkSession
    keys = _keys(docs)
    rows = materialize(docs.select("doc_id", *[c.alias(k) for k, c in keys.items()]), "keys")
    total, n = rows.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    micro = shards * MICRO
    draws = DRAWS * micro
    unit = F.pmod(F.xxhash64(F.lit("draw"), "__k3"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sorted(r[0] for r in rows.where(unit < F.col("__size") * F.lit(draws / max(total, 1))).select("__k1").collect())
    splits = sorted({drawn[i * len(drawn) // micro] for i in range(1, micro)}) if drawn else []
    # texts that hold an eighth of a shard or more by the sample
    hot, run = [], 0
    for i, k in enumerate(drawn):
        run = run + 1 if i and drawn[i - 1] == k else 1
        if run >= max(2, len(drawn) / shards / 8) and k not in hot:
            hot.append(k)
    bits = max(4, math.ceil(math.log2(max(micro, 2))))
    shift, low = 64 - bits, -(1 << (bits - 1))
    by_cell: dict[int, list[int]] = {}
    for s in splits:
        by_cell.setdefault(s >> shift, []).append(s)
    cells, base = [], 0
    for cell in range(low, -low):
        own = by_cell.get(cell, [])
        cells.append((cell, base, own))
        base += len(own)
    cell_table = F.broadcast(spark.createDataFrame(cells, "__cell long, __base long, __splits array<long>"))  # 2^bits rows

    def ranged(df: DataFrame) -> DataFrame:
        r = F.col("__base") + F.size(F.filter("__splits", lambda s: s <= F.col("__k1")))
        is_hot = F.col("__k1").isin(hot) if hot else F.lit(False)
        out = df.withColumn("__cell", F.shiftright("__k1", shift)).join(cell_table, "__cell").withColumn("__r", r.cast("long")).drop("__base", "__splits", "__cell")
        return out.withColumn("__own", F.when(is_hot, F.col("__k1")).otherwise(F.lit(0)))

    fair = max(1.0, total / micro)
    first = ranged(rows).groupBy("__r", "__own").agg(F.sum("__size").alias("b")).where(F.col("b") > 2 * fair).collect()
    parts = [(r["__r"], r["__own"], math.ceil(r["b"] / fair)) for r in first]
    part_table = F.broadcast(spark.createDataFrame(parts, "__r long, __own long, __parts long"))  # half the micro-ranges at most

    def grouped(df: DataFrame) -> DataFrame:
        by = F.when(F.col("__own") != 0, F.col("__k3")).otherwise(F.col("__k2"))
        out = ranged(df).join(part_table, ["__r", "__own"], "left")
        return out.withColumn("__sub", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(by, F.col("__parts")))).drop("__parts")

    at, plan = 0, []
    sums = grouped(rows).groupBy("__r", "__own", "__sub").agg(F.sum("__size").alias("b")).collect()
    for g in sorted(sums, key=lambda g: (g["__r"], g["__own"], g["__sub"])):
        plan.append((g["__r"], g["__own"], g["__sub"], min(shards - 1, int((at + g["b"] / 2) * shards / total)), max(1, math.ceil(g["b"] / MICRO_BYTES))))
        at += g["b"]
    plan_table = F.broadcast(spark.createDataFrame(plan, "__r long, __own long, __sub long, __shard int, __fine_n long"))  # two a micro-range at most

    def fine(df: DataFrame) -> DataFrame:
        out = grouped(df).join(plan_table, ["__r", "__own", "__sub"])
        return out.withColumn("__fine", F.pmod(F.xxhash64(F.lit("fine"), "__k3"), F.col("__fine_n")))

    cell = ["__r", "__own", "__sub", "__fine"]
    counts = materialize(fine(rows).groupBy("__shard", *cell).agg(F.count("*").alias("n")), "counts")
    # starts: of the micro-ranges in their shard on the driver, of their parts where they are
    start, before = [], [0] * shards
    for g in sorted(counts.groupBy("__shard", *cell[:3]).agg(F.sum("n").alias("n")).collect()):
        start.append((g["__r"], g["__own"], g["__sub"], before[g["__shard"]]))
        before[g["__shard"]] += g["n"]
    starts = F.broadcast(spark.createDataFrame(start, "__r long, __own long, __sub long, __start long"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*cell[:3]).orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.withColumn("__ahead", ahead).join(starts, cell[:3]).select(*cell, (F.col("__start") + F.col("__ahead")).alias("__before")), "offsets")
    source = docs.select("*", *[c.alias(k) for k, c in keys.items()]) if carry else rows
    order = Window.partitionBy(*cell).orderBy("__k1", "__k3")
    placed = fine(source).join(maybe_broadcast(offsets, offsets.count(), 200_000), cell).withColumn("__slot", F.row_number().over(order) - 1)
    slot = (F.col("__before") + F.col("__slot")).cast("long")
    if carry:
        return placed.select(*[c for c in docs.columns if c not in ("shard", "slot")], F.col("__shard").alias("shard"), slot.alias("slot"))
    return placed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
