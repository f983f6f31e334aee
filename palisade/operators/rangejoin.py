"""Joins of points with the intervals that hold them, without a look at other pairs.

All ends and points become places in one order, dealt out in ranges. An interval is taken apart into
nodes of a tree over the places, sixteen children each, and a point stands in one node of every level:
the two meet in exactly one node if the interval holds the point, and in none if it doesn't. The join
is then one on equal nodes, in which a group with many rows is spread over as many nodes as it has places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palisade.functions.tables import materialize, numbered

#: Bits of a level: a node has 2^BITS children.
BITS = 4


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """(level, node) of the largest nodes that make up the places from first to last."""
    low = lambda i: F.shiftright(first + ((1 << BITS * i) - 1), BITS * i)  # noqa: E731  the first whole node
    high = lambda i: F.shiftright(last + 1, BITS * i)  # noqa: E731  the first one after them
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    out = []
    for i in range(levels):
        if i == levels - 1:
            own = run(low(i), high(i))
        else:  # what whole nodes of the next level leave out
            up, to = F.shiftleft(low(i + 1), BITS), F.shiftleft(high(i + 1), BITS)
            own = F.when(up < to, F.concat(run(low(i), up), run(to, high(i)))).otherwise(run(low(i), high(i)))
        out.append(F.arrays_zip(F.array_repeat(F.lit(i), F.size(own)).alias("level"), own.alias("node")))
    return F.concat(*out)


def holding(points: DataFrame, spans: DataFrame, by: list[str], at: str, low: str, high: str) -> DataFrame:
    """(points' columns, spans' columns but by, low and high) for every point and interval of its group that holds it, ends included.

    Both sides should be narrow: a point's row is repeated for each level, an interval's for each of its nodes, which
    number at most 30 a level, the levels growing with the logarithm of the longest interval's places. Null
    points, null ends and intervals whose low end is above the high one meet nothing; repeated rows meet each.
    """
    spans = spans.where(F.col(low) <= F.col(high))
    ends = spans.select(*by, F.explode(F.array(low, high)).alias("__at"))
    places = numbered(points.select(*by, F.col(at).alias("__at")).where("__at is not null").unionByName(ends).distinct(), *by, "__at")
    place = lambda name, to: places.select(*by, F.col("__at").alias(name), F.col("rank").alias(to))
    widest = Observation()
    inside = spans.join(place(low, "__low").hint("merge"), [*by, low]).join(place(high, "__high").hint("merge"), [*by, high]).drop(*by, low, high)
    inside = materialize(inside.observe(widest, F.max(F.col("__high") - F.col("__low")).alias("places")), "spans")
    longest = widest.get["places"] or 0
    levels = max(1, -(-int(longest).bit_length() // BITS))
    inside = inside.withColumn("__n", F.explode(_nodes(F.col("__low"), F.col("__high"), levels))).select("*", "__n.level", "__n.node").drop("__low", "__high", "__n")
    own = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("__place", BITS * i).alias("node")) for i in range(levels)])
    stand = points.withColumnRenamed(at, "__at").join(places.select(*by, "__at", F.col("rank").alias("__place")).hint("merge"), [*by, "__at"]).withColumnRenamed("__at", at)
    stand = stand.withColumn("__n", F.explode(own)).select(*points.columns, "__n.level", "__n.node")
    # files say little of what a table holds in memory, so no side is broadcast
    return stand.join(inside.hint("merge"), ["level", "node"]).drop("level", "node")
