"""The scan over a stream of texts or diffs.

A line's findings depend on nothing else, so the scan itself keeps no state; only findings seen
before are dropped, within a watermark that bounds what is kept. Lines that the scan does not read are a
stream of their own (``stream_rejected``), without which a stream's result would pass for a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.registry import Rule
from palisade.operators import scan
from palisade.streaming import ordered


def stream_lines(files: DataFrame) -> DataFrame:
    """(path, at, line, content) of a stream of texts (path, text, at), lines from 1."""
    split = files.select("path", "at", F.posexplode(F.split("text", "\n", -1)).alias("n", "content"))
    return split.select("path", "at", (F.col("n") + 1).alias("line"), "content")


def stream_rejected(files: DataFrame) -> DataFrame:
    """(path, line, n_chars, reason, at) of the lines of a stream of texts that are too long to be scanned."""
    return ordered.stream_rejected(stream_lines(files))


def stream_findings(files: DataFrame, rules: list[Rule] | None = None, *, late: str = "1 hour", baseline: DataFrame | None = None) -> DataFrame:
    """Findings of a stream (path, text, at): each fingerprint once within ``late``, without those of a baseline. Lines over
    the limit have none; ``stream_rejected`` has them."""
    lines = stream_lines(files.withWatermark("at", late))
    rules = rules or scan.builtin_rules()
    found = scan.matches(lines, rules).join(F.broadcast(scan.rule_table(files.sparkSession, rules)), "order")
    found = found.where(~scan.is_placeholder(F.col("pattern_name"), F.col("text")))
    out = found.select("at", "path", "line", "rule_id", "pattern_name", "severity", scan.fingerprint(F.col("rule_id"), F.col("path"), F.col("text")).alias("fingerprint"))
    if baseline is not None:
        out = out.join(baseline.toDF("fingerprint").distinct(), "fingerprint", "left_anti")
    return out.dropDuplicatesWithinWatermark(["fingerprint"])


def counts(found: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Findings by event-time window and severity."""
    return found.groupBy(F.window("at", window).alias("window"), "severity").count()


def start(found: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends findings as Parquet; with once, what is there now and then ends."""
    w = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
