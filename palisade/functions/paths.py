"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """POSIX normal form: . and empty segments go, .. takes its parent along; the letter of a
    drive is lower-cased and back slashes are slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = slashed.startswith("/")
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & ((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..") | rooted)
        return F.when((s == "") | (s == "."), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    joined = F.array_join(F.aggregate(F.split(slashed, "/"), none, step), "/")
    lead = F.when(slashed.rlike("^//(?!/)"), "//").when(rooted, "/").otherwise("")
    out = F.concat(lead, joined)
    out = F.when(out == "", ".").otherwise(out)
    return F.when(out.rlike("^[A-Z]:"), F.concat(F.lower(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))).otherwise(out)


def is_safe_relative(path: Column) -> Column:
    """Whether a path neither is absolute nor leaves its root."""
    out = normal(path)
    return ~(out.startswith("/") | out.rlike("^[A-Za-z]:") | (out == "..") | out.startswith("../") | (path == ""))
