"""Baseline documents: fingerprints that a scan or a vulnerability report passes over."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.control import strict_json
from palisade.functions.safefile import read_regular, write_private

SCHEMAS = {"scan": "palisade.scan-baseline", "vulnerability": "palisade.vulnerability-baseline"}
BYTES, MOST = 5 << 20, 100_000


def load(spark: SparkSession, path: str, kind: str = "scan") -> DataFrame:
    """(fingerprint) of a baseline document of its exact shape."""
    d = strict_json(read_regular(path, BYTES, "baseline"), BYTES)
    if not isinstance(d, dict) or set(d) != {"schema", "version", "fingerprints"} or d["schema"] != SCHEMAS[kind] or d["version"] != 1:
        raise ValueError("not a baseline of this kind")
    prints = d["fingerprints"]
    if not isinstance(prints, list) or len(prints) > MOST or not all(isinstance(x, str) and re.fullmatch("sha256:[0-9a-f]{64}", x) for x in prints) or len(set(prints)) != len(prints):
        raise ValueError("fingerprints are malformed, repeated or too many")
    return spark.createDataFrame([(x,) for x in prints], "fingerprint string")


def write(found: DataFrame, path: str, kind: str = "scan", overwrite: bool = False) -> int:
    """Writes the sorted distinct fingerprints of findings; a document holds MOST at most, more are an error."""
    prints = [r[0] for r in found.select("fingerprint").distinct().orderBy("fingerprint").limit(MOST + 1).collect()]
    raw = json.dumps({"schema": SCHEMAS[kind], "version": 1, "fingerprints": prints}, indent=2).encode() + b"\n"
    if len(prints) > MOST or len(raw) > BYTES:
        raise ValueError("too many fingerprints for a baseline document; keep them as a table")
    write_private(path, raw, overwrite)
    return len(prints)
