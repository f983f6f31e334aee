"""npm range expressions, expanded when a plan is built to bounds that versions are compared with."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import compare_as

_PART = re.compile(r"v?(\d+|[*xX])(?:\.(\d+|[*xX]))?(?:\.(\d+|[*xX]))?(?:-([0-9A-Za-z.-]+))?")


def _numbers(text: str) -> tuple[list[int | None], str]:
    m = _PART.fullmatch(text)
    if not m:
        raise ValueError(f"malformed npm range: {text!r}")
    out: list[int | None] = [None if x is None or x in "*xX" else int(x) for x in m.groups()[:3]]
    if out[0] is None and any(x is not None for x in out[1:]):
        raise ValueError(f"malformed npm range: {text!r}")
    return out, f"-{m[4]}" if m[4] else ""


def bounds(token: str) -> list[tuple[str, str]]:
    """(operator, version) pairs that a token stands for; none for any version."""
    if token in ("", "*", "x", "X"):
        return []
    sign = re.match(r"\^|~|>=|<=|>|<|=|", token)[0]
    rest = token[len(sign) :]
    if sign in (">=", "<=", ">", "<", "="):
        return [(sign, rest)]
    (major, minor, patch), pre = _numbers(rest)
    if major is None:
        return []
    if sign == "" and patch is not None and minor is not None:
        return [("=", rest)]
    low = f"{major}.{minor or 0}.{patch or 0}{pre}"
    if minor is None or (sign == "^" and major > 0):
        high = f"{major + 1}.0.0"
    elif sign in ("~", "") or minor > 0:
        high = f"{major}.{minor + 1}.0"
    else:
        high = f"0.0.{(patch or 0) + 1}"
    return [(">=", low), ("<", high)]


def in_range(version: Column, expression: str) -> Column:
    """Whether a version is in a range: alternatives of || that hold if all their tokens do; null for a
    malformed version. A malformed range raises ValueError."""
    if not expression.strip() or any(not x.strip() for x in expression.split("||")):
        raise ValueError(f"malformed npm range: {expression!r}")
    tests = {"=": lambda c: c == 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0, "<": lambda c: c < 0, "<=": lambda c: c <= 0}
    any_ = F.lit(False)
    for part in expression.split("||"):
        all_ = F.lit(True)
        for token in part.split():
            for op, v in bounds(token):
                all_ = all_ & tests[op](compare_as("semver", version, F.lit(v)))
        any_ = any_ | all_
    return F.when(compare_as("semver", version, version).isNotNull(), any_)
