"""Texts made safe for where they are shown, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(x: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def html(x: Column) -> Column:
    return _chain(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def markdown_cell(x: Column) -> Column:
    return _chain(html(x), ("|", "\\|"), ("`", "\\`"), ("\n", "<br>"))


def github(x: Column) -> Column:
    """Workflow command text; the percent sign goes first."""
    return _chain(x, ("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C"))


def csv_safe(x: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(F.regexp_replace(x, r"^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def rule_slug(prefix: str, name: Column) -> Column:
    """A rule id of letters, digits, dots and dashes; with eight digits of a digest if that changed the name."""
    bare = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(prefix), F.when(bare == name, bare).otherwise(F.concat_ws("-", bare, F.substring(F.sha2(name, 256), 1, 8))))
