"""Diffs from a local git repository, fetched by the driver and scanned as a table."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

MAX_BYTES, MAX_COMMITS, SECONDS = 4 << 20, 1000, 45


def _git(repo: str, *args: str) -> str:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0"}
    out = subprocess.run(["git", "-C", repo, "--no-pager", *args], env=env, capture_output=True, timeout=SECONDS, check=True).stdout
    if len(out) > MAX_BYTES:
        raise ValueError("git's output is too large")
    return out.decode("utf-8", "replace")


def _safe(ref: str) -> str:
    if not ref or ref.startswith("-") or any(c.isspace() for c in ref):
        raise ValueError("unsafe reference")
    return ref


def staged(spark: SparkSession, repo: str) -> DataFrame:
    """(diff_id, text): what is staged."""
    return spark.createDataFrame([("staged", _git(repo, "diff", "--cached", "--no-ext-diff", "--no-color", "-U3"))], "diff_id string, text string")


def between(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    return spark.createDataFrame([(f"{base}...{head}", _git(repo, "diff", "--no-ext-diff", "--no-color", "-U3", f"{_safe(base)}...{_safe(head)}"))], "diff_id string, text string")


def history(spark: SparkSession, repo: str, since: str | None = None, most: int = 100) -> DataFrame:
    """(diff_id, seq, text) of commits from the newest."""
    if not 1 <= most <= MAX_COMMITS:
        raise ValueError("bad number of commits")
    span = f"{_safe(since)}..HEAD" if since else "HEAD"
    commits = _git(repo, "rev-list", f"--max-count={most}", span).split()
    rows = [(c, i, _git(repo, "show", "--format=", "--no-renames", "--no-ext-diff", "--no-color", "-U3", c)) for i, c in enumerate(commits)]
    return spark.createDataFrame(rows, "diff_id string, seq int, text string")
