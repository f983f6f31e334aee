"""Files of a folder as a table: what a scan takes, what it passes over, and why."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import policy

MAX_FILE_BYTES = 4 << 20
# Folders and endings that a scan passes over.
FOLDERS = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__")
SUFFIXES = (
    ".pyc", ".pyo", ".so", ".o", ".a", ".exe", ".dll", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".mp3", ".mp4", ".avi", ".mov", ".wav",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".sqlite", ".sqlite3", ".db", ".woff", ".woff2", ".ttf", ".eot",
)


def skip_reason(path: Column, ignore: list[str] = ()) -> Column:
    """Why a relative path is not scanned: folder, ignored or binary-suffix; null if it is."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    # the ending as of a file name: none for a name that only starts with a dot
    suffix = F.regexp_extract(F.element_at(parts, -1), r"^.+(\.[^.]*)$", 1)
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, FOLDERS))), "folder")
        .when(policy.path_fits(path, list(ignore)), "ignored")
        .when(suffix.isin(*SUFFIXES), "binary-suffix")
    )


def reject_reason(length: Column) -> Column:
    return F.when(length > MAX_FILE_BYTES, "file-exceeds-limit")


def accepted(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """files (path, length, ...) with skip_reason and reject_reason; both null for what is scanned."""
    return files.withColumn("skip_reason", skip_reason(F.col("path"), ignore)).withColumn("reject_reason", F.when(F.col("skip_reason").isNull(), reject_reason(F.col("length"))))


def listing(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(path, length) of a local folder's regular files, hidden ones too; links are not followed.

    The names are listed by the driver, the contents are read by executors (``contents``).
    """
    top = Path(root)
    if top.is_symlink() or not top.is_dir():
        raise ValueError("not a folder, or a link")
    rows = []
    for folder, names, files in os.walk(top, followlinks=False):
        names[:] = sorted(n for n in names if n not in FOLDERS) if recursive else []
        for f in sorted(files):
            at = Path(folder, f)
            if not at.is_symlink() and at.is_file():
                rows.append((at.relative_to(top).as_posix(), at.stat().st_size))
    return spark.createDataFrame(rows, "path string, length long")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, length) with their text; bytes that are no UTF-8 become replacement characters. A file that
    has grown beyond the limit since it was listed has its new length and no text, so ``accepted`` refuses it."""
    top = str(Path(root).absolute())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with open(os.open(f"{top}/{path}", os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                    raw = f.read(MAX_FILE_BYTES + 1)
                    whole = len(raw) <= MAX_FILE_BYTES
                    now = len(raw) if whole else max(os.fstat(f.fileno()).st_size, len(raw))
                yield pd.DataFrame({"path": [path], "length": [now], "text": [raw.decode("utf-8", "replace") if whole else ""]})

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "length").repartition(cores).mapInPandas(read, "path string, length long, text string")


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, text) of a folder in any store that Spark reads; names that start with a dot or
    an underscore are left out by Spark's listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    return raw.select(F.expr(f"substr(path, {len(full) + 2})").alias("path"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
