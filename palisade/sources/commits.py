"""A log of numbered states, each written once, in any store that Spark reads.

A state is a JSON file named by its number. Whoever writes number n + 1 first has it; another writer of
that number is told so, whatever the store: files appear whole, and none is overwritten.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


#: Stores whose one atomic write is a put that fails if the name is taken, and the option that asks for it.
_CONDITIONAL = {"s3a": "fs.option.create.conditional.overwrite"}


class Commits:
    """The states of one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.full = self.fs.makeQualified(path).toString()
        self.scheme = urlparse(self.full).scheme

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.full}/{name}")

    def last(self) -> tuple[int, dict]:
        """The greatest number and its state; 0 and an empty one of a new log."""
        if not self.fs.exists(self._path("")):
            return 0, {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        stream = self.fs.open(self._path(f"{max(numbers):020}.json"))
        try:
            return max(numbers), json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def put(self, number: int, state: dict) -> None:
        """Writes a number's state, or raises Conflict if it has one."""
        raw, name = json.dumps(state, sort_keys=True).encode(), f"{number:020}.json"
        self.fs.mkdirs(self._path(""))
        if self.scheme == "file":
            self._link(raw, name)
        elif self.scheme in _CONDITIONAL:
            self._conditional(raw, name)
        else:
            self._rename(raw, name)

    def _link(self, raw: bytes, name: str) -> None:
        """A local file system makes a link to a whole file, or says that the name is taken."""
        folder = unquote(urlparse(self.full).path)
        own = f"{folder}/.{uuid.uuid4().hex}"
        with open(own, "xb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, f"{folder}/{name}")
        except FileExistsError as e:
            raise Conflict(name) from e
        finally:
            os.unlink(own)

    def _rename(self, raw: bytes, name: str) -> None:
        """A file system with an atomic rename refuses one to a name that is taken."""
        own = self._path(f".{uuid.uuid4().hex}")
        self._write(self.fs.create(own, False), raw)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, self._path(name), options)
        except Exception as e:
            self.fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def _conditional(self, raw: bytes, name: str) -> None:
        """An object store takes the whole object if there is none of its name."""
        try:
            made = self.fs.createFile(self._path(name)).overwrite(False).must(_CONDITIONAL[self.scheme], True).build()
            self._write(made, raw)
        except Exception as e:
            if any(x in str(e) for x in ("FileAlreadyExists", "PreconditionFailed", "412")):
                raise Conflict(name) from e
            raise

    @staticmethod
    def _write(stream: object, raw: bytes) -> None:
        try:
            stream.write(bytearray(raw))
        finally:
            stream.close()
