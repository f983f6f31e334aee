"""Corpora as files of token ids, range-coded.

A folder of ids is a Parquet table with a row a segment: ``part`` and ``segment`` give its place, ``doc_ids``
its documents, and ``data`` is the segment in the format of ``rangecoder``: lengths of the documents and
blocks that are independent and checksummed. Spark's writer commits the files, so lost executors leave none
behind, and any store that Spark writes to will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder, tokens
from .common import batch_rows, materialize, maybe_broadcast, shared_folder

#: Ids after which a segment ends with the document at hand; rows of texts in an Arrow batch.
SEGMENT_IDS, BATCH = rangecoder.BLOCK * rangecoder.LANES, 500


class _Encoder:
    """Ids of whole texts as bytes of unsigned 32-bit numbers, by pieces."""

    def __init__(self, file: str) -> None:
        self.t = tokens.byte_tokenizer(file, False)
        self.known: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        cut = []
        for t in texts:
            parts = tokens.CUT.split(t)
            # all pieces but the first have their space
            cut.append([parts[0], *[f" {p}" for p in parts[1:]]])
        new = list({p for c in cut for p in c} - self.known.keys())
        if len(self.known) + len(new) > tokens.REMEMBERED:
            self.known.clear()
            new = list({p for c in cut for p in c})
        for start in range(0, len(new), 5000):
            some = new[start : start + 5000]
            for p, e in zip(some, self.t.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, "<u4").tobytes()
        for c in cut:
            yield b"".join([self.known[p] for p in c])
        for p in new:
            if len(p) > tokens.LONGEST:
                del self.known[p]


def write_ids(docs: DataFrame, path: str, file: str = "byte_bpe_50k.json", end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of docs' texts, each followed by end_id, in ascending doc_id order, to a new folder.

    Null texts count as empty, null doc_ids stand last; equal doc_ids stand by a hash of the text.
    Rows are dealt in ranges of that order, so a task writes documents that stand together; a segment
    holds whole documents and, but for one that is longer, about segment_ids ids.
    """
    text = F.coalesce("text", F.lit(""))
    schema = f"part int, segment int, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, data binary"
    kind: list[pa.DataType] = []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, segment = TaskContext.get().partitionId(), _Encoder(file), 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        names: list = []
        ids = 0

        def flush() -> pa.RecordBatch:
            data = rangecoder.pack(np.frombuffer(b"".join(held), "<u4"), np.array([len(h) // 4 for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([names], pa.list_(kind[0])), pa.array([data], pa.binary())], ["part", "segment", "doc_ids", "data"])

        for batch in batches:
            kind[:] = [batch.schema.field("doc_id").type]
            for name, found in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text").to_pylist()), strict=True):
                held.append(found + end)
                names.append(name)
                ids += len(found) // 4 + 1
                if ids >= segment_ids:
                    yield flush()
                    held, names, ids, segment = [], [], 0, segment + 1
        if held:
            yield flush()

    with batch_rows(docs.sparkSession, BATCH):
        dealt = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("__at"))
        # equal rows are told apart by their place, so that many of them fill several ranges
        own = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("__at")]
        dealt.repartitionByRange(*own).sortWithinPartitions(own[0], own[1], "text", own[2]).drop("__at").mapInArrow(of, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, part, segment, place (in the segment), before (ids of the segment's
    documents before it), n_tokens, and ids, or with digest ids_crc32 alone. A segment is a batch of its own: run jobs
    on it within ``batch_rows(spark, 1)``, which bounds a worker's memory. A block without its checksum ends the job."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = rangecoder.Segment(batch.column("data")[row].as_py())
                ids, n = held.ids(), len(held.lengths)
                to = np.cumsum(held.lengths)
                start = to - held.lengths
                if digest:
                    value = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(start, to, strict=True)], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array([0, *to], pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values, pa.array([batch.column("part")[row].as_py()] * n, pa.int32()), pa.array([batch.column("segment")[row].as_py()] * n, pa.int32()),
                        pa.array(np.arange(n), pa.int32()), pa.array(start), pa.array(held.lengths), value,
                    ],
                    ["doc_id", "part", "segment", "place", "before", "n_tokens", last.split()[0]],
                )

    return table.select("part", "segment", "doc_ids", "data").mapInArrow(of, f"doc_id {kind}, part int, segment int, place int, before bigint, n_tokens bigint, {last}")


def with_starts(read: DataFrame) -> DataFrame:
    """Documents of ``read_ids`` (a written table) with ``start``, the ids of all documents before them.

    Sums of the parts, one a writing task, meet on the driver; those of a part's segments stay where they are.
    """
    spark = read.sparkSession
    segments = materialize(read.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n")), "segments")
    at, parts = 0, []
    for r in sorted(segments.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        parts.append((r["part"], at))
        at += r["n"]
    known = F.broadcast(spark.createDataFrame(parts, "part int, __part long"))  # a row a writing task
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(segments.withColumn("__ahead", ahead).join(known, "part").select("part", "segment", (F.col("__part") + F.col("__ahead")).alias("__start")), "starts")
    return read.join(maybe_broadcast(starts, starts.count(), 200_000), ["part", "segment"]).withColumn("start", F.col("__start") + F.col("before")).drop("__start")


def written_digests(docs: DataFrame, file: str = "byte_bpe_50k.json", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes docs' ids (see ``write_ids``) and reads them back: doc_id, start, n_tokens, ids_crc32 of every row.

    Null and empty texts have the end id alone; repeated rows and doc_ids are documents like any other; an
    empty table gives no rows; other columns of docs are left out. Strings of special tokens in a text get their ids,
    as the tokenizer does by itself. The folder is a new one in the shared folder unless path names one.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/palisade-{uuid.uuid4().hex}/ids"
    write_ids(docs, path, file, end_id)
    with batch_rows(spark, 1):
        read = materialize(read_ids(spark, path, digest=True), "read")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
