"""Alignment of two tokenizers' tokens over the bytes of a text.

The ends of both sides' tokens cut the bytes into elementary intervals; each lies in one token of
either side, so it is one overlap. An end that both share closes a group of tokens, within which
either side's tokens spell the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batch_rows, materialize, maybe_broadcast

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of texts in an Arrow batch; copies of the counts where they are too many to broadcast.
BATCH, SALTS = 500, 32


@dataclass
class Alignment:
    """Of each elementary interval the token of either side that it lies in, and whether both end with it."""

    owner_a: np.ndarray
    owner_b: np.ndarray
    shared: np.ndarray

    def upto(self) -> tuple[np.ndarray, np.ndarray]:
        """For each group how many tokens of either side end with it or before."""
        return self.owner_a[self.shared] + 1, self.owner_b[self.shared] + 1

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places of tokens: those that end together (ends), overlap (overlaps), or share a group (groups)."""
        if kind == "ends":
            return self.owner_a[self.shared], self.owner_b[self.shared]
        if kind == "overlaps":
            return self.owner_a, self.owner_b
        if kind != "groups":
            raise ValueError(f"no such links: {kind}")
        to_a, to_b = self.upto()
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        each = n_a * n_b  # pairs of each group: every token of one side as often as the other has tokens
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(n_b, each)
        return np.repeat(to_a - n_a, each) + at // wide, np.repeat(to_b - n_b, each) + at % wide


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """The alignment of two rising arrays of byte ends, whose last are equal."""
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return Alignment(owner_a, owner_b, (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends))


class Aligner:
    """Both tokenizers of a worker, and what is known of pieces: (n_a, n_b, n_groups, links' id pairs as bytes of longs, groups)."""

    def __init__(self, a: str, b: str, kind: str) -> None:
        self.a, self.b, self.kind = tokens.byte_tokenizer(a, True), tokens.piece_tokenizer(b), kind
        self.bytes_a, self.bytes_b = tokens.byte_values(self.a), tokens.piece_values(self.b)
        self.len_a, self.len_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple | None] = {}

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both sides' ids of each text, or None where their bytes are not those of a space and the text."""
        out = []
        for t, x, y in zip(texts, self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            said, i = f" {t}".encode(), x.ids
            fits = t and b"".join([self.bytes_a[k] for k in i]) == said and b"".join([self.bytes_b[k] for k in y]) == said
            out.append((i, y) if fits else None)
        return out

    def pieces(self, texts: list[str]) -> list[tuple | None]:
        """What is to be known of each text; all are aligned at once, as one line of bytes."""
        both = self.ids(texts)
        fit = [x for x in both if x]
        if not fit:
            return [None] * len(both)
        a, b = (np.fromiter((k for x in fit for k in x[s]), np.int64) for s in (0, 1))
        al = align(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        to_a, to_b = al.upto()
        at_a, at_b = al.links(self.kind)
        keys = (a[at_a] << 32) | b[at_b]
        said_a, said_b = a.astype(str).tolist(), b.astype(str).tolist()
        groups, i, j = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist(), strict=True):
            groups.append(f"{','.join(said_a[i:x])}|{','.join(said_b[j:y])}")
            i, j = x, y
        # a text ends where a group does
        tokens_a, tokens_b = (np.cumsum([len(x[s]) for x in fit]) for s in (0, 1))
        last = np.searchsorted(to_a, tokens_a) + 1
        links = np.searchsorted(at_a, tokens_a)
        rows, before = iter(zip(tokens_a.tolist(), tokens_b.tolist(), last.tolist(), links.tolist(), strict=True)), (0, 0, 0, 0)
        out: list[tuple | None] = []
        for x in both:
            if not x:
                out.append(None)
                continue
            now = next(rows)
            out.append((now[0] - before[0], now[1] - before[1], now[2] - before[2], keys[before[3] : now[3]].tobytes(), ";".join(groups[before[2] : now[2]])))
            before = now
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """What is to be known of each text; None if it has no tokens."""
        cut = [tokens.CUT.split(t) if t else None for t in texts]
        new = list({p for c in cut if c for p in c} - self.known.keys())
        if len(self.known) + len(new) > tokens.REMEMBERED:
            self.known.clear()
            new = list({p for c in cut if c for p in c})
        for start in range(0, len(new), 5000):
            some = new[start : start + 5000]
            self.known.update(zip(some, self.pieces(some), strict=True))
        for t, c in zip(texts, cut, strict=True):
            if not t:
                yield None
                continue
            parts = [self.known[p] for p in c]
            if None in parts:  # a piece whose bytes differ: the whole text is tried
                yield self.pieces([t])[0]
                continue
            n_a, n_b, n_groups, keys, groups = zip(*parts, strict=True)
            yield sum(n_a), sum(n_b), sum(n_groups), b"".join(keys), ";".join(groups)
        for p in new:
            if len(p) > tokens.LONGEST:
                del self.known[p]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def summaries(docs: DataFrame, a: str = BYTES, b: str = PIECES, kind: str = "ends") -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links' id
    pairs (a << 32 | b) with how often each occurs in the text, in pairs and times. Written before it is returned."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b, kind)
        for batch in batches:
            rows, pairs, times = [], [], []
            for found in aligner.texts(batch.column("text").to_pylist()):
                n_a, n_b, n_groups, keys, groups = found or (0, 0, 0, b"", None)
                known, n = np.unique(np.frombuffer(keys, np.int64), return_counts=True)
                rows.append((n_a, n_b, n_groups, len(keys) // 8, hashlib.sha256(groups.encode()).hexdigest() if groups is not None else ""))
                pairs.append(known)
                times.append(n)
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array([r[4] for r in rows], pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int64())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    with batch_rows(docs.sparkSession, BATCH):
        return materialize(docs.select("doc_id", "text").mapInArrow(of, schema).withColumn("__row", F.monotonically_increasing_id()), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, and whether none of its B id has more.

    There are no more rows than pairs of ids, whatever the input.
    """
    n = materialize(found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row an id of B
    return materialize(n.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")


def alignment_digests(docs: DataFrame, a: str = BYTES, b: str = PIECES, kind: str = "ends") -> DataFrame:
    """Of every row of docs the numbers of its tokens, groups and links, how many links are the best of
    their B id over all rows, and the sum of the links' counts.

    A null or empty text, or one whose bytes a side does not give back, has no tokens: zeros and ''.
    Null and repeated doc_ids and repeated rows are rows like any other and all count; an empty table
    gives no rows; other columns of docs are left out.
    """
    found = summaries(docs, a, b, kind)
    counts = pair_counts(found)
    rows = counts.count()
    links = found.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("__row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    known = maybe_broadcast(counts, rows)
    if known is counts:  # too many to broadcast: a frequent pair's rows are dealt to several tasks
        links = links.withColumn("salt", F.pmod("__row", F.lit(SALTS)))
        known = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    on = ["pair"] if "salt" not in known.columns else ["pair", "salt"]
    sums = links.join(known, on).groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "__row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def aligned_spans(docs: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """Every row of docs as (doc_id, a_ids, b_ids, groups): both sides' ids, and for each group the
    places of its first token and of the first after it on either side, and its byte end in a space and the text.

    Texts without tokens (see ``alignment_digests``) have empty arrays.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int,byte_end:bigint>>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(a, b, "ends")
        for batch in batches:
            out = []
            for d, found in zip(batch.column("doc_id").to_pylist(), both.ids([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids_a, ids_b = found or ([], [])
                groups = []
                if found:
                    ends = np.cumsum(both.len_a[ids_a])
                    to_a, to_b = align(ends, np.cumsum(both.len_b[ids_b])).upto()
                    columns = (np.concatenate([[0], to_a[:-1]]), to_a, np.concatenate([[0], to_b[:-1]]), to_b, ends[to_a - 1])
                    groups = [dict(zip(("a_from", "a_to", "b_from", "b_to", "byte_end"), r, strict=True)) for r in zip(*(c.tolist() for c in columns), strict=True)]
                out.append({"doc_id": d, "a_ids": ids_a, "b_ids": ids_b, "groups": groups})
            group = pa.struct([(n, pa.int64() if n == "byte_end" else pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to", "byte_end")])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", batch.schema.field("doc_id").type), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("groups", pa.list_(group))]))

    return docs.select("doc_id", "text").mapInArrow(of, schema)
