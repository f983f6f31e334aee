"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits are grouped by correlation into partitions; dynamic programming gives
each partition its own threshold, so that the thresholds of m partitions sum to
radius - m + 1. Two fingerprints within the radius then differ by at most the threshold
in one partition, so probing each partition within its threshold finds every pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import batch_rows, components, materialize, maybe_broadcast

BITS = 64
#: Fingerprints that the partitioning is estimated on; a bounded sample, taken by hash.
SAMPLE = 1500
#: Members of a bucket that one task compares at once; larger buckets are dealt in pairs of blocks.
BLOCK = 512
#: Cost of one probe row (shuffled and sorted) in comparisons of two fingerprints.
PROBE_COST = 60.0
#: Rows of whole texts in an Arrow batch.
BATCH = 200


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text is not None else []


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of each run of k words joined by a space; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    if k == 1:
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    return np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64,
        len(words) - k + 1,
    )


def majority(h: np.ndarray) -> int:
    """64 bits as a signed long: each is 1 if it is set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[at : at + 65536]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def simhash(text: str | None, k: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(words_of(text), k, seed))


def with_fingerprint(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs' rows as (doc_id, fp): null and word-less texts get fingerprint 0. Run jobs on it within ``batch_rows``, which
    bounds the whole texts that a worker and its executor hold at a time."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle, seed) for t in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) if x.dtype != np.uint64 else x)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bit positions; correlated bits come together."""
    width = math.ceil(BITS / m)
    if len(bits) > 2:
        x = bits - bits.mean(axis=0)
        scale = np.sqrt((x * x).sum(axis=0))
        scale[scale == 0] = 1
        corr = np.abs((x / scale).T @ (x / scale))
    else:
        corr = np.zeros((BITS, BITS))
    left, out = set(range(BITS)), []
    for i in range(m):
        size = min(width, len(left) - (m - i - 1)) if i < m - 1 else len(left)
        size = math.ceil(len(left) / (m - i)) if size > 0 else 0
        order = sorted(left)
        first = max(order, key=lambda b: (corr[b, order].sum(), -b))
        part = [first]
        left.discard(first)
        while len(part) < size:
            order = sorted(left)
            best = max(order, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def choose_partitions(sample: np.ndarray, n: int, radius: int, most: int = 9) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost: (bit positions, threshold).

    For every count m of partitions, dynamic programming allots thresholds (-1 leaves a
    partition out) whose sum is radius - m + 1; the cost is that of the probe rows and of
    the candidate pairs, estimated from pairs of the sample and, below its resolution,
    from the agreement of single bits.
    """
    fp = np.asarray(sample, np.int64).view(np.uint64)
    bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    mean = bits.mean(axis=0) if len(fp) else np.full(BITS, 0.5)
    differ = 2 * mean * (1 - mean)
    a, b = np.triu_indices(len(fp), 1)
    xor = fp[a] ^ fp[b]
    best, plan = math.inf, []
    for m in range(1, most + 1):
        parts = group_bits(bits, m)
        need = radius - m + 1
        cost: list[dict[int, float]] = []
        for part in parts:
            mask = np.uint64(sum(1 << p for p in part))
            dist = _popcount(xor & mask)
            poisson = np.zeros(len(part) + 1)
            poisson[0] = 1
            for p in part:
                poisson[1:] = poisson[1:] * (1 - differ[p]) + poisson[:-1] * differ[p]
                poisson[0] *= 1 - differ[p]
            row = {-1: 0.0}
            for t in range(0, min(radius, 3, len(part)) + 1):
                share = max(float((dist <= t).mean()) if len(dist) else 0, float(poisson[: t + 1].sum()))
                probes = sum(math.comb(len(part), j) for j in range(1, t + 1)) / 2 + 1
                row[t] = PROBE_COST * n * probes + share * n * n / 2
            cost.append(row)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for total, (c, ts) in states.items():
                for t, extra in row.items():
                    if total + t not in nxt or c + extra < nxt[total + t][0]:
                        nxt[total + t] = (c + extra, [*ts, t])
            states = nxt
        if need in states and states[need][0] < best:
            best, plan = states[need][0], [(p, t) for p, t in zip(parts, states[need][1], strict=True) if t >= 0]
    return plan


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probe_keys(fp: F.Column, plan: list[tuple[list[int], int]]) -> F.Column:
    """Bucket keys of a fingerprint: its own value in each partition and, within the
    threshold, the neighbouring values whose highest flipped bit it has not set.
    Of two fingerprints that differ so, exactly one reaches the other's bucket."""

    def near(own: F.Column, table: F.Column) -> F.Column:
        return F.transform(F.filter(table, lambda x: fp.bitwiseAND(x["h"]) == 0), lambda x: own.bitwiseXOR(x["f"]))

    def placed(i: int, keys: F.Column) -> F.Column:
        return F.transform(keys, lambda k: F.xxhash64(F.lit(i), k))

    all_keys = []
    for i, (part, t) in enumerate(plan):
        own = fp.bitwiseAND(F.lit(_signed(sum(1 << p for p in part))))
        flips = [c for j in range(1, t + 1) for c in combinations(part, j)]
        keys = F.array(own)
        if flips:
            table = F.array(*[F.struct(F.lit(_signed(sum(1 << p for p in c))).alias("f"), F.lit(_signed(1 << max(c))).alias("h")) for c in flips])
            keys = F.concat(keys, near(own, table))
        all_keys.append(placed(i, keys))
    return F.concat(*all_keys) if len(all_keys) > 1 else all_keys[0]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node that it is connected with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def compare_sorted(gid: np.ndarray, fp: np.ndarray, ident: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of members of a bucket within the radius connect; gid is sorted."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    idx, d = np.arange(len(gid)), 0
    while len(idx):
        d += 1
        idx = idx[idx + d < len(gid)]
        idx = idx[gid[idx + d] == gid[idx]]
        hit = (_popcount(fp[idx] ^ fp[idx + d]) <= radius) & (ident[idx] != ident[idx + d])
        if hit.any():
            at = idx[hit]
            got.append((ident[at], ident[at + d]))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _spanning(*(np.concatenate(x) for x in zip(*got, strict=True)))


def _by_bucket(compare: Callable[..., tuple[np.ndarray, ...]], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows sorted by the first of columns: compare's links of whole buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        rows = 0

        def done(x: np.ndarray) -> pd.DataFrame:
            a, b, *more = compare(*x)
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)} | {f"c{i}": c for i, c in enumerate(more)}).drop_duplicates()

        for pdf in batches:
            held.append(np.stack([pdf[c].to_numpy(np.int64) for c in columns]))
            rows += len(pdf)
            if rows >= 100_000:
                x = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(x[0], x[0, -1]))
                if cut:
                    yield done(x[:, :cut])
                held, rows = [x[:, cut:]], x.shape[1] - cut
        if rows:
            yield done(np.concatenate(held, axis=1))

    return run


def hamming_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most radius bits.

    nodes: (id long, fps array<long>); two nodes link if any fingerprint of the same
    position is within the radius. A bucket yields a set of edges that connects what its links
    connect, one for each member at most. A bucket of over BLOCK members is dealt out in
    pairs of blocks, so no task holds it alone.
    """
    n = nodes.count()
    share = min(1.0, SAMPLE / max(n, 1))
    near = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = [r[0] for r in nodes.where(near).select(F.col("fps")[0]).limit(4 * SAMPLE).collect()]
    plan = choose_partitions(np.array(sample, dtype=np.int64), n, radius)
    keyed = (
        nodes.select("id", F.posexplode("fps").alias("at", "fp"))
        .select("id", "fp", "at", F.explode(probe_keys(F.col("fp"), plan)).alias("key"))
        .select("id", "fp", F.xxhash64("at", "key").alias("key"))
    )
    hot = keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / F.lit(BLOCK // 2)).cast("int").alias("blocks"))
    hot = materialize(hot, "hot")
    x = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int")
    dealt = (
        keyed.join(maybe_broadcast(hot, hot.count()), "key", "left")
        .withColumn("x", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(x))
        .withColumn("y", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))).alias("gid"), "fp", "id")
    )
    compare = _by_bucket(lambda gid, fp, ident: compare_sorted(gid, fp, ident, radius), ["gid", "fp", "id"])
    return dealt.repartition("gid").sortWithinPartitions("gid").mapInPandas(compare, "a long, b long").distinct()


def link_fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Every row of docs as (doc_id, fingerprint, component_id).

    Words stand between ASCII white space, A-Z lower-cased; a fingerprint bit is 1 if set in
    over half of the XXH64 values of the shingles, repeats included. Fingerprints that differ
    in at most ``radius`` bits are linked; component_id is the least doc_id reachable.
    Null texts and texts without words have fingerprint zero and link like any other; a
    text shorter than a shingle is one shingle; repeated rows share a component; rows
    with a null doc_id take part but never name a component other than null; other columns
    are ignored. An empty table gives no rows.
    """
    with batch_rows(docs.sparkSession, BATCH):
        rows = materialize(with_fingerprint(docs, shingle, seed), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = hamming_links(classes.select(F.col("fp").alias("id"), F.array("fp").alias("fps")), radius)
    found = components(links)
    named = found.join(classes, found.node == classes.fp).select("root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = found.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # written, so that the join of all rows stands on plain exchanges and a fingerprint of many rows is split
    of = materialize(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    out = rows.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
