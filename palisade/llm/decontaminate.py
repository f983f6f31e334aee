"""Benchmark decontamination by SimHash of item-sized windows.

Only DataFrame functions run here. Windows of an item's length are fingerprinted, looked up
in a multi-index of Hamming blocks, and verified by weighted-shingle similarity.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, maybe_broadcast, row_key, without

BITS, BLOCKS = 64, 8
#: Bits that a window's fingerprint may differ in; of eight blocks one then differs in at most two. The windows at and
#: above the similarity of tests/llm/test_edges.py are all nearer.
RADIUS = 23
SHINGLE, SIMILARITY = 5, 0.8
#: Weights of shingles are whole multiples of 1 / SCALE, and similarities are compared as whole numbers, so ties are exact.
SCALE, PARTS = 1 << 20, 10_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")


def shingles(hashed: Column, k: int) -> Column:
    """Hashes of each k consecutive word hashes; none if there are fewer words."""
    n = F.size(hashed) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def majority(h: Column) -> Column:
    """SimHash of an array of longs: each bit is 1 if it is set in over half of them."""
    bit = lambda b: F.aggregate(h, F.lit(0), lambda acc, x: acc + F.getbit(x, b).cast("int"))
    one = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(2 * bit(b) > F.size(h), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    high = F.aggregate(one, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x))
    return high


def _block(fp: Column, i: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def block_keys(fp: Column, apart: int) -> Column:
    """(block, value) of each block, of all values that differ from it in up to apart bits."""
    width = BITS // BLOCKS
    flips = [sum(1 << b for b in some) for n in range(apart + 1) for some in combinations(range(width), n)]
    each = lambda i: F.transform(F.array(*map(F.lit, flips)), lambda f: F.struct(F.lit(i).alias("block"), _block(fp, i).bitwiseXOR(f).alias("value")))
    return F.concat(*[each(i) for i in range(BLOCKS)])


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n, k, sh, fp): words, shingle length, shingle hashes and fingerprint of each
    different item; null and word-less items are left out."""
    hashed = benchmark.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0).distinct()
    n = F.size("h")
    sh = F.when(n >= shingle, shingles(F.col("h"), shingle))
    for k in range(1, shingle):
        sh = sh.when(n == k, shingles(F.col("h"), k))
    out = hashed.select("item_id", n.alias("n"), F.least(n, F.lit(shingle)).alias("k"), sh.alias("sh"))
    return materialize(out.withColumn("fp", majority(F.col("sh"))), "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(row_key, doc_id, item_id, first_word, n_words, distance, similarity): leaked items.

    A window of as many words as the item has is reported if the two fingerprints differ in
    at most radius (23 or less) bits and their weighted Jaccard similarity (of shingle
    counts, each weighed by its rarity among the items) is at least ``similarity``, a tie included; of each
    text and item the best window stays, of equal ones the nearest fingerprint's, then the first. A
    window that shares no shingle with any item is of similarity zero, so fingerprints are only
    taken where an alignment of a shared shingle puts a window; a passage whose parts stand in
    another order has no such window as a whole. Items of fewer words than a shingle are one
    shingle. Null and empty texts and items have no words; very long texts are whole; repeated
    rows are reported once; copies of an item under several ids are all reported; an empty table
    on either side gives no rows; other columns are ignored.
    """
    if not 0 <= radius < 3 * BLOCKS:
        raise ValueError(f"radius must be below {3 * BLOCKS}")
    apart = radius // BLOCKS
    items = benchmark_items(benchmark, shingle)
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # 1 to shingle
    if not sizes:
        return docs.sparkSession.createDataFrame([], "row_key struct<a:bigint,b:bigint>, doc_id long, item_id long, first_word int, n_words int, distance int, similarity double")
    spots = items.select("n", "k", F.posexplode("sh").alias("q", "s")).groupBy("k", "s").agg(F.collect_set(F.struct("n", "q")).alias("at"))
    spots = materialize(spots, "spots")
    spots_n = spots.count()
    hashed = docs.select("doc_id", row_key().alias("rk"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    hits = None
    for k in sizes:
        one = hashed.select("rk", F.size("h").alias("len"), F.posexplode(shingles(F.col("h"), k)).alias("p", "s"))
        own = spots.where(F.col("k") == k).select("s", "at")
        one = one.join(maybe_broadcast(own, spots_n, BROADCAST_ROWS // 4), "s").select("rk", "len", "p", F.lit(k).alias("k"), "at")
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.select("rk", "len", "p", "k", F.explode("at").alias("x")).select("rk", "k", F.col("x.n").alias("n"), "len", (F.col("p") - F.col("x.q")).alias("start"))
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.col("len") - F.col("n")))
    windows = materialize(hits.where(F.col("len") >= F.col("n") * F.lit(similarity)).select("rk", "k", "n", start.alias("start")).distinct(), "windows")
    per_doc = windows.groupBy("rk").agg(F.collect_list(F.struct("k", "n", "start")).alias("windows"))
    per_doc = materialize(per_doc, "per_doc")
    met = hashed.join(maybe_broadcast(per_doc.select("rk"), per_doc.count()), "rk", "left_semi").join(per_doc, "rk").dropDuplicates(["rk"])
    cut = met.select("rk", "doc_id", "h", F.explode("windows").alias("w"))
    part = F.slice("h", F.col("w.start") + 1, F.col("w.n"))
    cut = cut.select("rk", "doc_id", F.col("w.k").alias("k"), F.col("w.n").alias("n"), F.col("w.start").alias("start"), part.alias("part"))
    sh = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in sizes:
        sh = sh.when(F.col("k") == k, shingles(F.col("part"), k))
    shot = materialize(cut.select("rk", "doc_id", "n", "start", sh.alias("wsh")).withColumn("wfp", majority(F.col("wsh"))), "shot")
    index = items.select("item_id", "n", "fp", F.explode(block_keys(F.col("fp"), apart)).alias("b")).select("item_id", "n", "fp", "b.*").distinct()
    found = shot.select("rk", "n", "start", "wfp", F.explode(block_keys(F.col("wfp"), 0)).alias("b")).select("rk", "n", "start", "wfp", "b.*")
    found = found.join(maybe_broadcast(index, items.count() * BLOCKS * (1, 9, 37)[apart], BROADCAST_ROWS // 4), ["n", "block", "value"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp"))).cast("int")
    found = found.withColumn("distance", distance).where(F.col("distance") <= radius).select("rk", "n", "start", "item_id", "distance").distinct()
    # weighted Jaccard over shingle counts
    total = items.select("item_id").distinct().count()
    df = items.select("item_id", F.explode(F.array_distinct("sh")).alias("s")).distinct().groupBy("s").agg(F.count("*").alias("df"))
    scaled = lambda x: F.round(F.log(F.lit(1.0) + x) * SCALE).cast("long")
    weight, heavy = scaled(F.lit(float(total)) / F.col("df")), scaled(F.lit(float(total)))
    mine = items.select("item_id", "n", F.explode("sh").alias("s")).groupBy("item_id", "n", "s").agg(F.count("*").alias("c")).join(df, "s").select("item_id", "n", "s", "c", weight.alias("w"))
    bags = mine.groupBy("item_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("c", "w")))).alias("bag"), F.sum(F.col("c") * F.col("w")).alias("mass"))
    bags = materialize(bags, "bags")
    pairs = found.join(shot, ["rk", "n", "start"]).join(maybe_broadcast(bags, items.count(), 20_000), ["item_id", "n"])
    # counts of the window's shingles that the item has; others weigh as shingles of no item
    counts = F.transform(F.array_distinct("wsh"), lambda s: F.struct(s.alias("s"), F.size(F.filter("wsh", lambda x: x == s)).alias("c")))
    in_item = lambda e: F.try_element_at(F.col("bag"), e["s"])
    zero = F.lit(0).cast("long")
    both = F.aggregate("counts", zero, lambda acc, e: acc + F.coalesce(F.least(e["c"].cast("long"), in_item(e)["c"]) * in_item(e)["w"], zero))
    more = F.aggregate("counts", zero, lambda acc, e: acc + F.coalesce(F.greatest(e["c"] - in_item(e)["c"], zero) * in_item(e)["w"], e["c"] * heavy))
    scored = pairs.withColumn("counts", counts).withColumn("both", both).withColumn("all", F.col("mass") + more)
    scored = scored.where(F.col("both") * PARTS >= F.lit(round(similarity * PARTS)) * F.col("all"))
    scored = scored.select("rk", "doc_id", "item_id", F.col("start").alias("first_word"), F.col("n").alias("n_words"), "distance", (F.col("both") / F.col("all")).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("first_word")).alias("f"), "n_words"))
    out = scored.groupBy("rk", "doc_id", "item_id").agg(best.alias("b"))
    return out.select(F.col("rk").alias("row_key"), "doc_id", "item_id", (-F.col("b.f")).alias("first_word"), F.col("b.n_words").alias("n_words"), (-F.col("b.d")).alias("distance"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """docs without the rows that hold an item; docs' columns are kept. Null and empty texts stay, as
    do all rows if either table has no item; repeated rows go or stay together."""
    gone = materialize(contaminated(docs, benchmark, **options).select("row_key").distinct(), "gone")
    return without(docs, gone)
