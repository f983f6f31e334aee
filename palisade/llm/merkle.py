"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

Only DataFrame functions run here. A line is a paragraph. A section ends with a blank
line, before a heading, or after a paragraph whose digest ends in a zero digit, so sections keep
their borders when text is inserted elsewhere. A paragraph is cut into leaves after words that
end in one of a few letters or in a punctuation mark, so leaves, too, keep their borders. A
paragraph's digest is the SHA-256 of its text, a section's that of its paragraphs' entries, and
the root that of the sections' digests. Equal roots are equal texts; unequal ones are as alike as the
leaves of their trees, and the paragraphs that only one tree has are the edits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: White space after these ends a leaf.
CUT = "(?<=[hnt\\p{P}\\p{S}])[ \\t]+"
#: Rows of documents that a range of the order holds.
RANGE_ROWS = 2000
#: The least long.
_LOW = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """The lines of a text, each with the 32-bit digests of its leaves, as an array of
    struct(t, l). Null counts as empty; an empty text is one empty paragraph without a leaf."""
    leaf = lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))
    of = lambda p: F.transform(F.filter(F.split(p, CUT), lambda x: x != ""), leaf)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.struct(p.alias("t"), of(p).alias("l")))


def tree(parts: Column) -> Column:
    """Of a text's paragraphs its sections, in order, as strings ``digest=paragraph,paragraph,``;
    a paragraph is ``digest.leaves``, the leaves' digests in base 64; digests of paragraphs are cut to
    16 digits, those of sections have all 64."""
    hexed = lambda v: F.lpad(F.hex(v), 8, "0")
    entry = lambda p: F.struct(F.sha2(p["t"], 256).alias("d"), ((p["t"] == "") | p["t"].startswith("#")).alias("open"), F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(p["l"], hexed), ""))), "\\s", "").alias("l"))
    each = F.transform(F.transform(parts, entry), lambda p: F.concat(F.when(p["open"], ";").otherwise(""), p["d"], F.lit("."), p["l"], F.when(p["d"].endswith("0"), ",;").otherwise(",")))
    sections = F.filter(F.split(F.array_join(each, ""), ";+"), lambda s: s != "")
    return F.transform(sections, lambda s: F.concat(F.sha2(s, 256), F.lit("="), F.regexp_replace(s, "([0-9a-f]{16})[0-9a-f]{48}\\.", "$1.")))


def leaves(parts: Column) -> Column:
    """Distinct digests of a text's leaves."""
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: p["l"])))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 64)), ","), 256)


def fingerprint(sections: Column) -> Column:
    """``root:section;section``: the tree as one string."""
    short = F.transform(sections, lambda s: F.concat(F.substring(s, 1, 16), F.substring(s, 65, 1 << 30)))
    return F.concat_ws(":", root(sections), F.array_join(short, ";"))


def root_of(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def paragraphs_of(fp: Column) -> Column:
    """Digests of a fingerprint's paragraphs, in order."""
    return F.regexp_extract_all(fp, F.lit("([0-9a-f]{16})\\."), F.lit(1))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint b has left a: the positions, from 0, of a's different paragraphs (the first
    of equal ones) that b does not hold. Equal roots end the search; else both trees' paragraphs
    are sorted together, so the cost is that of a sort."""
    mine = F.transform(paragraphs_of(a), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    theirs = F.transform(F.array_distinct(paragraphs_of(b)), lambda p: F.struct(p.alias("p"), F.lit(-1).alias("i")))
    own = lambda s: F.filter(s, lambda x, k: (x["i"] >= 0) & ((k == 0) | (F.get(s, k - 1)["p"] != x["p"])))
    at = _let(F.sort_array(F.concat(mine, theirs)), lambda s: F.sort_array(F.transform(own(s), lambda x: x["i"])))
    return F.when(root_of(a) == root_of(b), F.array().cast("array<int>")).otherwise(at)


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else the share that two trees have of their distinct leaves (Dice), below 1;
    shared sections and paragraphs share their leaves."""
    both = F.size(F.array_intersect(leaves_a, leaves_b)).cast("double")
    total = (F.size(leaves_a) + F.size(leaves_b)).cast("double")
    dice = F.when(total > 0, 2 * both / total).otherwise(0.0)
    return F.when(root_a == root_b, 1.0).otherwise(F.least(dice, F.lit(1 - 1e-9)))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, also: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(doc_id, text, next_text) of every row: the next row by descending doc_id, after the last
    the first; null texts count as empty. Columns that ``also`` adds come with a ``next_`` of each.

    Rows of one doc_id are ordered by a hash of the text, then the text; null doc_ids come last. Rows go to
    ranges of that order, about range_rows in each, whose borders are quantiles of doc_id; an id
    that fills ranges of its own, null like any other, is split by the hash. Each range's first row
    goes to the range before it too, so one shuffle of the texts is all.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    n, nulls = keys.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, -(-n // range_rows))
    cuts = keys.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [] if ranges > 1 else []
    ranged = _ranges(spark, sorted(cuts), -(-nulls // range_rows))
    # one row a range
    border = ranged(keys).groupBy("seg", "sub").agg(F.max(F.struct("doc_id", (F.lit(-1) - F.col("h")).alias("g"))).alias("top"))
    border = sorted(((r["seg"], r["sub"], r["top"]["doc_id"], -1 - r["top"]["g"]) for r in border.collect()), key=lambda r: r[:2])
    known = spark.createDataFrame([(*r, k, (k or len(border)) - 1) for k, r in enumerate(border)], "seg int, sub int, top long, top_h long, home int, before int")
    homed = ranged(keyed).join(F.broadcast(known), ["seg", "sub"])
    is_top = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h"))
    here, there = F.struct(F.col("home"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("home"), F.lit(1).alias("ghost"))
    dealt = homed.select("doc_id", "text", "h", F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))).alias("to")).select("doc_id", "text", "h", "to.*")
    # of several equal first rows one copy is enough, and any will do
    order = Window.partitionBy("home").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    rows = also(dealt.repartition("home"))
    kept = [c for c in rows.columns if c not in ("doc_id", "h", "home", "ghost")]
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in kept}).where("ghost = 0").drop("h", "home", "ghost")


def _ranges(spark: object, cuts: list[int], null_parts: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds (seg, sub), in the order of descending doc_id, then h: a segment lies
    between two cuts; a cut that repeats is an id with a segment of its own, in as many parts by h."""
    times: dict[int, int] = {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    own = sorted(times)
    width = max(1, (own[-1] - own[0]) // len(own) + 1) if own else 1
    by_cell: dict[int, list[tuple[int, int]]] = {}
    for c in own:
        by_cell.setdefault((c - own[0]) // width, []).append((c, times[c]))
    cells, above = [], len(own)
    for cell in range(-1, len(own) + 1):
        cells.append((cell, above, by_cell.get(cell, [])))
        above -= len(by_cell.get(cell, []))
    table = spark.createDataFrame(cells, "cell long, above int, own array<struct<c:long,m:int>>")  # a row for each cut
    at_h = lambda parts: F.least(parts - 1, F.floor((F.col("h").cast("double") - F.lit(float(_LOW))) / F.lit(2.0**64) * parts)).cast("int")

    def add(rows: DataFrame) -> DataFrame:
        if not own:
            seg, sub = F.when(F.col("doc_id").isNull(), 1).otherwise(0), F.when(F.col("doc_id").isNull(), at_h(F.lit(max(1, null_parts)))).otherwise(0)
            return rows.withColumn("seg", seg).withColumn("sub", sub)
        cell = F.greatest(F.lit(-1), F.least(F.lit(len(own)), F.floor((F.col("doc_id") - F.lit(own[0])) / F.lit(width)))).cast("long")
        out = rows.withColumn("cell", F.coalesce(cell, F.lit(-1))).join(F.broadcast(table), "cell")
        less = F.size(F.filter("own", lambda c: c["c"] <= F.col("doc_id")))
        full = F.get(F.filter("own", lambda c: (c["c"] == F.col("doc_id")) & (c["m"] > 1)), F.lit(0))["m"]
        # an id of its own ranges stands after the greater ids of its segment
        seg = F.when(F.col("doc_id").isNull(), F.lit(2 * len(own) + 2)).otherwise(2 * (F.col("above") - less) + full.isNotNull().cast("int")).cast("int")
        sub = F.when(F.col("doc_id").isNull(), at_h(F.lit(max(1, null_parts)))).otherwise(F.when(full.isNotNull(), at_h(full)).otherwise(0))
        return out.withColumn("seg", seg).withColumn("sub", sub).drop("cell", "above", "own")

    return add


def compare_edited(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of docs with its fingerprint, that of its edited text and their likeness.

    The edited text ends, in place of the last third (floor(n_chars / 3) code points), with as
    many first code points of the next row's text, or all of it. Null texts count as empty;
    an empty table gives no rows; repeated rows are rows like any other; null doc_ids come last;
    columns other than doc_id and text are ignored; very long texts are whole trees.
    """

    def with_tree(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("parts", paragraphs(F.col("text")))
        out = out.withColumn("s", tree(F.col("parts"))).withColumn("leaves", leaves(F.col("parts"))).drop("parts")
        return out.withColumn("fingerprint", fingerprint(F.col("s"))).drop("s")

    rows = with_next(docs, range_rows, with_tree).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "leaves", "next_leaves", root_of(F.col("next_fingerprint")).alias("next_root"), edited.alias("edited"))
    rows = rows.withColumn("parts", paragraphs(F.col("edited")))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_leaves", leaves(F.col("parts"))).withColumn("s", tree(F.col("parts"))).drop("parts", "edited")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("s"))).drop("s")
    own = root_of(F.col("fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(own, F.col("leaves"), root_of(F.col("edited_fingerprint")), F.col("edited_leaves")).alias("near_edited"),
        likeness(own, F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
        edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_paragraphs"),
    )
