"""Groups of spelling variants: words one edit apart, found through their halves.

Of two words one edit apart, one half of either stands unchanged at the start or the end of the other.
Aho-Corasick automata hold the halves of all words, in shards by the halves' outer letters, and scan all words: a word
goes to the shards of its own first and of its own last letters, as no others hold a half that could stand there. What
a half meets at the right place and with a fitting length is verified.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by which halves are dealt, words of a shard at most, about, and the least number of shards.
OUTER, CELL_WORDS, LEAST_CELLS = 3, 20_000, 24


def word_counts(docs: DataFrame, letters: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of all texts: runs of letters up to U+00FF, A-Z in lower case, of at least so many letters and occurrences.

    Where ``every`` divides the CRC-32 of "<doc_id>:<run>" (a null doc_id counts as empty), the run loses the code
    point at that CRC modulo its length. Null texts have no runs.
    """
    low = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]{%d,}" % letters), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.withColumn("h", h)
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= letters) & (F.col("n") >= least))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _cuts(rest: str) -> set[str]:
    """A text, and it without each of its letters: of two texts one edit apart, one of either's is the same."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class Halves:
    """An automaton over the first (0), the second (1) or both halves of some words. At a half the words that have it
    stand under the cuts of their other half."""

    def __init__(self, words: list[str], sides: tuple[int, ...] = (0, 1)) -> None:
        import ahocorasick

        self.words = words
        held: dict[str, tuple[dict, dict]] = {}
        for i, w in enumerate(words):
            cut = len(w) // 2
            for side in sides:
                half, rest = (w[cut:], w[:cut]) if side else (w[:cut], w[cut:])
                if half:
                    by_cut = held.setdefault(half, (defaultdict(list), defaultdict(list)))[side]
                    for c in _cuts(rest):
                        by_cut[c].append(i)
        self.automaton = ahocorasick.Automaton()
        for half, value in held.items():
            self.automaton.add_word(half, (len(half), *value))
        if held:
            self.automaton.make_automaton()

    def near(self, word: str) -> set[str]:
        """The words one edit from a word."""
        out: set[str] = set()
        if not len(self.automaton):
            return out
        n = len(word)
        for end, (size, first, second) in self.automaton.iter(word):
            # a first half must stand at the start, a second half at the end
            for by_cut, placed, rest in ((first, end + 1 == size, word[size:]), (second, end + 1 == n, word[: n - size])):
                if placed and by_cut:
                    met = {i for c in _cuts(rest) for i in by_cut.get(c, ())}
                    out.update(w for i in met if abs(len(w := self.words[i]) - n) <= 1 and one_edit(w, word))
        return out


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near), in both directions, of distinct words (a column ``word``) of two letters or more that are one edit apart.

    A shard holds the halves of many outer letters, or a part of those of letters that many words share; such
    words are scanned in blocks, each by every part. So no task holds more than about cell_words words of either
    kind, and a word goes to two shards but for those of frequent letters. A pair comes once.
    """
    held = materialize(words.select("word").where("word is not null").distinct(), "words")
    n, shortest = held.agg(F.count("*"), F.coalesce(F.min(F.length("word")), F.lit(2 * OUTER))).first()
    if shortest < 2:
        raise ValueError("a word of one letter has no halves")
    buckets, size = max(LEAST_CELLS, -(-2 * n // cell_words)), min(OUTER, shortest // 2)  # no half is shorter
    outer = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, size).alias("key")), F.struct(F.lit(1).alias("side"), F.substring("word", -size, size).alias("key")))
    dealt = held.select("word", F.explode(outer).alias("o")).select("word", "o.side", "o.key")
    many = materialize(dealt.groupBy("side", "key").agg(F.ceil(F.count("*") / cell_words).cast("int").alias("parts")).where("parts > 1"), "many")
    dealt = dealt.join(maybe_broadcast(many, many.count()), ["side", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    hot = F.col("parts") > 1
    dealt = dealt.withColumn("bucket", F.when(hot, -1).otherwise(F.pmod(F.xxhash64("side", "key"), F.lit(buckets)).cast("int"))).withColumn("key", F.when(hot, F.col("key")).otherwise(""))
    own, every = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cell = ("side", "bucket", "key", "part", "block")
    halves = dealt.select("side", "bucket", "key", own.alias("part"), every.alias("block"), "word")
    blocks = dealt.select(*[x.alias(f"own_{c}") for c, x in zip(cell, (F.col("side"), F.col("bucket"), F.col("key"), every, own), strict=True)], F.col("word").alias("own_word"))

    def scan(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(block):
            side = int(shard["side"].iloc[0])
            machine = Halves(shard["word"].tolist(), (side,))
            for w in block["own_word"].tolist():
                # what the first half meets, too, comes from its shard
                out += [(w, x) for x in machine.near(w) if not side or not w.startswith(x[: len(x) // 2])]
        return pd.DataFrame(out, columns=["word", "near"])

    other = [f"own_{c}" for c in cell]
    # words are short and their scan is long: tasks are not to be merged by their bytes
    halves, blocks = halves.repartition(buckets, *cell), blocks.repartition(buckets, *other)
    return halves.groupBy(*cell).cogroup(blocks.groupBy(*other)).applyInPandas(scan, "word string, near string")


def group_variants(docs: DataFrame, letters: int = 6, least: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """Every word of docs (see ``word_counts``) with its form and root: word, form, root, n, n_near, form_n.

    The form is the most frequent near word (ties: the first in code-point order) if it occurs at least ``times`` times
    as often, else null; the root ends the chain of forms. Counts rise along a chain, so it has no cycle and its
    length grows with their logarithm. Null and repeated doc_ids and repeated rows count like any other; an empty table gives no rows.
    """
    counts = materialize(word_counts(docs, letters, least, every), "counts")
    near = near_pairs(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    told = counts.join(best, "word", "left").withColumn("form", F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.w")))
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.m")).alias("form_n")), "forms")
    up = told.where("form is not null").select("word", F.col("form").alias("root"))
    moved = not up.isEmpty()
    while moved:  # each round doubles how far a word has followed its chain
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        up = step.select("word", "root")
    return told.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
