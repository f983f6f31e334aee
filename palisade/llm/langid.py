"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import materialize, small_batches

#: Longest n-gram; expected training documents of a language; how often a word or n-gram occurs in them to be known.
LONGEST, FIT_DOCS, LEAST = 4, 3000, 2
#: Unknown words whose vector a task keeps.
SEEN = 20_000
UNKNOWN = "und"


@functools.cache
def word_pattern(last: int = sys.maxunicode) -> re.Pattern[str]:
    """Runs of letters and marks up to a code point, which training takes as words, too (``\\p{L}\\p{M}``)."""
    ranges, start = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] in "LM"
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile(f"[{''.join(ranges)}]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text. A pattern of the basic plane is much the faster, where it is enough."""
    low = text.lower()
    return word_pattern(0x7F if low.isascii() else 0xFFFF if max(low) <= "\uffff" else sys.maxunicode).findall(low)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class _Rows:
    """Rows of a table by name; a dict of rows would hold an array's head of over a hundred bytes for each."""

    def __init__(self, names: list[str], table: np.ndarray) -> None:
        self.at, self.table = {x: i for i, x in enumerate(names)}, table

    def get(self, name: str) -> np.ndarray | None:
        i = self.at.get(name)
        return None if i is None else self.table[i]


@dataclass
class Model:
    """Per-language log probabilities of words and, by length, of n-grams."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def vector(self, word: str) -> np.ndarray:
        v = self.words.get(word)
        return v if v is not None else self.backoff(word)

    def backoff(self, word: str) -> np.ndarray:
        """Mean of the known n-grams of the greatest length that has any."""
        if (v := self.seen.get(word)) is not None:
            return v
        marked, v = f"^{word}$", np.zeros(len(self.langs))
        for n in range(LONGEST, 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]
            if known:
                v = np.mean(known, axis=0)
                break
        if len(self.seen) < SEEN:
            self.seen[word] = v
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(words_of(text)) if text else Counter()
        if not self.langs or not found or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        vectors = np.array([self.vector(w) for w in found])
        total = np.array(list(found.values()), float) @ vectors + self.prior
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, least: int = LEAST) -> Model:
    """A model of docs' text by lang, of rows with both.

    It is fitted on a sample by hash of about fit_docs documents of each language, taken whole; words and
    n-grams that occur ``least`` times in a language's are known, the others count as unseen.
    The model's size thus depends on the number of languages and not on the table's.
    """
    have = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = have.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return Model([], np.zeros(0), {}, {})
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, fit_docs / r["count"])) for r in counts], "lang string, share double")
    near = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    words = have.join(F.broadcast(share), "lang").where(near).select("lang", F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{M}]+")).alias("word")).where("word <> ''")
    words = materialize(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def cut(n: int) -> Column:
        # a word that is shorter than n is its own longest n-gram
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("marked") - n + 1)), lambda i: F.substring(F.col("marked"), i, F.lit(n)))

    grams = words.select("lang", "n", marked.alias("marked")).select("lang", "n", F.explode(F.concat(*[cut(n) for n in range(1, LONGEST + 1)])).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams.withColumn("len", F.length("gram")), "grams")

    langs = [r["lang"] for r in counts]
    at = {lang: i for i, lang in enumerate(langs)}
    prior = np.log(np.array([r["count"] for r in counts]) / sum(r["count"] for r in counts))

    def table(rows: list, what: str, totals: dict[str, int]) -> dict[str, np.ndarray]:
        all_ = np.array([totals.get(lang, 0) for lang in langs], float)
        floor = np.log(0.5 / (all_ + 1))
        out: dict[str, np.ndarray] = {}
        for r in rows:
            i = at[r["lang"]]
            v = out.get(r[what])
            if v is None:
                v = out[r[what]] = floor.copy()
            v[i] = np.log((r["n"] + 0.5) / (all_[i] + 1))
        return out

    known = table(words.where(F.col("n") >= least).collect(), "word", {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()})
    totals = {(r[0], r[1]): r[2] for r in grams.groupBy("lang", "len").agg(F.sum("n")).collect()}
    sized = grams.where(F.col("n") >= least).collect()
    parts: dict[str, np.ndarray] = {}
    for n in range(1, LONGEST + 1):
        parts |= table([r for r in sized if r["len"] == n], "gram", {lang: totals.get((lang, n), 0) for lang in langs})
    return Model(langs, prior, known, parts)


def predictor(docs: DataFrame, model: Model) -> Callable[[str], Column]:
    """A function of a text column that gives (lang_pred, score) by the model."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.prior, list(model.words), np.array(list(model.words.values()), np.float32), list(model.grams), np.array(list(model.grams.values()), np.float32)))
    made: list[Model] = []
    kind = StructType().add("lang_pred", StringType()).add("score", DoubleType())

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.DataFrame:
        if not made:
            langs, prior, w, wv, g, gv = shared.value
            made.append(Model(langs, prior, _Rows(w, wv), _Rows(g, gv)))
        return pd.DataFrame([made[0].predict(t) for t in texts], columns=["lang_pred", "score"])

    return of


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the prediction's posterior probability.

    Only the text is read. Null texts and texts without a letter are ``und`` with score 0, as
    are all texts if the model has no language; ties go to the first language by name.
    """
    return docs.withColumn("__p", predictor(docs, model)("text")).select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "__p.lang_pred", "__p.score")


def predict_languages(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, held_out, lang_pred, score).

    The model learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2; rows
    with a null doc_id are neither learnt from nor held out. Repeated rows are predicted alike.
    """
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs' rows of which the language can be told: others are ``und`` or scored below least. Null
    and empty texts are ``und`` and go; repeated rows go or stay together; without a row that has
    text and lang no language is known and none stays; an empty table stays empty; docs' columns are kept."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))
    judged = docs.withColumn("__p", predictor(docs, model)("text"))
    return judged.where((F.col("__p.lang_pred") != UNKNOWN) & (F.col("__p.score") >= least)).select(*docs.columns)
