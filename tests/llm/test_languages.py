"""Language ID: accuracy on held-out rows of the tables, and the model against a plain version of it."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from palisade.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = got.where(F.col("held_out") & F.col("lang").isNotNull() & (F.length("text") > 20)).collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.select("doc_id", "held_out").collect())


class Plain:
    """Known words by their log frequency, else the mean of the longest known n-grams, with Python's own counts."""

    def __init__(self, rows):
        rows = [(t, la) for t, la in rows if t is not None and la is not None]
        n = Counter(la for _, la in rows)
        self.langs = sorted(n)
        self.prior = [math.log(n[x] / len(rows)) for x in self.langs]
        words = defaultdict(Counter)
        for t, la in rows:
            words[la].update(w for w in regex.split(r"[^\p{L}\p{M}]+", t.lower()) if w)
        self.words = self._table(words, lambda w: 0)
        grams = defaultdict(Counter)
        for la, c in words.items():
            for w, k in c.items():
                m = f"^{w}$"
                for size in range(1, 5):
                    for i in range(max(1, len(m) - size + 1)):
                        g = m[i : i + size]  # a word of one letter is its own longest n-gram
                        grams[la][(len(g), g)] += k
        self.grams = self._table(grams, lambda g: g[0])

    def _table(self, counts, kind):
        totals = {la: Counter() for la in self.langs}
        for la, c in counts.items():
            for x, k in c.items():
                totals[la][kind(x)] += k
        known = {x for c in counts.values() for x, k in c.items() if k >= 2}
        out = {}
        for x in known:
            out[x] = [math.log((counts[la][x] + 0.5) / (totals[la][kind(x)] + 1)) if counts[la][x] >= 2 else math.log(0.5 / (totals[la][kind(x)] + 1)) for la in self.langs]
        return out

    def predict(self, text):
        found = Counter(regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()))
        if not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        total = list(self.prior)
        for w, k in found.items():
            v = self.words.get(w)
            for size in range(4, 0, -1):
                if v is None:
                    m = f"^{w}$"
                    own = [g for i in range(len(m) - size + 1) if (g := self.grams.get((size, m[i : i + size])))]
                    v = [sum(c) / len(own) for c in zip(*own, strict=True)] if own else None
            total = [t + k * x for t, x in zip(total, v or [0.0] * len(total), strict=True)]
        best = max(total)
        return self.langs[total.index(best)], 1 / sum(math.exp(t - best) for t in total)


def test_predictions_equal_the_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(90_001, "zzyzx qwrtp", None), (90_002, "12 34", "en"), (90_003, None, "en"), (90_004, "ação über naïve ĳssel", None)], "doc_id long, text string, lang string")
    all_ = docs.select("doc_id", "text", "lang").unionByName(more)
    rows = all_.collect()
    plain = Plain([(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    text = {r.doc_id: r.text for r in rows}
    got = langid.predict_languages(all_).collect()
    assert len(got) == len(rows)
    for g in got:
        lang, score = plain.predict(text[g.doc_id])
        assert g.lang_pred == lang and g.score == pytest.approx(score, abs=2e-3), (g.doc_id, g.lang_pred, lang, g.score, score)
