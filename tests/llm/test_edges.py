"""Operators against brute force in the cases that are easy to lose: ties, hot keys, very long texts and odd forms."""

import itertools
import math
import random
import time

import pytest
import xxhash

from palisade.llm import chatformat, decontaminate, langid, licenses, merkle, mixing, pii, sharding, urlfilter
from pyspark.sql import functions as F

from test_llm import docs_of, signed, words


def leaves_of(text):
    import regex

    out = set()
    for p in (text or "").split("\n"):
        out |= {xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFFFFFF for x in regex.split(r"(?<=[hnt\p{P}\p{S}])[ \t]+", p) if x}
    return out


def test_merkle_by_brute_force(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["the", "went", "run", "so,", "a", "blue.", "in", "tree", "wish"]) + str(r.randrange(50)) * (r.random() < 0.3) for _ in range(n))
    # null ids and one repeated id fill several ranges
    rows = [(None if i < 40 else 7 if i < 90 else i, "\n".join(prose(r.randrange(1, 30)) for _ in range(r.randrange(1, 6))), "en", "s") for i in range(160)] + [(500, None, "en", "s"), (501, "", "en", "s")]
    got = merkle.compare_edited(docs_of(spark, rows), 10).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest((x[1] or "").encode(), 42)), x[1] or ""))
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]

        def like(x, y=t):
            a, b = leaves_of(x), leaves_of(y)
            return 1.0 if x == y else min(2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0, 1 - 1e-9)

        lost = [p for p, line in enumerate(t.split("\n")) if line not in edited.split("\n") and line not in t.split("\n")[:p]]
        want.append((i, len(t), round(like(edited), 9), round(like(nxt), 9), lost if t != edited else []))
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.n_chars, round(x.near_edited, 9), round(x.near_next, 9), x.edited_paragraphs)) for x in got)


def test_edits_of_forty_thousand_lines(spark):
    a = "\n".join(f"line {i}" for i in range(40_000))
    b = "\n".join(f"line {i}" if i % 1000 else f"new {i}" for i in range(40_000))
    fp = merkle.fingerprint(merkle.tree(merkle.paragraphs(F.col("t"))))
    both = spark.createDataFrame([(a, b)], "a string, b string").select(*[fp_of(c) for c in "ab"])
    began = time.time()
    assert both.select(merkle.edits(F.col("a"), F.col("b")).alias("e")).first().e == list(range(0, 40_000, 1000))
    assert time.time() - began < 60 and fp is not None


def fp_of(c):
    return merkle.fingerprint(merkle.tree(merkle.paragraphs(F.col(c)))).alias(c)


def test_every_window_at_the_threshold(spark):
    """Items with changed words: exact similarities by brute force, ties at 0.8 included."""
    r = random.Random(11)
    items = [(k, words(40, 100 + k, 10**6)) for k in range(30)]
    n_items, df = len(items), {}
    for _, w in items:
        for s in {tuple(w[i : i + 5]) for i in range(36)}:
            df[s] = df.get(s, 0) + 1
    scaled = lambda x: round(math.log(1 + x) * decontaminate.SCALE)
    docs, want = [], set()
    for d in range(300):
        k, w = items[d % 30]
        new = list(w)
        for at in r.sample(range(40), r.randrange(0, 3)) if d % 3 else [d % 40]:
            new[at] = f"x{d}y{at}"
        docs.append((d, " ".join(words(50, 5000 + d, 10**6) + new + words(30, 9000 + d, 10**6)), "en", "s"))
        own, mine = {tuple(new[i : i + 5]) for i in range(36)}, {tuple(w[i : i + 5]) for i in range(36)}
        both = sum(scaled(n_items / df[s]) for s in own & mine)
        total = sum(scaled(n_items / df[s]) for s in mine) + len(own - mine) * scaled(n_items)
        if 10 * both >= 8 * total:
            want.add((d, k))
    assert 100 < len(want) < 300
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, docs), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and max(x.distance for x in got) < decontaminate.RADIUS


def test_ties_of_similarity(spark):
    """Ten of the items' shingles, each of equal weight, and a window that shares just eight of ten."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(13))) for k in range(6)]
    w = items[0][1].split()
    # nine shingles; one word less at the end leaves eight of nine and a foreign one: 8 / 10
    docs = docs_of(spark, [(1, " ".join(["a", "b", *w[:12], "zzz", "c"]), "en", "s")])
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(1, 0)] and got[0].similarity == pytest.approx(0.8, abs=0.001)


def test_mix_comes_near_its_targets(spark):
    r = random.Random(3)
    data = [(i, " ".join(["w"] * min(4000, int(r.paretovariate(0.9) * 20))), "en", f"s{int(r.paretovariate(0.8)) % 9}") for i in range(3000)]
    got = mixing.mixture(docs_of(spark, data), seed=5).collect()
    source = {i: s for i, _, _, s in data}
    taken, target = {}, {}
    for x in got:
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
        target[source[x.doc_id]] = x.target
    assert len(target) == 9 and all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in target)
    # documents of one size: the share that is taken once more is the fraction
    data = [(i, "one two three", "en", "ab"[i % 4 == 0]) for i in range(4000)]
    for x in mixing.mixture(docs_of(spark, data)).withColumn("rate", F.col("target") / F.col("source_size")).groupBy("target").agg(F.avg("copies").alias("a"), F.first("rate").alias("r")).collect():
        assert x.a == pytest.approx(x.r, abs=0.002)


def test_languages_of_marks_and_long_words(spark):
    hindi, greek = "किताब पढ़ना अच्छा लगता है", "αυτό είναι ένα βιβλίο"
    rows = [(i, f"{hindi} " * 3, "hi", "s") for i in range(20)] + [(100 + i, f"{greek} " * 3, "el", "s") for i in range(20)]
    rows += [(200, "है" * 5000, None, "s"), (201, hindi, None, "s"), (202, greek * 2000, None, "s"), (203, hindi, None, "s"), (203, hindi, None, "s")]
    got = langid.predict_languages(docs_of(spark, rows)).collect()
    by = {x.doc_id: x.lang_pred for x in got}
    assert [by[i] for i in (200, 201, 202, 203)] == ["hi", "hi", "el", "hi"] and len(got) == len(rows)
    assert langid.word_pattern().findall("पढ़ना, don't 12 naïve") == ["पढ़ना", "don", "t", "naïve"]
    for text in ("Plain 1 two_three", "पढ़ना naïve² Ⅷx", "gothic 𐌰𐌱 x\U0001f600y", ""):
        assert langid.words_of(text) == langid.word_pattern().findall(text.lower())


def test_every_form_of_link(spark):
    block = "http://blocked.org/es/1"
    forms = {
        "//blocked.org/es/1": "https://a.info/p/q", "../../es/1": "http://blocked.org/x/y/z", "/es/./1": "http://blocked.org/x", "1": "http://blocked.org/es/zz",
        "http://blocked.org/es/1?utm_source=a&amp;ref=b": "http://b.info/", "http:&#x2F;&#47;blocked.org/es/1": "http://c.info/", f"{block}#frag": "http://d.info/",
    }
    pages = [(0, block, "")]
    for k, (href, url) in enumerate(forms.items(), 1):
        pages.append((k, f"{url}{'' if url.endswith(('y/z', '/zz')) else f'n{k}'}", f'<html><link data-x="{"y>" * 3000}" href="{href}" rel="alternate canonical"></html>'))
    pages += [
        (50, "http://e.info/1", f"<!-- <link rel=canonical href={block}> -->"), (51, "http://e.info/2", f"<script>'<link rel=canonical href={block}>'</script >"),
        (52, "http://e.info/3", f"<link rel=canonical2 href={block}>"), (53, "http://e.info/4", "<link rel=canonical href='mailto:x@blocked.org'>"),
        (60, "http://f.info/1", f"<META HTTP-EQUIV=Refresh CONTENT='5 ; URL={block}'>"), (61, "http://f.info/2", f"<meta content=\"{block}\" property='og:url'>"), (62, "http://f.info/3", f"<link href={block} rel=canonical " + "x" * 100_000 + ">"),
        (63, "http://f.info/4", f"<p>{'x' * 300_000}</p><link rel='canonical' href='{block}'>"),
    ]
    got = {x.page_id: x.verdict for x in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, *range(1, len(forms) + 1), 60, 61, 62, 63}
    assert got == {k: v for k, *_, v in sql_rows(urlfilter.duckdb_sql(), pages)}


def sql_rows(sql, pages):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    return con.execute(sql).fetchall()


def test_components_of_urls_by_brute_force(spark):
    r = random.Random(2)
    names = [f"http://h{k}.{'org/es/' if k % 17 == 0 else 'example.com/en/7' if k % 23 == 0 else 'info/'}{k}" for k in range(120)]
    pages, up = [], list(range(120))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, n in enumerate(names):
        to = r.randrange(120)
        pages.append((k, n, f'<link rel="canonical" href="{names[to]}">' if r.random() < 0.6 else None))
        if pages[-1][2]:
            up[find(k)] = find(to)
    own = lambda k: "block" if k % 17 == 0 else "allow" if k % 23 == 0 else None
    want = {}
    for k in range(120):
        said = {own(j) for j in range(120) if find(j) == find(k)}
        want[k] = own(k) or ("allow" if "allow" in said else "block" if "block" in said else "allow")
    got = {x.page_id: x.verdict for x in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def test_best_path_by_all_paths():
    r = random.Random(1)
    import numpy as np

    model = chatformat.Model(np.array([1.0, 5, 1]), np.array([[1.0, 4, 1], [1, 1, 9], [1, 9, 1]]), [np.ones((3, 2)), np.ones((3, 2)), np.ones((3, 6))])
    tables = [model.turn, model.stay, model.free]
    for _ in range(40):
        n = r.randrange(1, 7)
        e = [tuple(r.uniform(-4, 0) for _ in range(3)) for _ in range(n)]
        m = [r.choice(tables) for _ in range(n)]
        score = lambda p, before=None: (model.start[p[0]] if before is None else m[0][before][p[0]]) + sum(x[s] for x, s in zip(e, p, strict=True)) + sum(t[a][b] for t, a, b in zip(m[1:], p, p[1:], strict=False))
        paths = list(itertools.product(range(3), repeat=n))
        assert score(chatformat.viterbi(model, e, m)) == pytest.approx(max(map(score, paths)))
        assert chatformat.viterbi(model, e, m, 2, 1) == list(max((p for p in paths if p[-1] == 1), key=lambda p: score(p, 2)))
        ways = chatformat.through(model, e, m, False)
        assert all(ways[b][s] == pytest.approx(max(score(p, b) for p in paths if p[-1] == s)) for b in range(3) for s in range(3))
    tied = chatformat.viterbi(model, [(0.0, 0.0, 0.0)], [model.free], 0)
    assert tied == [0]


def test_a_conversation_of_equal_turns(spark):
    turns = [(1, None, "user", f"what is it {i:04d}?") for i in range(600)] + [(2, 0, "user", "x " * 100_000)] + [(None, 3, None, f"Assistant: {i}") for i in range(300)]
    got = chatformat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 901 and {x.role for x in got if x.conv_id == 1} == {"user"} and {x.role for x in got if x.conv_id is None} == {"assistant"}


def test_slots_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MICRO_BYTES", 300)
    data = [(i, f"text {i % 900} " * 5, "en", "s") for i in range(1500)] + [(None, None, "en", "s")] * 3
    got = sharding.assign(docs_of(spark, data)).collect()
    slots = {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
    assert len(got) == 1503 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = {}
    for x in got:
        of.setdefault(x.text_crc32, set()).add(x.shard)
    assert all(len(s) == 1 for s in of.values())


def test_pseudonyms_of_long_and_old_values(spark):
    c = pii.Cipher(b"k")
    hexes, mail = "0123456789abcdef" * 8, "a1b2" * 40 + "@example.com"
    text, kinds, n = pii.rewrite(f"born 1815-12-10, died 2150-01-02; key {hexes} mail {mail} and again {mail}", c)
    assert kinds == ["date", "email", "secret"] and n == 5 and hexes not in text and mail not in text and text.split()[-1] == text.split()[-4]
    assert sorted(c.permute(x, 3001, "all") for x in range(3001)) == list(range(3001))
    docs = docs_of(spark, [(1, "4111111111111111 " + "x" * 500_000, "en", "s"), (2, "4111111111111111", "en", "s"), (2, "4111111111111111", "en", "s")])
    got = pii.pseudonymise(docs, b"k").collect()
    assert len({x.text[:16] for x in got}) == 1 and len(got) == 3 and got[0].text[:16] != "4111111111111111"
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(docs, b"")
    assert pii.session_key(spark) == pii.session_key(spark)


def test_license_sql_agrees(spark, tmp_path):
    import duckdb

    r = random.Random(6)
    said = [t for _, t in licenses.TEMPLATES]
    texts = ["", None, "cc by cc by general public license", "Á bé \U0001f600 c", "all rights reserved " * 3]
    texts += [" ".join(words(20, k)) + " " + r.choice(said).replace(" ", r.choice([" ", "\n", ", "])) + " " + r.choice(said)[: r.randrange(10, 60)] for k in range(60)] + ["word " * 20_000 + said[0]] * 2
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(licenses.duckdb_sql()).fetchall()
    got = [tuple(x) for x in licenses.scan(docs).collect()]
    assert sorted(want, key=repr) == sorted(got, key=repr)
