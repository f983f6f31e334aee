"""Every operator against brute force or an exact property, with nulls, empty and long texts,
ties, repeated rows, empty tables and columns of clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palisade.llm import chatformat, decontaminate, langid, licenses, merkle, mixing, neardup, pii, sharding, simhash, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, copies string, fp string, row_key string, rate string, h string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, la, s in rows], SCHEMA)


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(words(60 + i % 40, i)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    base = words(200, 99)
    for k in range(12):  # near copies: one word in two hundred differs
        x = list(base)
        x[(k * 7) % 200] = f"new{k}"
        out.append((100 + k, " ".join(x), "en", "s0"))
    out += [(200 + k, out[3][1], "fr", "s1") for k in range(5)]
    out += [(300, None, "en", None), (301, "", None, "s2"), (302, "   \n\t", "en", "s2"), (None, "no id here at all", "en", "s0"), (303, " ".join(words(30_000, 5)), "en", "s1"), (304, "12 34 !!", "en", "s2")]
    out += [out[5], out[5], (7, "same id and another text of words", "en", "s0")]
    return out


def components_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in ids}


def test_simhash_links_by_brute_force(spark, rows):
    got = simhash.link_fingerprints(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = defaultdict(set)
    for i, t, *_ in rows:
        ws = (t or "").encode().lower().split()
        sh = [b" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
        n = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
        fp[sum(1 << b for b in range(64) if 2 * n[b] > len(sh))].add(i)
    root = components_of(fp, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for f, ids in fp.items():
        known = [i for i in ids if i is not None]
        least[root[f]] = min([*known, *([least[root[f]]] if least.get(root[f]) is not None else [])], default=None)
    for r in got:
        f = int(r.fingerprint, 16)
        assert r.doc_id in fp[f] and r.component_id == least[root[f]]


def test_partitions_cover_the_radius():
    r = random.Random(1)
    for n, radius in ((500, 4), (10**7, 4), (10**5, 2), (10**4, 7)):
        sample = np.array([r.getrandbits(63) for _ in range(300)], np.int64)
        plan = simhash.choose_partitions(sample, n, radius)
        for _ in range(500):
            flips = r.sample(range(64), radius)
            assert any(sum(b in part for b in flips) <= t for part, t in plan)


def test_hot_buckets_keep_all_links(spark):
    r = random.Random(3)
    fps = sorted({sum(1 << b for b in r.sample(range(24), 3)) for _ in range(1500)})
    nodes = spark.createDataFrame([(f, [f], 1) for f in fps], "id long, fps array<long>, size int")
    links = simhash.hamming_links(nodes, 2).collect()
    assert len(links) < 40 * len(fps)
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in links:
        assert (x.a ^ x.b).bit_count() <= 24
        up[max(find(x.a), find(x.b))] = min(find(x.a), find(x.b))
    want = {f: f for f in fps}
    seen, todo = set(), [fps[0]]
    everyone = set(fps)
    while todo:
        f = todo.pop()
        if f in seen:
            continue
        seen.add(f)
        todo += [g for a, b in combinations(range(24), 2) if (g := f ^ 1 << a ^ 1 << b) in everyone] + [g for a in range(24) if (g := f ^ 1 << a) in everyone]
    assert len({find(f) for f in seen}) == 1 and want


def test_near_duplicates_by_brute_force(spark, rows):
    got = {(r.doc_id, r.group_id) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i if i is not None else (1 << 63) - 1, []).append(t)
    keys = [(i, k) for i, ts in texts.items() for k in range(len(set(ts)))]
    bag = {(i, k): neardup.shingle_set(sorted(set(texts[i]), key=str)[k], 5) for i, k in keys}
    root = components_of(keys, lambda a, b: neardup.jaccard(bag[a], bag[b]) >= 0.8)
    assert got == {(None if i == (1 << 63) - 1 else i, root[i, k][0]) for i, k in keys}
    kept = neardup.deduplicate(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows[:1]).columns and kept.count() == len(set(root.values()))


def test_decontamination(spark, rows):
    items = [(1, " ".join(words(30, 1000))), (2, " ".join(words(45, 1001))), (3, "tiny item here"), (4, None), (5, ""), (6, " ".join(words(30, 1000)))]
    clean = list(rows)
    leaks = [(900, "pre fix " + items[0][1].upper().replace(" ", "### ") + " tail"), (901, " ".join(words(50, 7)) + " " + items[1][1]), (902, "a tiny item here b")]
    w = items[1][1].split()
    w[20] = "changed"
    leaks.append((903, "x y " + " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, clean + [(i, t, "en", "s") for i, t in leaks]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(900, 1), (900, 6), (901, 2), (902, 3)}
    assert {r.doc_id for r in got} <= {900, 901, 902, 903}
    assert all(r.first_word == 2 for r in got if r.doc_id == 900)
    left = decontaminate.decontaminate(docs_of(spark, clean), bench)
    assert left.count() == len(clean)
    assert decontaminate.contaminated(docs_of(spark, clean), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_merkle(spark, rows):
    for size in (2000, 7):
        got = merkle.compare_edited(docs_of(spark, rows), size).collect()
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), r[1] or ""))
        want = Counter()
        for k, (i, t, *_) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            n = len(t) // 3
            want[i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint, r.n_chars)
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) or r.near_edited > 0.99
    assert merkle.compare_edited(docs_of(spark, [])).count() == 0
    one = docs_of(spark, [(1, "a\nb\n\nc", "en", "s")])
    fp = merkle.fingerprint(merkle.tree(merkle.paragraphs(F.col("text"))))
    a, b = one.select(fp.alias("f")).first().f, one.withColumn("text", F.lit("a\nX\n\nc")).select(fp.alias("f")).first().f
    assert spark.createDataFrame([(a, b)], "a string, b string").select(merkle.edits(F.col("a"), F.col("b")).alias("e")).first().e == [1]


def test_mixing(spark, rows):
    got = mixing.mixture(docs_of(spark, rows)).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").encode().split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, full = {}, {}
    total = sum(size.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        target = full | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * size[s] for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert len(got) == len(rows) and {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mixture(docs_of(spark, rows)).collect()}
    source = dict((i, s) for i, _, _, s in rows)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        assert r.doc_id == 7 or r.target == pytest.approx(target[source[r.doc_id]])
    assert mixing.mix(docs_of(spark, rows)).count() == sum(r.copies for r in got)
    assert mixing.mixture(docs_of(spark, [])).count() == 0


def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "ALL rights\nreserved, all rights reserved", "cc by cc by", "x\nReleased under the MIT License.\ny", "nothing", "", None, "gnu general public licenses", "GNU General Public License, version 3."]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i].n_base for i in range(9)] == [1, 2, 2, 0, 0, 0, 0, 0, 1]
    assert [(got[i].first_word, got[i].last_word) for i in (0, 1, 2, 4)] == [(2, 2), (0, 3), (0, 2), (None, None)]
    assert got[0].base_labels == "cc-by" and got[0].labels == "cc-by,cc-by-nc-4.0" and got[3].labels == "mit" and got[8].labels == "gpl,gpl-3.0"
    assert [got[i].n_words for i in range(7)] == [7, 6, 4, 7, 1, 0, 0] and got[7].labels == ""
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_license_join_is_exact(spark):
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.replace(".", " ").split()] + [f"z{i}" for i in range(20)]
    r = random.Random(4)
    texts = []
    for _ in range(150):
        t = set(licenses.token_sets(licenses.TEMPLATES)[r.randrange(len(licenses.TEMPLATES))][1])
        keep = [w for w in sorted(t) if r.random() < 0.93] + r.sample(vocabulary, 3)
        r.shuffle(keep)
        texts.append(" ".join(keep))
    got = {x.doc_id: set(x.labels.split(",")) - {""} for x in licenses.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        own, want = t.split(), set()
        for (label, tokens), (_, said) in zip(licenses.token_sets(licenses.TEMPLATES), licenses.TEMPLATES, strict=True):
            span = licenses.SPAN * len(said.replace(".", " ").split())
            if any(len(set(own[s : s + span]) & set(tokens)) >= licenses.CONTAINMENT * len(tokens) - 1e-9 for s in range(len(own))):
                want.add(label)
        lowered = [w.lower() for w in own]
        for phrase, label in licenses.BASE:
            said = phrase.split()
            if any(lowered[s : s + len(said)] == said for s in range(len(lowered))):
                want.add(label)
        assert got[i] == want


def test_pseudonyms(spark):
    card = "4111111111111111"
    texts = [f"card {card} ip 10.0.0.1 on 2024-02-29", f"again {card}.", "not 4111111111111112 nor 999.1.1.1 nor 2024-02-30", "mail joe.42@mail.example.com now", "+1 (743) 555-3824", None, "", "078-05-1120", "GB82 WEST 1234 5698 7654 32"]
    got = {r.doc_id: r for r in pii.pseudonymise(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), b"k").collect()}
    new = got[0].text.split()[1]
    assert new != card and len(new) == 16 and pii.luhn_digit(new[:-1]) == new[-1] and new in got[1].text
    assert got[2].text == texts[2] and got[2].n_found == 0 and got[5].text is None and got[6].text == ""
    assert "joe.42" not in got[3].text and got[3].text.endswith("now") and got[4].text != texts[4] and got[4].text.startswith("+1 (")
    assert [got[i].kinds for i in (0, 7, 8)] == [["card", "date", "ip"], ["ssn"], ["iban"]]
    c = pii.Cipher(b"k")
    for bound in (2, 10, 1000, 1237):
        assert sorted(c.permute(x, bound, "t") for x in range(bound)) == list(range(bound))


def test_languages(spark):
    en, fr = words(300, 1, 60), [f"é{w}" for w in words(300, 2, 60)]
    r = random.Random(0)
    data = [(i, " ".join(r.sample(en if i % 2 else fr, 30)), "en" if i % 2 else "fr", "s") for i in range(200)]
    en_l = [(i, t.replace("w", "the").translate(str.maketrans("0123456789", "abcdefghij")), la, s) for i, t, la, s in data]
    odd = [(500, None, "en", "s"), (501, "12 34 !!", "en", "s"), (502, "", None, "s"), (None, "thea theb", "en", "s"), (503, "unseen ñandú", None, "s")]
    got = langid.predict_languages(docs_of(spark, en_l + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 205 and all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert all(by[i].lang_pred == en_l[i][2] for i in range(200)) and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[503].lang_pred in ("en", "fr")
    kept = langid.keep_identified(docs_of(spark, en_l + odd))
    assert {r.doc_id for r in kept.select("doc_id").collect()} & {500, 501, 502} == set()
    assert langid.predict_languages(docs_of(spark, [])).count() == 0
    assert langid.predict_languages(docs_of(spark, [(1, "abc", None, "s")])).first().lang_pred == "und"


def test_urls(spark):
    pages = [
        (1, "http://A.example.com/en/1", ""), (2, "http://a.example.com/en/7x?q", None), (3, "https://x.org/q/1", '<link rel="canonical" href="http://b.org/es/5">'),
        (4, "http://b.org/es/5#top", ""), (5, None, ""), (6, "nourl", ""), (7, "http://y.info", '<meta http-equiv="refresh" content="0; url=https://x.org/q/1/?utm_source=f">'),
        (8, "http://example.net/de/8", ""), (9, "http://notcom/en/", ""), (10, "http://com/en/", ""), (11, "https://z.biz/a", '<link href="http://a.example.com/en/7x?q" rel=canonical>'), (4, "http://b.org/es/5#top", ""),
    ]
    df = spark.createDataFrame([(i, u, h, "c", "d") for i, u, h in pages], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: (None, "block"), 4: ("org/es/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"),
        8: ("example.net/de/8", "block"), 9: (None, "allow"), 10: ("com/en/", "block"), 11: (None, "allow"),
    }
    assert (got[1].host, got[1].path, got[6].host, got[7].path) == ("a.example.com", "/en/1", "", "")
    assert urlfilter.judge(df).count() == 12 and urlfilter.judge(df.limit(0)).count() == 0
    both = spark.createDataFrame([("http://y.info", "http://a.example.com/en/7x?q")], "source string, target string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, redirects=both).collect()}[3] == "allow"


def test_shards(spark, rows):
    data = rows + [(2000 + i, "hot text " * 40, "en", "s0") for i in range(400)] + [(3000 + i, f"text {i} " * 30, "en", "s1") for i in range(1500)]
    got = sharding.assign(docs_of(spark, data)).collect()
    assert len(got) == len(data)
    by, at = defaultdict(int), defaultdict(list)
    for r in got:
        by[r.shard] += r.size
        at[r.shard].append(r.slot)
    fair = sum(by.values()) / 8
    longest = max(len((t or "").encode()) + 1 for _, t, *_ in data)
    assert set(by) <= set(range(8)) and all(abs(v - fair) <= 0.05 * fair + longest for v in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in at.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    carried = sharding.assign(docs_of(spark, data), carry=True)
    assert carried.count() == len(data) and dict(carried.dtypes)["shard"] == "int"
    assert sharding.assign(docs_of(spark, [])).count() == 0


def test_chats(spark):
    turns = [(1, 0, "user", "Hi?\nthere"), (1, 1, "assistant", "Hello."), (1, 2, None, "User: what\nAssistant: that\nand more"), (2, 0, None, None), (None, None, "user", ""), (1, 1, "assistant", "Hello.")]
    turns += [(9, i, "user" if i % 2 == 0 else "assistant", f"line {i}{'?' if i % 2 == 0 else '.'}") for i in range(700)]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, part string, chunk string")
    got = chatformat.format_chats(df).collect()
    one = sorted((r.turn, r.part, r.role, r.text) for r in got if r.conv_id == 1)
    assert one == [(0, 0, "user", "Hi?\nthere"), (1, 0, "assistant", "Hello."), (2, 0, "user", "what"), (2, 1, "assistant", "that\nand more")]
    assert [r.copies for r in got if r.conv_id == 1 and r.turn == 1] == [2]
    long_ = sorted((r.turn, r.role) for r in got if r.conv_id == 9)
    assert long_ == [(i, "user" if i % 2 == 0 else "assistant") for i in range(700)]
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}<|end|>\n" for r in got)
    assert chatformat.format_chats(df.limit(0)).count() == 0
