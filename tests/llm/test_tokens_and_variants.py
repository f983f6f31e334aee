"""Token alignment, token files and spelling variants against brute force."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import alignment, rangecoder, tokenfiles, tokens, variants

from test_llm import docs_of

ODD = [
    "a▁b and more words", "nul \x00 inside a text", "<|endoftext|> said <s> here </s> <unk> <0x41>", "tabs\tand\r\nlines\n\n  two  spaces   three ", " leading", "trailing ", " ", "\n", "café über straße naïve", "日本語 の テキスト",
    "\U0001f600 smile \U0001f468‍\U0001f469‍\U0001f467 family", "x" * 3000, "it's they'll I'd we've 'tis", "12345 67,890.12 3rd", " non breaking 　 wide", "﻿mark", "é combining ä", "\x1c\x1d a \x1e b \x85 c",
]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["stone", "river", "Bank,", "l'eau", "été", "grüße", "tokenization", "x1", "(see", "below)", "--", "naïve", "don't", "U.S.", "—", "3.14"]
    out = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    out += [(100 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60))) + r.choice(["", "\n", "  "]), "en", "s") for i in range(60)]
    out += [(200, None, "en", "s"), (201, "", None, None), (None, "no id", "en", "s"), (150, "same id, other text", "en", "s"), (300, "long " * 20_000, "en", "s")]
    return [*out, out[30], out[30]]


def test_alignment_by_brute_force(spark, rows):
    a, b = tokens.byte_tokenizer(alignment.BYTES, True), tokens.piece_tokenizer(alignment.PIECES)
    back = {ch: by for by, ch in zip([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)], map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]), strict=True)}
    others = [x for x in range(256) if x not in back.values()]
    back |= {chr(256 + i): x for i, x in enumerate(others)}
    found = []
    for i, t, *_ in rows:
        x, y, said = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t), f" {t}".encode()) if t else ([], [], b"")
        bx = [bytes(back[c] for c in a.id_to_token(k)) for k in x]
        by = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(k)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for k in y]
        if not t or b"".join(bx) != said or b"".join(by) != said:
            found.append((i, [], [], [], []))
            continue
        ex, ey = np.cumsum([len(z) for z in bx]).tolist(), np.cumsum([len(z) for z in by]).tolist()
        shared = sorted(set(ex) & set(ey))
        groups, p, q = [], 0, 0
        for e in shared:
            g = (x[p : bisect.bisect_right(ex, e)], y[q : bisect.bisect_right(ey, e)])
            p, q = p + len(g[0]), q + len(g[1])
            groups.append(g)
        links = [(x[ex.index(e)], y[ey.index(e)]) for e in shared] if len(shared) < 5000 else [(g[0][-1], g[1][-1]) for g in groups]
        found.append((i, x, y, groups, links))
    counts = Counter(k for f in found for k in f[4])
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    want = []
    for i, x, y, groups, links in found:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if x else ""
        want.append((i, len(x), len(y), len(groups), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links), digest))
    got = [tuple(g) for g in alignment.alignment_digests(docs_of(spark, rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {w[0] for w in want if not w[1]} == {0, 200, 201}  # U+2581 in a text, null, empty


def test_counts_that_are_not_broadcast(spark, rows, monkeypatch):
    want = sorted(map(repr, alignment.alignment_digests(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(alignment, "maybe_broadcast", lambda df, rows: df)
    assert sorted(map(repr, alignment.alignment_digests(docs_of(spark, rows)).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), min_size=1, max_size=30))
def test_intervals_groups_and_products(x, y):
    short, long = sorted((sum(x), sum(y)))
    (x if sum(x) == short else y).append(long - short) if long > short else None
    ex, ey = np.cumsum(x), np.cumsum(y)
    sx, sy = ex - x, ey - y
    al = alignment.align(ex, ey)
    overlaps = {(i, j) for i in range(len(x)) for j in range(len(y)) if sx[i] < ey[j] and sy[j] < ex[i]}
    assert sorted(zip(*(k.tolist() for k in al.links("overlaps")), strict=True)) == sorted(overlaps)
    shared = sorted(set(ex.tolist()) & set(ey.tolist()))
    group = lambda e: bisect.bisect_left(shared, e)
    assert sorted(zip(*(k.tolist() for k in al.links("groups")), strict=True)) == sorted((i, j) for i in range(len(x)) for j in range(len(y)) if group(ex[i]) == group(ey[j]))
    assert sorted(zip(*(k.tolist() for k in al.links("ends")), strict=True)) == sorted((i, j) for i in range(len(x)) for j in range(len(y)) if ex[i] == ey[j])
    with pytest.raises(ValueError):
        al.links("none")


def test_spans_spell_the_text(spark, rows):
    a, b = tokens.byte_tokenizer(alignment.BYTES, True), tokens.piece_tokenizer(alignment.PIECES)
    va, vb = tokens.byte_values(a), tokens.piece_values(b)
    texts = Counter((i, t) for i, t, *_ in rows)
    for r in alignment.aligned_spans(docs_of(spark, rows)).collect():
        said = b"".join(va[k] for k in r.a_ids)
        at = 0
        for g in r.groups:
            one = b"".join(va[k] for k in r.a_ids[g.a_from : g.a_to])
            assert one == b"".join(vb[k] for k in r.b_ids[g.b_from : g.b_to]) and one
            at += len(one)
            assert at == g.byte_end
        if r.a_ids:
            assert texts[(r.doc_id, said.decode()[1:])] and at == len(said)


def test_pieces_give_the_text_s_ids(rows):
    """Cut before single spaces, a text's pieces have the ids of the text, under both kinds of vocabulary."""
    t, p = tokens.byte_tokenizer("byte_bpe_50k.json", True), tokens.piece_tokenizer(alignment.PIECES)
    r = random.Random(1)
    chars = "ab \n\t.,'é▁<0x>|　\U0001f6000"
    texts = [x[1] for x in rows if x[1]] + ["".join(r.choice(chars) for _ in range(40)) for _ in range(3000)]
    for x in texts:
        cut = tokens.CUT.split(x)
        assert t.encode(f" {x}", add_special_tokens=False).ids == [k for c in cut for k in t.encode(f" {c}", add_special_tokens=False).ids]
        assert p.encode(x) == [k for c in cut for k in p.encode(c)]
    e = tokenfiles._Encoder("byte_bpe_50k.json")
    with_special = tokens.byte_tokenizer("byte_bpe_50k.json", False)
    for x, got in zip(texts, e.texts(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == with_special.encode(x, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**28 - 1) | st.integers(0, 20), max_size=60), max_size=30), st.sampled_from([None, 1, 7, 64]))
def test_range_coder_round_trip(docs, block):
    ids, lengths = np.array([k for d in docs for k in d], np.uint32), np.array([len(d) for d in docs], np.int64)
    held = rangecoder.Segment(rangecoder.pack(ids, lengths, block))
    assert held.ids().tolist() == ids.tolist() and held.lengths.tolist() == lengths.tolist()


def test_range_coder_blocks_stand_alone_and_are_checked():
    r = np.random.default_rng(2)
    ids = np.concatenate([r.zipf(1.3, 30_000) % 50_000, np.tile(r.integers(0, 50_000, 300), 40), np.full(9000, 7)]).astype(np.uint32)
    data = rangecoder.pack(ids, np.array([len(ids)]), 1000)
    held = rangecoder.Segment(data)
    for i in (0, 17, held.n_blocks - 1):
        assert held.blocks(i, 1).tolist() == ids[i * 1000 : (i + 1) * 1000].tolist()
    assert len(rangecoder.pack(ids[30_000:42_000], np.array([12_000]), 12_000)) < 4000  # a repeated passage of 300 ids is predicted
    end = len(data) - int(held.sizes.sum()) * 2
    for at in (4, 20, end - 6, end + 40, len(data) - 30):
        broken = bytearray(data)
        broken[at] ^= 0x41
        with pytest.raises(rangecoder.DamagedBlock):
            rangecoder.Segment(bytes(broken)).ids()
    hurt = bytearray(data)
    hurt[end + 2 * int(held.starts[5]) + 9] ^= 1
    ok = rangecoder.Segment(bytes(hurt))
    assert ok.blocks(4, 1).tolist() == ids[4000:5000].tolist() and ok.blocks(6, 1).tolist() == ids[6000:7000].tolist()
    with pytest.raises(rangecoder.DamagedBlock):
        ok.blocks(5, 1)


def test_token_files_by_brute_force(spark, rows, tmp_path):
    t = tokens.byte_tokenizer("byte_bpe_50k.json", False)
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    encoded = [(x[0], [*t.encode(x[1] or "", add_special_tokens=False).ids, 0]) for x in order]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = tokenfiles.written_digests(docs_of(spark, rows)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((repr(g.doc_id), g.n_tokens, g.ids_crc32) for g in got) == sorted((repr(i), len(ids), crc(ids)) for i, ids in encoded)
    # starts: gapless in ascending order of doc_id, equal ones in any order
    got.sort(key=lambda g: g.start)
    assert [g.doc_id for g in got] == [i for i, _ in encoded]
    assert [g.start for g in got] == np.cumsum([0, *[g.n_tokens for g in got][:-1]]).tolist()
    path = f"file://{tmp_path}/ids"
    tokenfiles.write_ids(docs_of(spark, rows), path, segment_ids=3000)
    read = tokenfiles.read_ids(spark, path).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in read) == sorted((repr(i), ids) for i, ids in encoded)
    assert len({(r.part, r.segment) for r in read}) > 1
    assert tokenfiles.written_digests(docs_of(spark, [])).count() == 0


def near_by_force(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_one_edit(a, b):
    assert variants.one_edit(a, b) == near_by_force(a, b)
    assert (b in variants.Halves([a, "zz"] if a else ["zz"]).near(b)) is False
    if min(len(a), len(b)) >= 2:
        assert (a in variants.Halves([a]).near(b)) == near_by_force(a, b)


def variants_by_force(rows):
    import re

    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out, form = [], {}
    for w, k in n.items():
        near = [x for x in n if near_by_force(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * k else None
        out.append([w, form[w], n[w], len(near), n[form[w]] if form[w] else None])
    for o in out:
        root = o[0]
        while form[root]:
            root = form[root]
        o.insert(2, root)
    return out


def test_variants_by_brute_force(spark):
    r = random.Random(5)
    stems = ["running", "walking", "étésdor", "NATION", "nations", "national", "painted", "planets", "planeta", "aabbaabb", "straßen"]
    edit = lambda w: (lambda i: r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcéZ") + w[i:], w[:i] + r.choice("xyz") + w[i + 1 :]]))(r.randrange(len(w)))
    first = [edit(w) for w in stems for _ in range(4)]
    second = [edit(w) for w in first for _ in range(2)]
    vocabulary = stems * 80 + first * 12 + second * 2
    rows = [(i if i % 9 else None, " ".join(r.choice(vocabulary) for _ in range(120)) + r.choice(["", "\n", "×", "123"]), "en", "s") for i in range(260)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "abcdefgh" * 30_000, "en", "s"), rows[4], rows[4]]
    got = [list(g) for g in variants.group_variants(docs_of(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants_by_force(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(g[1] and g[2] != g[1] for g in want) and len(want) > 100
    assert variants.group_variants(docs_of(spark, [])).count() == 0


def test_variants_of_many_cells(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(6, 9))) for _ in range(900)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for a in words for b in words if near_by_force(a, b))
    for cell in (60, 100_000):  # with 60, the 27 beginnings are frequent ones in part
        assert sorted(tuple(p) for p in variants.near_pairs(df.union(df), cell_words=cell).collect()) == want
    short = [w[:n] for w in words[:60] for n in (2, 3, 4)]
    few = spark.createDataFrame([(w,) for w in short] + [(None,)], "word string")
    assert sorted(tuple(p) for p in variants.near_pairs(few).collect()) == sorted((a, b) for a in set(short) for b in set(short) if near_by_force(a, b))
    with pytest.raises(ValueError):
        variants.near_pairs(spark.createDataFrame([("a",)], "word string"))


def test_words_of_the_tables(spark):
    """Counts over a whole table, against Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    got = sorted(repr(list(g)) for g in variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == sorted(repr(o) for o in variants_by_force(rows))
    assert docs.where(F.col("text").isNotNull()).count() <= len(rows)
