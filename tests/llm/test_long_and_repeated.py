"""Texts of hundreds of thousands of words or values, and rows that are repeated hundreds of times."""

import random
import re
import time

import pytest

from palisade.llm import licenses, mixing, pii

from test_llm import docs_of


@pytest.mark.parametrize("said", ["licensed under the apache license version 2.0", "nothing of the kind but version license under", ""])
def test_a_license_text_of_two_hundred_thousand_words(spark, said):
    filler = " ".join(f"w{i}" for i in range(12))
    text = " ".join([said, filler] * (200_000 // (len(said.split()) + 12)))
    began = time.time()
    got = licenses.scan(docs_of(spark, [(1, text, "en", "s")])).first()
    assert time.time() - began < 60
    assert got.labels == ("apache-2.0" if said.startswith("licensed") else "") and got.n_words > 190_000


def windows_by_force(text):
    own = text.split()
    out = {}
    for (label, tokens), (_, said) in zip(licenses.token_sets(licenses.TEMPLATES), licenses.TEMPLATES, strict=True):
        span = licenses.SPAN * len(said.replace(".", " ").split())
        best = max((len(set(own[s : s + span]) & set(tokens)) for s in range(len(own))), default=0)
        if best >= licenses.CONTAINMENT * len(tokens) - 1e-9:
            out[label] = max(out.get(label, 0), best / len(tokens))
    return out


def test_windows_among_many_template_words(spark):
    """Texts of nothing but template words, in which every window meets prefix words of several templates."""
    r = random.Random(12)
    vocabulary = sorted({w for _, t in licenses.token_sets(licenses.TEMPLATES) for w in t})
    texts = []
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 250))]
        for _ in range(2):
            _, tokens = licenses.token_sets(licenses.TEMPLATES)[r.randrange(len(licenses.TEMPLATES))]
            own = sorted(tokens)
            r.shuffle(own)
            at = r.randrange(len(words))
            words[at:at] = own[: len(own) - r.randrange(0, 2)]
        texts.append(" ".join(words))
    base = {b for _, b in licenses.BASE}
    for x in licenses.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        want = windows_by_force(texts[x.doc_id])
        assert set(x.labels.split(",")) - {"", *base} == set(want) - base
        if not x.base_labels:
            assert x.score == pytest.approx(max(want.values(), default=0.0))


def test_two_hundred_thousand_values():
    r = random.Random(1)
    parts = []
    for i in range(50_000):
        parts += [f"mail u{i}@example.org", f"from 10.{i % 256}.{i // 256 % 256}.{r.randrange(256)}", f"on 20{i % 90 + 10}-0{i % 9 + 1}-1{i % 9}", f"and 123-45-{i % 9000 + 1000}"]
    text = "; ".join(parts)
    began = time.time()
    out, kinds, n = pii.rewrite(text, pii.Cipher(b"key"))
    assert time.time() - began < 60 and n == 200_000 and {"email", "ip", "date", "ssn"} <= set(kinds)
    assert not re.search(r"u77@example\.org", out)


def test_the_key_s_name_is_one_that_spark_hides(spark):
    pattern = spark.conf.get("spark.redaction.regex", "(?i)secret|password|token|access[.]?key")
    assert re.search(pattern, pii.KEY)


def test_values_of_several_kinds_that_overlap():
    """Spans of earlier kinds against all of them, by force."""
    r = random.Random(3)
    c = pii.Cipher(b"key")
    some = ["4111 1111 1111 1111", "2020-01-01", "10.0.0.1", "a@b.example.com", "+49 30 123456", "DE89 3704 0044 0532 0130 00", "123-45-6789", "12", "x", "0" * 32, "deadbeef" * 4]
    for _ in range(300):
        text = r.choice(["", " "]).join(r.choice(some) + r.choice(["", " ", "-", ".", ","]) for _ in range(r.randrange(1, 12)))
        taken, found = [], []
        for kind in pii.KINDS:
            pattern, change = pii.KINDS[kind]
            form, at, got = re.compile(pattern), 0, []
            while m := form.search(text, at):
                breaks = [b.start() for b in re.finditer("[ .-]", m[0])] if kind in pii.GROUPED else []
                at = m.start() + breaks[0] if breaks and breaks[0] else m.end()
                for n in [len(m[0]), *reversed(breaks)]:
                    if any(m.start() < e and s < m.start() + n for s, e in taken) or (n < len(m[0]) and not form.fullmatch(m[0][:n])):
                        continue
                    if (new := change(m[0][:n], c)) is not None:
                        got.append((m.start(), m.start() + n, new))
                        at = m.start() + n
                        break
            found += got
            taken += [(s, e) for s, e, _ in got]
        want, at = "", 0
        for s, e, new in sorted(found):
            want += text[at:s] + new
            at = e
        assert pii.rewrite(text, c)[0] == want + text[at:]


@pytest.mark.parametrize("others", [0, 200])
def test_repeated_rows_are_drawn_one_by_one(spark, others):
    """400 equal rows of ten words beside another source: about the target's words are taken, not all or none."""
    rows = [(7, "ten words of a text that is there again and again", "en", "a")] * 400 + [(100 + i, "some few words of another kind here and there too", "en", "a") for i in range(others)] + [(1000 + i, " ".join(["w"] * 10), "en", "b") for i in range(500)]
    for seed in range(3):
        got = mixing.mixture(docs_of(spark, rows), seed=seed).collect()
        assert len(got) == len(rows)
        for source in ("a", "b"):
            own = [g for g in got if (g.doc_id >= 1000) == (source == "b")]
            assert abs(sum(g.taken for g in own) - own[0].target) <= 0.02 * own[0].target + 22
        assert all(g.taken <= 3 * g.size for g in got)
        again = mixing.mixture(docs_of(spark, rows), seed=seed).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mix(docs_of(spark, rows), seed=0)
    assert mixed.columns == docs_of(spark, rows).columns
    want = {}
    for g in mixing.mixture(docs_of(spark, rows), seed=0).collect():
        want[g.doc_id] = want.get(g.doc_id, 0) + g.copies
    have = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in want.items() if v}
    assert 0 < have[7] < 1200


def test_rules_hold_for_urls_that_are_only_named(spark):
    """A blocked or allowed url decides for its aliases whether it is a row or not."""
    from palisade.llm import urlfilter

    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://one.io/x", link("http://a.org/es/x?it")), (2, "http://two.io/x", link("http://one.io/x")), (3, "http://three.io/x", link("http://example.com/en/7")), (4, "http://four.io/x", link("http://three.io/x") + link("http://b.net/de/1")),
        (5, "http://five.io/x", "<textarea>" + link("http://a.org/es/x") + "</textarea><title>" + link("http://a.org/es/x") + "</title>"), (6, "http://six.io/x", '<meta http-equiv="refresh" content="0; http://a.org/es/y">'),
        (7, "http://seven.io/x", '<meta http-equiv="refresh" content="5">'), (8, "http://eight.io/x", None), (9, None, link("http://a.org/es/x")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow")}
    redirects = spark.createDataFrame([("http://eight.io/x", "https://x.org/es/1"), ("http://seven.io/x", "http://y.io/"), ("http://y.io", "http://z.net/de/")], "source string, target string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, redirects=redirects).collect()}
    assert got[8] == got[7] == "block" and got[5] == "allow"
