"""The pipeline against a brute-force version of its stages, and the entry points."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from palisade.llm import neardup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + r.choice(["the", "ing", "er", "on"]) + str(r.randrange(900)).translate(str.maketrans("0123456789", "klmnopqrst")) for _ in range(n)]


def jaccard5(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, " ".join(words(80, i)), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(120)]
    base = words(200, 777)
    for k in range(6):
        w = list(base)
        w[30 * k] = "other"
        rows.append((200 + k, " ".join(w), "en", "s1"))
    rows += [(300 + k, rows[5][1], "en", "s2") for k in range(3)]
    item = " ".join(words(40, 555))
    rows += [(400, " ".join(words(20, 9)) + " " + item, "en", "s0"), (401, "77 88 !!", "en", "s3"), (402, None, "en", "s3"), (403, "", None, None), rows[7]]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, item


def test_pipeline_by_brute_force(spark, folder):
    at, rows, item = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, at), name)
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(r.doc_id for r in seen["language_id"].collect()) == Counter(r[0] for r in lettered)
    texts = {r[0]: r[1] for r in lettered}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if jaccard5(texts[a], texts[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    kept = {find(i) for i in texts}
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == sorted(kept)
    clean = {i for i in kept if item.lower() not in texts[i].lower()}
    assert {r.doc_id for r in seen["benchmark_decontamination"].collect()} == clean and 400 not in clean
    size = {i: len(texts[i].split()) for i in clean}
    source = {r[0]: r[3] for r in rows}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(total))}
    share = sum(total.values()) / sum(weight[s] for s in total)
    assert all(share * weight[s] < 3 * total[s] for s in total)
    took = Counter(r.doc_id for r in seen["source_mixing"].collect())
    assert set(took) <= clean and max(took.values()) <= 3
    for s in total:
        assert abs(sum(size[i] * n for i, n in took.items() if source[i] == s) - share * weight[s]) <= max(size.values())
    last = seen["sharding"].collect()
    assert Counter(r.doc_id for r in last) == took
    slots = defaultdict(list)
    for r in last:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_run_and_queries(spark, folder):
    import __spark_entry__

    at, _, _ = folder
    q = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in q} and "pipeline" in q
    assert set(__spark_entry__.oracle_sql()) <= set(q)
    assert q["pipeline"](spark, at).count() > 0


def test_words_shorter_than_a_shingle():
    assert neardup.jaccard(neardup.shingle_set("a b", 5), neardup.shingle_set("A  b", 5)) == 1.0
