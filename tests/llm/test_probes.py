"""The probes of SimHash partitions with thresholds above zero."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from palisade.llm import simhash


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("plan", [[(list(range(0, 20)), 1), (list(range(20, 41)), 2), (list(range(41, 64)), 0)], [([0, 5, 63, 62, 31], 2)], [(list(range(64)), 1)], [([1, 2], 0), ([1, 2], 0)]])
def test_pairs_within_a_threshold_share_one_key_of_the_partition(spark, plan):
    r = random.Random(len(plan))
    fps = [r.getrandbits(64) for _ in range(6)]
    for fp in list(fps):
        for part, t in plan:
            for j in range(t + 2):
                flips = sum(1 << p for p in r.sample(part, min(j, len(part))))
                fps.append(fp ^ flips)
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "i int, fp long")
    keys = {x.i: list(x.keys) for x in df.select("i", simhash.probe_keys(F.col("fp"), plan).alias("keys")).collect()}
    one = {}
    for k, (part, t) in enumerate(plan):  # the keys of a partition alone, in the place that it has in the plan
        padded = [([], 0)] * k + [(part, t)]
        one[k] = {x.i: set(x.keys[k:]) for x in df.select("i", simhash.probe_keys(F.col("fp"), padded).alias("keys")).collect()}
    for a, b in combinations(range(len(fps)), 2):
        for k, (part, t) in enumerate(plan):
            apart = bin((fps[a] ^ fps[b]) & sum(1 << p for p in part)).count("1")
            if apart <= t:
                assert one[k][a] & one[k][b], (a, b, k, apart)
    assert all(len(v) >= len(plan) for v in keys.values())
    # the same value in two partitions is two keys
    if len(plan) == 2:
        assert all(len(set(v)) == 2 for v in keys.values())


def test_links_of_any_plan(spark, monkeypatch):
    """Components are those of all pairs whatever thresholds the plan has."""
    from test_llm import components_of, docs_of

    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    texts = []
    for t in base:
        words = t.split()
        for _ in range(5):
            own = list(words)
            for at in r.sample(range(len(own)), r.randrange(0, 4)):
                own[at] = f"x{r.randrange(9999)}"
            texts.append(" ".join(own))
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for forced in ([(list(range(0, 32)), 2), (list(range(32, 64)), 1)], [(list(range(0, 21)), 1), (list(range(21, 42)), 1), (list(range(42, 64)), 0)]):
        monkeypatch.setattr(simhash, "choose_partitions", lambda *a, forced=forced, **k: forced)
        got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.link_fingerprints(docs).collect()}
        want = components_of(list(got), lambda a, b: bin(got[a][0] ^ got[b][0]).count("1") <= 4)
        assert {k: v[1] for k, v in got.items()} == want
        assert len(set(want.values())) < len(texts)
