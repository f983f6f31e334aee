"""The interval join and the matching built on it, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import versions
from palisade.operators import rangejoin, vuln

EVENTS = "array<array<struct<introduced:string,fixed:string,last_affected:string>>>"
#: For each ecosystem what versions are made of, malformed ones among them.
ENDS = {
    "npm": ["", "-alpha", "-alpha.1", "-beta.2", "-0", "+b", "-rc.1+x", ".4", "-" + "9" * 40], "pypi": ["", ".dev1", "a1", "rc2", ".post1", ".post1.dev2", "+l.1", "a1.dev3", "-x"], "golang": ["", "-0.2020", "-rc1", "+incompatible", "x"],
    "maven": ["", "-alpha", "-sp", ".0", "-SNAPSHOT", "-foo", ".final", "-1", "..", ".0-sp", "-rc.0.0"], "nuget": ["", "-a", "-B.1", ".0", ".7", "-"], "rubygems": ["", ".a", ".pre.1", ".0", ".0.0.b", "-1", "..1"],
    "composer": ["", "-dev", "-RC1", "-p1", "-stable", ".0.0", "-foo", "-stable.0.7", "$"], "debian": ["", "~rc1", "^git1", "a", "-1", "~", "+b1~", "-1ubuntu0.1", " x"], "crates.io": ["", "-0", "-alpha", ".beta", "..", "-\x00a", "." + "8" * 39],
}


def version(r, eco, most=3):
    lead = {"golang": r.choice(["v", ""]), "debian": r.choice(["", "", "1:", "0:"]), "pypi": r.choice(["", "", "1!"])}.get(eco, "")
    return lead + ".".join(str(r.randrange(most)) for _ in range(r.choice([3, 3, 3, 2, 4] if eco not in ("npm", "golang") else [3]))) + r.choice(ENDS[eco])


@pytest.mark.parametrize("eco", list(ENDS))
def test_sortable_texts_keep_the_order(spark, eco):
    r = random.Random(eco)
    some = sorted({version(r, eco) for _ in range(170)})
    only = versions.orders_of({eco})
    d = spark.createDataFrame([(v,) for v in some], "v string").select("v", versions.key(F.lit(eco), F.col("v"), only).alias("key"))
    d = d.select("*", versions.sortable(F.lit(eco), F.col("key"), only).alias("at"))
    x, y = d.toDF("v", "key", "at"), d.toDF("w", "other", "to")
    told = x.join(y).select("v", "w", versions.compare_keys(F.lit(eco), F.col("key"), F.col("other"), only).alias("c"), F.when(F.col("at") < F.col("to"), -1).when(F.col("at") > F.col("to"), 1).otherwise(0).alias("s"), F.col("at").isNull().alias("none"), F.col("key").isNull().alias("bad"))
    rows = told.collect()
    assert all(t.none == t.bad for t in rows) and (eco == "crates.io" or any(t.bad for t in rows)) and any(not t.bad for t in rows)
    rows = [t for t in rows if t.c is not None]
    coarse = eco == "maven"
    assert not [t for t in rows if t.s != t.c and not (coarse and t.s == 0)]
    assert coarse or {t.c for t in rows} == {-1, 0, 1}


def test_points_in_intervals(spark):
    r = random.Random(2)
    points = [(r.choice("ab"), f"{r.randrange(400):03}", i) for i in range(500)] + [("a", None, 1000), (None, "005", 1001)]
    spans = []
    for i in range(120):
        a, b = sorted((r.randrange(400), r.randrange(400) if i % 3 else r.randrange(10)))
        spans.append((r.choice("abc"), f"{a:03}", f"{b:03}", i))
    spans += [("a", "", "\U0010ffff", 900), ("a", "200", "100", 901), ("b", None, "300", 902), ("a", "007", "007", 903), spans[0]]
    got = rangejoin.holding(spark.createDataFrame(points, "g string, at string, p int"), spark.createDataFrame(spans, "g string, low string, high string, s int"), ["g"], "at", "low", "high")
    want = sorted((g, at, p, s) for g, at, p in points for h, lo, hi, s in spans if g and g == h and at is not None and None not in (lo, hi) and lo <= at <= hi)
    assert sorted(tuple(x) for x in got.select("g", "at", "p", "s").collect()) == want and len(want) > 1000
    none = spark.createDataFrame([], "g string, low string, high string, s int")
    assert rangejoin.holding(spark.createDataFrame(points, "g string, at string, p int"), none, ["g"], "at", "low", "high").count() == 0


def all_pairs(components, packages):
    """Every component of a name against every advisory of it."""
    eco, name = versions.ecosystem(F.col("ecosystem")), F.lower(F.trim("name"))
    c = components.where(F.coalesce("version", F.lit("")) != "").select(eco.alias("ecosystem"), name.alias("name"), "version", "purl").withColumn("key", versions.key(F.col("ecosystem"), F.col("version")))
    p = packages.where("withdrawn is null").select("advisory_id", eco.alias("ecosystem"), F.lower("name").alias("name"), "versions", "ranges")
    p = p.withColumn("steps", F.transform("ranges", lambda e: versions.steps(F.col("ecosystem"), e)))
    j = c.join(p, ["ecosystem", "name"]).withColumn("told", F.transform("steps", lambda e: versions.affected(F.col("ecosystem"), F.col("key"), e)))
    exact = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))
    hit, bad = (F.coalesce(F.array_contains(f"told.{k}", True), F.lit(False)) for k in ("hit", "bad"))
    return j.where(exact | hit & ~bad).select("purl", "advisory_id", F.when(exact, "exact-version").otherwise("ecosystem-range").alias("method"), bad.alias("bad_version"))


def test_match_equals_all_pairs(spark):
    r = random.Random(9)
    components, packages = [], []
    for eco in ENDS:
        for i in range(90):
            components.append((r.choice([eco, eco.upper()]), r.choice(["One", " two", "three"]), version(r, eco) if i % 30 else r.choice([None, "", "?!"]), f"pkg:{eco}/{i}", "lock"))
        for i in range(40):
            ranges = []
            for _ in range(r.choice([1, 1, 2, 3])):
                events = []
                for _ in range(r.randrange(1, 5)):
                    kind = r.randrange(4)
                    v = version(r, eco)
                    events.append((r.choice(["0", v, v]) if kind < 2 else None, v if kind == 2 else None, v if kind == 3 else None))
                ranges.append(r.choice([events, [("0", None, None)], [(version(r, eco), version(r, eco), None)], [], events]))
            listed = [components[r.randrange(len(components))][2] for _ in range(r.randrange(4))]
            packages.append((f"{eco}-{i}", eco, r.choice(["one", "TWO", "three", "four"]), ["CVE-1"], "2024" if i % 19 == 5 else None, "osv", r.choice([listed, listed + listed, None]), ranges if i % 17 else None))
    c = spark.createDataFrame(components + components[:5], "ecosystem string, name string, version string, purl string, manifest_path string")
    p = spark.createDataFrame(packages + packages[:3], f"advisory_id string, ecosystem string, name string, aliases array<string>, withdrawn string, source string, versions array<string>, ranges {EVENTS}")
    got = sorted(tuple(x) for x in vuln.match(c, p).select("component_purl", "advisory_id", "method", "bad_version").collect())
    want = sorted(tuple(x) for x in all_pairs(c, p).collect())
    assert got == want and len({g[1] for g in got}) > 100 and {g[2] for g in got} == {"exact-version", "ecosystem-range"}
    assert vuln.match(c.limit(0), p).count() == vuln.match(c, p.limit(0)).count() == 0


def test_pairs_read_are_near_those_found(spark):
    """A hot name: 3,000 versions and 1,500 advisories, each of a few versions."""
    c = spark.range(3000).select(F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.concat_ws(".", F.expr("id div 100"), F.expr("id % 100 div 10"), F.expr("id % 10")).alias("version"))
    c = c.withColumn("key", versions.key(F.col("ecosystem"), F.col("version")))
    at = lambda k: F.concat_ws(".", F.expr(f"({k}) div 100"), F.expr(f"({k}) % 100 div 10"), F.expr(f"({k}) % 10"))
    none = F.lit(None).cast("string")
    event = lambda a, b: F.struct(a.alias("introduced"), b.alias("fixed"), none.alias("last_affected"))
    p = spark.range(1500).select(F.col("id").alias("package"), F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.array().cast("array<string>").alias("versions"), F.array(F.array(event(at("id * 2"), none), event(none, at("id * 2 + 5")))).alias("ranges"))
    only = versions.orders_of({"npm"})
    p = p.withColumn("steps", F.transform("ranges", lambda r: versions.steps(F.lit("npm"), r, only))).drop("ranges")
    p = p.withColumn("spans", vuln.spans_of(F.col("steps"), only))
    read = vuln.pairs(c.withColumn("at", versions.sortable(F.lit("npm"), F.col("key"), only)), p).count()
    found = sum(min(2 * k + 5, 3000) - 2 * k for k in range(1500))
    assert found <= read <= 1.3 * found  # of 4.5 million pairs of the name
