"""Components against advisories: an interval join over sortable versions, then the ranges themselves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import versions
from palisade.functions.paths import normal
from palisade.functions.tables import built, materialize, maybe_broadcast
from palisade.operators import rangejoin

#: First parts of the digests of advisories, components, occurrences and matches.
SPACES = {k: f"palisade-{k}-v1" for k in ("source-record", "advisory", "component", "dependency-occurrence", "vulnerability-occurrence")}
EVENTS = "array<array<struct<introduced:string,fixed:string,last_affected:string>>>"
#: Packages alike that one row of a judged version meets.
PACK = 1000
SEVERITIES = ("critical", "high", "medium", "low", "unknown")


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def digest(*parts: Column | str) -> Column:
    """sha256: of the parts, a zero character between them."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u0000", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256))


def canonical_purl(purl: Column) -> Column:
    """A package URL with its type and the rest of its name in lower case and its qualifiers sorted."""
    head = F.regexp_extract(purl, "^([^@?#]*)", 1)
    version = F.regexp_extract(purl, "^[^@?#]*(@[^?#]*)", 1)
    query = F.regexp_extract(purl, r"^[^?#]*\?([^#]*)", 1)
    sub = F.regexp_extract(purl, "(#.*)$", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^[^=]*=?$"))), "&")
    return F.concat(F.lower(head), version, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""), sub)


def spans_of(steps: Column, only: frozenset[str]) -> Column:
    """The intervals, none of which overlaps another, outside which no version is in any range (their steps)."""
    return versions.merged(F.flatten(F.transform(F.filter(steps, lambda r: r.isNotNull()), lambda r: versions.intervals(F.col("ecosystem"), r, only))))


def pairs(components: DataFrame, packages: DataFrame) -> DataFrame:
    """(ecosystem, name, version, key, package) of distinct versions and packages that may match: by the list of
    versions, by an interval of the ranges that holds the version, or by ranges that hold every version.

    components: ecosystem, name, version, key, at (the key's sortable text); packages: package (an id), ecosystem, name, versions,
    spans (``spans_of`` their steps). No other pair of a name is looked at. A pair comes once from the list and once from the ranges at most.
    """
    own = ["ecosystem", "name"]
    spans = packages.select("package", *own, F.explode("spans").alias("x")).select("package", *own, "x.low", "x.high")
    whole = (F.col("low") == versions.LOWEST) & (F.col("high") == versions.HIGHEST)
    points = components.select(*own, "version", "key", "at")
    listed = packages.select("package", *own, F.explode(F.array_distinct("versions")).alias("version"))
    places = points.select(*own, "at").where("at is not null").distinct()
    held = rangejoin.holding(places, spans.where(~whole), own, "at", "low", "high")
    # repeated values make large tables small files, which Spark would broadcast
    out = points.drop("at").join(listed.hint("merge"), [*own, "version"]).withColumn("listed", F.lit(True))
    out = out.unionByName(points.join(held.hint("merge"), [*own, "at"]).drop("at").withColumn("listed", F.lit(False)))
    return out.unionByName(points.drop("at").join(spans.where(whole).drop("low", "high").hint("merge"), own).withColumn("listed", F.lit(False)))


@dataclass(frozen=True)
class Findings:
    """Findings that are not written out: each is a component and a hit of one ``__key``, and their number is that of such
    pairs, which may be the square of what the two tables hold. What only asks for one side, or for numbers, is worked out on the tables.

    components: __key (ecosystem, name, version), manifest_path, component_purl, __c and __d (digests of the component and of where it
    occurs) and the columns kept; hits: __key, advisory_id, aliases, what else is said of a version and an advisory, __a (the advisory's digest).
    """

    components: DataFrame
    hits: DataFrame

    def joined(self, components: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
        """Pairs of one key, dealt by it to many tasks, however small the tables are."""
        c, h = self.components if components is None else components, self.hits if hits is None else hits
        parts = _parts(c.sparkSession)
        return c.repartition(parts, "__key").join(h.repartition(parts, "__key").hint("merge"), "__key")

    def rows(self) -> DataFrame:
        """Every finding, with its fingerprint."""
        fp = digest(SPACES["vulnerability-occurrence"], F.col("__a"), F.col("__c"), F.col("__d"))
        own = ("ecosystem", "name", "version")
        shown = ("advisory_id", "aliases", *own, "method", "fixed_versions", "explanation", "source", "bad_version", "severity")
        kept = [x for x in self.components.columns if x not in ("__key", "manifest_path", "component_purl", "__c", "__d")]
        more = [x for x in self.hits.columns if x not in ("__key", "__a", *shown)]
        last = [x for x in ("bad_version", "severity") if x in self.hits.columns]
        return self.joined().select(
            fp.alias("fingerprint"), "advisory_id", "aliases", "component_purl", *own, "manifest_path",
            F.lit("affected").alias("status"), "method", F.lit("high").alias("confidence"), "fixed_versions", "explanation", "source", *last, *kept, *more,
        )

    def kept(self) -> Findings:
        """The same with its hits written, for what reads them more than once."""
        return Findings(self.components, materialize(self.hits, "hits"))

    def counts(self, hits: list[str], components: list[str] | None = None) -> DataFrame:
        """(the columns named, n): as rows grouped by these columns and counted.

        Each side is grouped first and a pair of groups stands for all its findings. With components' columns a group may
        come of several keys; where its hits are of one package name and its components of that name have one version, it cannot,
        and such groups, which may be nearly as many as the findings, are not dealt a second time.
        """
        h = self.hits.groupBy("__key", *hits).agg(F.count("*").alias("__h"))
        if not components:
            n = self.components.groupBy("__key").agg(F.count("*").alias("__n"))
            return h.join(n.hint("merge"), "__key").groupBy(*hits).agg(F.sum(F.col("__h") * F.col("__n")).alias("n"))
        h = materialize(h, "hit_groups")
        c = materialize(self.components.groupBy("__key", *components).agg(F.count("*").alias("__n")), "component_groups")
        zone = F.struct("__key.ecosystem", "__key.name").alias("__zone")
        wide_h = materialize(h.select(*hits, zone).distinct().groupBy(*hits).count().where("count > 1").drop("count"), "wide_hits")
        wide_c = materialize(c.select(*components, zone, "__key").distinct().groupBy(*components, "__zone").count().where("count > 1").drop("count"), "wide_components")

        def parted(df: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
            df = df.withColumn("__zone", zone)
            if wide.isEmpty():
                return df.drop("__zone"), df.limit(0).drop("__zone")
            on = reduce(and_, [df[x].eqNullSafe(wide[x]) for x in wide.columns])
            return df.join(wide, on, "left_anti").drop("__zone"), df.join(wide, on, "left_semi").drop("__zone")

        (h_one, h_wide), (c_one, c_wide) = parted(h, wide_h), parted(c, wide_c)
        pairs = lambda c, h: self.joined(c, h).select(*hits, *components, (F.col("__h") * F.col("__n")).alias("n"))
        out = pairs(c_one, h_one)
        more = [pairs(*x) for x, some in (((c, h_wide), wide_h), ((c_wide, h_one), wide_c)) if not some.isEmpty()]
        return out.unionByName(reduce(DataFrame.unionByName, more).groupBy(*hits, *components).agg(F.sum("n").alias("n"))) if more else out

    def delta_counts(self, base: Findings, more: DataFrame) -> DataFrame:
        """One row (new, existing, matched, resolved): findings by whether a baseline has their fingerprint, and the baseline's distinct
        fingerprints by whether a finding has them. The baseline is what base's findings have and the fingerprints of more.

        A fingerprint is that of an advisory and a place where a component occurs, so those of base are compared by these, for each
        key, and not one by one. A place of several keys is compared by fingerprints, which are dealt; so is every finding's with those of
        more, which stay where they are if more is small.
        """
        one = self.components is base.components
        side = lambda df, a, b, *by: df.select(*by, F.lit(a).alias("a"), F.lit(b).alias("b"))
        own = ("__key", "__d", "__c")
        both = side(self.components, 1, 1, *own) if one else side(self.components, 1, 0, *own).unionByName(side(base.components, 0, 1, *own))
        places = materialize(both.groupBy("__key", "__d").agg(F.min("__c").alias("__c"), F.sum("a").alias("na"), F.sum("b").alias("nb")), "places")
        own = ("__key", "advisory_id", "__a")
        hits = side(self.hits, 1, 0, *own).unionByName(side(base.hits, 0, 1, *own))
        hits = materialize(hits.groupBy("__key", "advisory_id").agg(F.min("__a").alias("__a"), F.sum("a").alias("ma"), F.sum("b").alias("mb")), "said")
        odd = materialize(places.groupBy("__d").count().where("count > 1").select("__d"), "odd")
        plain = places if odd.isEmpty() else places.join(odd, "__d", "left_anti")
        a, b = F.col("na"), F.col("nb") > 0
        c = plain.groupBy("__key").agg(F.sum(a).alias("ca"), F.sum(F.when(b, a)).alias("cab"), F.count_if(b).alias("cb"), F.count_if(b & (a > 0)).alias("cboth"))
        a, b = F.col("ma"), F.col("mb") > 0
        h = hits.groupBy("__key").agg(F.sum(a).alias("ha"), F.sum(F.when(b, a)).alias("hab"), F.count_if(b).alias("hb"), F.count_if(b & (a > 0)).alias("hboth"))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
        named = lambda found, existing, base, matched: [total(x).alias(n) for x, n in ((found, "found"), (existing, "existing"), (base, "base"), (matched, "matched"))]
        parts = [c.join(h.hint("merge"), "__key").agg(*named(F.expr("ca * ha"), F.expr("cab * hab"), F.expr("cb * hb"), F.expr("cboth * hboth")))]

        def prints(some: DataFrame) -> DataFrame:
            """(fingerprint, n, held) of pairs of places and hits: findings, and whether base has one."""
            fp = digest(SPACES["vulnerability-occurrence"], F.col("__a"), F.col("__c"), F.col("__d"))
            return self.joined(some, hits).select(fp.alias("fingerprint"), F.expr("na * ma").alias("n"), F.expr("nb > 0 and mb > 0").alias("held"))

        each = lambda df: df.groupBy("fingerprint").agg(F.sum("n").alias("n"), F.bool_or("held").alias("held"))
        if not odd.isEmpty():
            held = F.col("held").cast("long")
            parts.append(each(prints(places.join(odd, "__d", "left_semi"))).agg(*named(F.col("n"), F.col("n") * held, held, F.when(F.col("n") > 0, held))))
        loose = materialize(more.select("fingerprint").distinct(), "loose")
        count = loose.count()
        if count:
            met = each(prints(places).join(maybe_broadcast(loose, count), "fingerprint", "left_semi"))
            fresh = (~F.col("held")).cast("long")  # what base has is counted already
            parts.append(met.agg(*named(F.lit(0), F.col("n") * fresh, F.col("held").cast("long") * -1, F.when(F.col("n") > 0, fresh))).withColumn("base", F.col("base") + count))
        out = reduce(DataFrame.unionByName, parts).agg(*named("found", "existing", "base", "matched"))
        return out.select((F.col("found") - F.col("existing")).alias("new"), "existing", "matched", (F.col("base") - F.col("matched")).alias("resolved"))


def match(components: DataFrame, packages: DataFrame, advisories: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Affected (component, advisory) pairs, each a row (see ``affected``)."""
    return affected(components, packages, advisories, keep).rows()


def affected(components: DataFrame, packages: DataFrame, advisories: DataFrame | None = None, keep: tuple[str, ...] = ()) -> Findings:
    """Affected (component, advisory) pairs; with advisories (id, severity) their severity, too (see ``with_severity``), and
    the components' columns in keep.

    components: ecosystem, name, version, purl, manifest_path; packages: advisory_id, ecosystem,
    name, aliases, withdrawn, source, versions array<string>, ranges (EVENTS). A version listed
    matches exactly, else the first range that holds it. ``bad_version`` marks pairs in which a
    version is malformed under the ecosystem's order; such a pair only matches by its list.
    Components without a version and withdrawn advisories match nothing.

    Distinct versions meet packages through the ends of their intervals (see ``pairs``), so the pairs read are
    about those found, whatever the number of a name's components and advisories. Packages of one name that have the same
    versions and ranges are judged as one, and its findings then go to each, in packs of about PACK. What is said of a version and a
    package is worked out before components meet it: a finding costs one digest. Components and pairs are dealt by version
    to many tasks, however small their tables are, as findings may be many more than both. The key is one column: of
    several a constant one (an ecosystem) would be taken out of the join, which would then deal anew by the size of its sides.
    """
    eco, name = versions.ecosystem(F.col("ecosystem")), F.lower(F.trim("name"))
    p = packages.where("withdrawn is null").select("advisory_id", eco.alias("ecosystem"), F.lower("name").alias("name"), "aliases", "source", F.coalesce("versions", F.array().cast("array<string>")).alias("versions"), "ranges")
    # expressions are built for the orders that occur among the packages, of which there are a few
    only = versions.orders_of({r[0] for r in p.select("ecosystem").distinct().collect()})
    parts = _parts(components.sparkSession)
    # versions are taken apart once for each distinct one and each event, not for each pair, by many tasks also where packages are one file
    same = ["ecosystem", "name", "versions", "ranges"]
    kinds = p.groupBy(*same).agg(F.ceil(F.count("*") / F.lit(PACK)).cast("int").alias("packs"))
    kinds = kinds.repartition(parts).withColumn("steps", built(("steps", only), lambda: F.transform("ranges", lambda r: versions.steps(F.col("ecosystem"), r, only)))).withColumn("package", F.monotonically_increasing_id())
    kinds = kinds.select("*", F.explode(F.array(F.col("steps"))).alias("__steps")).drop("steps").withColumnRenamed("__steps", "steps")  # worked out once
    kinds = materialize(kinds.withColumn("spans", built(("spans", only), lambda: spans_of(F.col("steps"), only))), "packages")
    of = kinds.select("package", "packs", *[F.col(x).alias(f"__{x}") for x in same])
    on = reduce(and_, [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in same])
    members = p.join(of.hint("merge"), on).select("package", F.pmod(F.xxhash64("advisory_id"), "packs").cast("int").alias("pack"), "advisory_id", "aliases", "source")
    c = components.where(F.coalesce("version", F.lit("")) != "").withColumn("ecosystem", eco).withColumn("name", name)
    distinct = c.select("ecosystem", "name", "version").distinct().withColumn("key", built(("key", only), lambda: versions.key(F.col("ecosystem"), F.col("version"), only)))
    distinct = distinct.select("*", F.explode(F.array(F.col("key"))).alias("__key")).drop("key").withColumnRenamed("__key", "key")
    distinct = distinct.withColumn("at", built(("at", only), lambda: versions.sortable(F.col("ecosystem"), F.col("key"), only)))
    distinct = materialize(distinct, "versions")
    j = pairs(distinct, kinds.select("package", "ecosystem", "name", "versions", "spans")).join(kinds.drop("ecosystem", "name", "spans").hint("merge"), "package")
    exact = F.array_contains("versions", F.col("version"))
    told = built(("told", only), lambda: F.transform("steps", lambda r: versions.affected(F.col("ecosystem"), F.col("key"), r, only)))
    j = j.where(F.col("listed") | ~exact).select("*", F.explode(F.array(told)).alias("told"))
    hit = F.coalesce(F.exists("told", lambda t: t["hit"]), F.lit(False))
    bad = F.coalesce(F.exists("told", lambda t: t["bad"]), F.lit(False))
    j = j.withColumn("bad_version", bad).where(F.col("listed") | hit & ~F.col("bad_version"))
    fixed = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten("ranges"), lambda e: e["fixed"]), lambda f: f.isNotNull())))
    j = j.select("package", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), "ecosystem", "name", "version", "bad_version", F.when(F.col("listed"), "exact-version").otherwise("ecosystem-range").alias("method"), fixed.alias("fixed_versions"))
    # findings of all versions of a pack come of a few small rows, by whose size Spark would deal them to one task
    j = j.repartition(parts, "package", "pack").join(members.repartition(parts, "package", "pack").hint("merge"), ["package", "pack"]).drop("package", "pack")
    said = F.concat(F.lit("OSV "), F.col("advisory_id"), F.lit(" matched "), F.col("ecosystem"), F.lit("/"), F.col("name"), F.lit(" version "), F.col("version"), F.lit(" by "), F.col("method"), F.lit("; fixed versions: "), F.when(F.size("fixed_versions") > 0, F.array_join("fixed_versions", ", ")).otherwise("unknown"))
    j = j.withColumns({"explanation": said, "__a": digest(SPACES["advisory"], F.col("advisory_id"))})
    if advisories is not None:
        j = with_severity(j, advisories)
    purl = F.coalesce("purl", F.concat(F.lit("pkg:"), F.col("ecosystem"), F.lit("/"), F.col("name"), F.lit("@"), F.col("version")))
    where = normal(F.coalesce("manifest_path", F.lit("__inventory__")))
    can = canonical_purl(F.col("component_purl"))
    own = ["ecosystem", "name", "version"]
    c = c.select(F.struct(*own).alias("__key"), "manifest_path", purl.alias("component_purl"), *keep)
    c = c.withColumns({"__c": digest(SPACES["component"], can), "__d": digest(SPACES["dependency-occurrence"], can, where, "")})
    return Findings(c, j.withColumn("__key", F.struct(*own)))


def evaluate(components: DataFrame, packages: DataFrame) -> DataFrame:
    """(ecosystem, name, version, purl, status, method, matches) of every component: affected, not
    affected, or indeterminate without a version."""
    eco, name = versions.ecosystem(F.col("ecosystem")), F.lower(F.trim("name"))
    c = components.select(eco.alias("ecosystem"), name.alias("name"), "version", "purl")
    n = match(components, packages).groupBy("ecosystem", "name", "version").agg(F.countDistinct("advisory_id").alias("matches"), F.min(F.struct("advisory_id", "method")).alias("first"))
    out = c.join(n, ["ecosystem", "name", "version"], "left")
    none = F.coalesce("version", F.lit("")) == ""
    return out.select(
        "ecosystem", "name", "version", "purl",
        F.when(none, "indeterminate").when(F.col("matches") > 0, "affected").otherwise("not_affected").alias("status"),
        F.when(none, "unresolved-range").when(F.col("matches") > 0, F.col("first.method")).otherwise("exact-package-version").alias("method"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def with_severity(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings with the advisory's own severity if it is one of the known words in lower case."""
    s = advisories.select(F.col("id").alias("advisory_id"), F.col("severity").alias("__s"))
    return found.join(s, "advisory_id", "left").withColumn("severity", F.when(F.col("__s").isin(*SEVERITIES[:4]), F.col("__s")).otherwise("unknown")).drop("__s")


def policy_fails(severity: Column, fail_on: str, unknown: str = "allow") -> Column:
    """Whether a severity fails a policy: unknown as the policy says, else at fail_on or worse."""
    rank = lambda x: F.coalesce(*[F.when(x == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])
    return F.when(severity == "unknown", F.lit(unknown == "fail")).otherwise(rank(severity) <= SEVERITIES.index(fail_on))
