"""Advisory feeds to one shape: id, aliases, summary, details, published, modified, withdrawn, severity,
source and affected packages.

Feeds are (path, text) or one JSON record a row in ``record``. A record that lacks what it must have
gets a reject_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.tables import materialize
from palisade.functions.versions import ecosystem

EVENT = "struct<introduced:string,fixed:string,last_affected:string>"
OSV = f"struct<id:string,aliases:array<string>,summary:string,details:string,published:string,modified:string,withdrawn:string,schema_version:string,severity:array<struct<type:string,score:string>>,references:array<struct<type:string,url:string>>,database_specific:struct<severity:string>,affected:array<struct<package:struct<ecosystem:string,name:string,purl:string>,ranges:array<struct<type:string,events:array<{EVENT}>>>,versions:array<string>>>>"

#: Feeds of fixed versions: the ecosystem of their packages (fixed values).
FIXED_FEEDS = {
    "debian": "Debian", "ubuntu": "Ubuntu", "redhat": "RPM", "suse": "RPM", "alpine": "Alpine", "maven": "Maven", "nuget": "NuGet", "rubygems": "RubyGems",
    "swift": "SwiftURL", "dart": "Pub", "elixir": "Hex", "haskell": "Hackage", "r": "CRAN", "conan": "ConanCenter", "vcpkg": "vcpkg",
}


def records(files: DataFrame, key: str | None = None) -> DataFrame:
    """(path, record): the JSON objects of an array, of a list under key, ``vulns`` or ``advisories``, or one object."""
    as_list = lambda c: F.from_json(c, "array<string>")
    text = F.trim("text")
    inner = F.coalesce(*[F.get_json_object("text", f"$.{k}") for k in ([key] if key else ["vulns", "advisories"])])
    listed = F.when(text.startswith("["), as_list(F.col("text"))).when(inner.startswith("["), as_list(inner)).otherwise(F.array("text"))
    return files.select("path", F.explode(listed).alias("record"))


def osv(rows: DataFrame, source: str = "osv") -> DataFrame:
    """Advisories of OSV records. Of several records of one id the last stays, by modified, then content."""
    d = rows.select("record", F.from_json("record", OSV).alias("d"))
    reason = F.when(F.coalesce("d.id", F.lit("")) == "", "missing id").when(F.coalesce("d.modified", F.lit("")) == "", "missing modified")
    out = d.select("d.*", F.lit(source).alias("source"), F.sha2("record", 256).alias("digest"), reason.alias("reject_reason"))
    bad = out.where("reject_reason is not null")
    good = out.where("reject_reason is null")
    rest = [c for c in good.columns if c not in ("id", "modified", "digest")]
    last = good.groupBy("id").agg(F.max_by(F.struct("modified", "digest", *rest), F.struct("modified", "digest")).alias("x")).select("id", "x.*")
    return last.select(*out.columns).unionByName(bad)


def packages(advisories: DataFrame) -> DataFrame:
    """(advisory_id, ecosystem, name, purl, aliases, withdrawn, source, versions, ranges) of osv()."""
    x = advisories.where("reject_reason is null").select(F.col("id").alias("advisory_id"), "aliases", "withdrawn", "source", F.explode("affected").alias("a"))
    ranges = F.transform(F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:array<{EVENT}>>>")), lambda r: r["events"])
    return x.select("advisory_id", ecosystem(F.col("a.package.ecosystem")).alias("ecosystem"), F.lower("a.package.name").alias("name"), "a.package.purl", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "withdrawn", "source", F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"), ranges.alias("ranges"))


def _osv_row(id_: Column, aliases: Column, summary: Column, details: Column, published: Column, modified: Column, withdrawn: Column, severity: Column, affected: Column) -> list[Column]:
    return [id_.alias("id"), aliases.alias("aliases"), summary.alias("summary"), details.alias("details"), published.alias("published"), modified.alias("modified"), withdrawn.alias("withdrawn"), severity.alias("severity"), affected.alias("affected")]


def _event(introduced: Column, fixed: Column, last: Column) -> Column:
    s = lambda x: x.cast("string")
    return F.struct(s(introduced).alias("introduced"), s(fixed).alias("fixed"), s(last).alias("last_affected"))


def ghsa_events(text: Column) -> Column:
    """Events of a range of one or two clauses; null if it is not supported, as ``< x`` alone.

    Of ``>= a, <= b`` only the start is kept, as in the data this follows.
    """
    null = F.lit(None).cast("string")
    low = F.regexp_extract(text, r"^>=\s*([^\s,<>=]+)(?:\s*,|\s*$)", 1)
    high = F.regexp_extract(text, r"^>=\s*[^\s,]+\s*,\s*<\s*([^\s,<>=]+)\s*$", 1)
    upto = F.regexp_extract(text, r"^<=\s*([^\s,<>=]+)\s*$", 1)
    only = F.regexp_extract(text, r"^=\s*([^\s,<>=]+)\s*$", 1)
    start = _event(low, null, null)
    return (
        F.when((low != "") & (high != ""), F.array(start, _event(null, high, null))).when(low != "", F.array(start))
        .when(upto != "", F.array(_event(F.lit("0"), null, null), _event(null, null, upto))).when(only != "", F.array(_event(only, null, null), _event(null, null, only)))
    )


def ghsa(rows: DataFrame) -> DataFrame:
    d = F.from_json("record", "struct<ghsa_id:string,cve_id:string,identifiers:array<struct<type:string,value:string>>,summary:string,description:string,severity:string,published_at:string,updated_at:string,withdrawn_at:string,vulnerabilities:array<struct<package:struct<ecosystem:string,name:string>,vulnerable_version_range:string>>>")
    x = rows.select(d.alias("d")).select("d.*")
    names = F.filter(F.array_distinct(F.concat(F.array("cve_id"), F.transform(F.coalesce("identifiers", F.array().cast("array<struct<type:string,value:string>>")), lambda i: i["value"]))), lambda v: v.isNotNull() & (F.upper(v) != F.upper("ghsa_id")))
    affected = F.transform("vulnerabilities", lambda v: F.struct(v["package"]["ecosystem"].alias("ecosystem"), v["package"]["name"].alias("name"), ghsa_events(v["vulnerable_version_range"]).alias("events"), v["vulnerable_version_range"].alias("stated")))
    reason = F.when(~F.upper("ghsa_id").rlike("^GHSA(-[0-9A-Z]{4}){3}$") | F.col("ghsa_id").isNull(), "malformed id")
    return x.select(*_osv_row(F.upper("ghsa_id"), F.array_sort(names), F.col("summary"), F.col("description"), F.col("published_at"), F.col("updated_at"), F.col("withdrawn_at"), F.col("severity"), affected), F.lit("github-advisory").alias("source"), reason.alias("reject_reason"))


def cve_v5(rows: DataFrame) -> DataFrame:
    """CVE records: English descriptions joined by blank lines; the first 512 characters are the summary; rejected ones are withdrawn."""
    d = F.from_json("record", "struct<cveMetadata:struct<cveId:string,state:string,datePublished:string,dateUpdated:string>,containers:struct<cna:struct<descriptions:array<struct<lang:string,value:string>>,references:array<struct<url:string>>>>>")
    x = rows.select(d.alias("d"))
    text = F.array_join(F.transform(F.filter("d.containers.cna.descriptions", lambda e: F.lower(e["lang"]).startswith("en")), lambda e: e["value"]), "\n\n")
    m = "d.cveMetadata."
    reason = F.when(~F.col(m + "cveId").rlike(r"^CVE-\d{4}-\d{4,}$") | F.col(m + "cveId").isNull(), "malformed id")
    none = F.array().cast("array<string>")
    withdrawn = F.when(F.col(m + "state") == "REJECTED", F.coalesce(m + "dateUpdated", m + "datePublished"))
    return x.select(*_osv_row(F.col(m + "cveId"), none, F.substring(text, 1, 512), text, F.col(m + "datePublished"), F.col(m + "dateUpdated"), withdrawn, F.lit(None).cast("string"), F.array().cast("array<string>")), F.lit("cve-v5").alias("source"), reason.alias("reject_reason"))


def nvd_metrics(rows: DataFrame) -> DataFrame:
    """(cve_id, modified, digest, version, type, score) for every CVSS metric of NVD records."""
    metric = "array<struct<type:string,cvssData:struct<version:string,baseScore:double>>>"
    d = F.from_json("record", f"struct<cve:struct<id:string,lastModified:string,metrics:struct<cvssMetricV40:{metric},cvssMetricV31:{metric},cvssMetricV30:{metric},cvssMetricV2:{metric}>>>")
    x = rows.select(d.alias("d"), F.sha2("record", 256).alias("digest"))
    none = F.array().cast(metric)
    all_ = F.concat(*[F.coalesce(f"d.cve.metrics.{k}", none) for k in ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    return x.select(F.col("d.cve.id").alias("cve_id"), F.col("d.cve.lastModified").alias("modified"), "digest", F.explode_outer(all_).alias("m")).select("cve_id", "modified", "digest", F.col("m.cvssData.version").alias("version"), "m.type", F.col("m.cvssData.baseScore").alias("score"))


def nvd_weaknesses(rows: DataFrame) -> DataFrame:
    d = F.from_json("record", "struct<cve:struct<id:string,weaknesses:array<struct<type:string,description:array<struct<lang:string,value:string>>>>>>")
    w = rows.select(d.alias("d")).select(F.col("d.cve.id").alias("cve_id"), F.explode("d.cve.weaknesses").alias("w"))
    return w.select("cve_id", F.col("w.type").alias("type"), F.explode("w.description").alias("e")).select("cve_id", "type", F.col("e.value").alias("cwe")).distinct()


def kev(rows: DataFrame) -> DataFrame:
    names = ("cveID", "vendorProject", "product", "vulnerabilityName", "dateAdded", "shortDescription", "requiredAction", "dueDate")
    d = F.from_json("record", "struct<" + ",".join(f"{n}:string" for n in (*names, "knownRansomwareCampaignUse", "notes")) + ">")
    x = rows.select(d.alias("d"), F.sha2("record", 256).alias("digest")).select("d.*", "digest")
    lacks = F.exists(F.array(*names), lambda v: F.coalesce(F.trim(v), F.lit("")) == "")
    dated = F.expr("try_to_date(dateAdded, 'yyyy-MM-dd')").isNull() | F.expr("try_to_date(dueDate, 'yyyy-MM-dd')").isNull()
    return x.select(F.upper("cveID").alias("cve_id"), "dateAdded", "dueDate", F.col("knownRansomwareCampaignUse").alias("ransomware_use"), "digest", F.when(lacks, "missing field").when(dated, "malformed date").alias("reject_reason"))


def epss(rows: DataFrame) -> DataFrame:
    """Scores as numbers or numeric strings, from 0 to 1."""
    d = F.from_json("record", "struct<cve:string,epss:string,percentile:string,date:string>")
    x = rows.select(d.alias("d"), F.sha2("record", 256).alias("digest")).select("d.*", "digest")
    p = lambda c: F.col(c).try_cast("double")
    bad = lambda c: F.col(c).isNull() | p(c).isNull() | F.isnan(p(c)) | (p(c) < 0) | (p(c) > 1)
    reason = F.when(~F.upper("cve").rlike(r"^CVE-\d{4}-\d{4,}$") | F.col("cve").isNull(), "malformed id").when(bad("epss") | bad("percentile"), "not a probability").when(F.expr("try_to_date(date, 'yyyy-MM-dd')").isNull(), "malformed date")
    return x.select(F.upper("cve").alias("cve_id"), p("epss").alias("epss"), p("percentile").alias("percentile"), F.col("date").alias("score_date"), "digest", reason.alias("reject_reason"))


def vulnrichment(rows: DataFrame) -> DataFrame:
    """(cve_id, exploitation, automatable, technical_impact, digest) of the CISA containers of CVE records."""
    other = "struct<type:string,content:struct<options:array<map<string,string>>>>"
    d = F.from_json("record", f"struct<cveMetadata:struct<cveId:string>,containers:struct<adp:array<struct<providerMetadata:struct<shortName:string>,metrics:array<struct<other:{other}>>>>>>")
    x = rows.select(F.upper(d["cveMetadata"]["cveId"]).alias("cve_id"), F.explode(d["containers"]["adp"]).alias("a"), F.sha2("record", 256).alias("digest")).where("a.providerMetadata.shortName = 'CISA-ADP'")
    m = x.select("cve_id", "digest", F.explode("a.metrics").alias("m")).where("m.other.type = 'ssvc'").select("cve_id", "digest", F.explode("m.other.content.options").alias("o"))
    pick = lambda k: F.lower(F.max(F.try_element_at("o", F.lit(k))))
    return m.groupBy("cve_id", "digest").agg(pick("Exploitation").alias("exploitation"), pick("Automatable").alias("automatable"), pick("Technical Impact").alias("technical_impact"))


def fixed_feed(rows: DataFrame, feed: str) -> DataFrame:
    """Packages of a feed that states fixed versions: binary packages, or the package itself, from 0 to fixed."""
    d = F.from_json("record", "struct<id:string,package:string,fixed:string,severity:string,urgency:string,binary_packages:array<string>>")
    x = rows.select(d.alias("d")).select("d.*")
    names = F.when(F.size(F.coalesce("binary_packages", F.array().cast("array<string>"))) > 0, F.col("binary_packages")).otherwise(F.array("package"))
    null = F.lit(None).cast("string")
    ok = F.col("id").isNotNull() & F.col("package").isNotNull() & F.col("fixed").isNotNull()
    return x.where(ok).withColumn("one", F.explode(names)).select(
        F.col("id").alias("advisory_id"), ecosystem(F.lit(FIXED_FEEDS[feed])).alias("ecosystem"), F.lower("one").alias("name"), null.alias("purl"), F.array().cast("array<string>").alias("aliases"), null.alias("withdrawn"), F.lit(feed).alias("source"),
        F.array().cast("array<string>").alias("versions"), F.array(F.array(_event(F.lit("0"), null, null), _event(null, F.col("fixed"), null))).alias("ranges"), F.coalesce("severity", "urgency", F.lit("Unknown")).alias("severity"),
    )


#: Levels of a product tree that one round takes apart.
LEVELS = 6
_PRODUCT = "struct<product_id:string,product_identification_helper:struct<purl:string>>"


def csaf_products(rows: DataFrame) -> DataFrame:
    """(doc, product_id, purl) of CSAF product trees of any depth; doc is the record's digest.

    A round takes LEVELS levels apart and writes what lies below them, for the next one; it goes on until no
    tree has branches left, so the rounds grow with the deepest tree alone. A product that a tree names twice
    comes twice.
    """
    front = rows.select(F.sha2("record", 256).alias("doc"), F.get_json_object("record", "$.product_tree").alias("node")).where("node is not null").dropDuplicates(["doc"])
    found = []
    while True:
        level, parts = front, []
        for _ in range(LEVELS):
            product = F.from_json("node", f"struct<full_product_names:array<{_PRODUCT}>,product:{_PRODUCT},branches:array<string>>").alias("n")
            level = level.select("doc", product)
            parts.append(level.select("doc", F.explode(F.array_compact(F.concat(F.array("n.product"), F.coalesce("n.full_product_names", F.array().cast(f"array<{_PRODUCT}>"))))).alias("p")).select("doc", "p.product_id", F.col("p.product_identification_helper.purl").alias("purl"), F.lit(None).cast("string").alias("node")))
            level = level.select("doc", F.explode("n.branches").alias("node"))
        none = F.lit(None).cast("string")
        out = level.select("doc", none.alias("product_id"), none.alias("purl"), "node")
        for x in parts:
            out = out.unionByName(x.where("product_id is not null"))
        out = materialize(out, "products")
        found.append(out.where("product_id is not null").drop("node"))
        front = out.where("node is not null").select("doc", "node")
        if front.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def csaf_assertions(rows: DataFrame) -> DataFrame:
    """(doc, cve, product_id, status): what CSAF documents say of products; quality checks join these to csaf_products."""
    s = "struct<known_affected:array<string>,known_not_affected:array<string>>"
    d = F.from_json("record", f"struct<vulnerabilities:array<struct<cve:string,product_status:{s}>>>")
    v = rows.select(F.sha2("record", 256).alias("doc"), F.explode(d["vulnerabilities"]).alias("v"))
    each = lambda k: v.select("doc", "v.cve", F.explode(f"v.product_status.{k}").alias("product_id"), F.lit(k).alias("status"))
    return each("known_affected").unionByName(each("known_not_affected"))


def dangling(assertions: DataFrame, products: DataFrame) -> DataFrame:
    """Assertions of products that their document's tree does not hold."""
    return assertions.join(products.select("doc", "product_id").distinct(), ["doc", "product_id"], "left_anti")
