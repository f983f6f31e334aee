"""Queries over what is kept from run to run and over walks to a fixpoint, with the DuckDB SQL of each.

Suppliers stand for files of projects of fifty, and for advisories that come in four batches; the first three lines of
an order for what three successive scans see of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.tables import shared_folder
from palisade.operators import incidents, scan
from palisade.operators.labels import Labels
from palisade.plans import updates
from palisade.plans import store as stores
from palisade.plans.catalog import _CTX, _GROUPED, ORACLE, QUERIES, advisories, documents, query, table
from palisade.sources import feeds, manifests
from palisade.streaming import ordered


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/palisade-{uuid.uuid4().hex}/{name}"


_SEEN = "SELECT l_orderkey AS k, l_linenumber AS run, CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 20 THEN 'high' ELSE 'medium' END AS severity FROM lineitem WHERE l_linenumber <= 3"


@query(f"""WITH s AS (SELECT k, run, string_agg(DISTINCT severity, ',' ORDER BY severity) AS fact, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity FROM ({_SEEN}) GROUP BY k, run),
o AS (SELECT a.* FROM s a LEFT JOIN s b ON b.k = a.k AND b.run = a.run - 1 WHERE b.k IS NULL OR b.fact <> a.fact),
e AS (SELECT o.k, o.run, r, x.k IS NOT NULL AS same FROM o JOIN (VALUES (2), (3)) AS t(r) ON r > o.run LEFT JOIN s x ON x.k = o.k AND x.run = r AND x.fact = o.fact),
c AS (SELECT o.*, n.closed FROM o LEFT JOIN (SELECT k, run, min(r) FILTER (NOT same) AS closed FROM e GROUP BY k, run) n ON n.k = o.k AND n.run = o.run)
SELECT k AS orderkey, severity, CAST(run AS BIGINT) AS opened_run, CAST(closed AS BIGINT) AS closed_run, row_number() OVER (PARTITION BY k ORDER BY run) AS occurrence,
CASE WHEN closed IS NULL THEN 'open' WHEN there THEN 'superseded' ELSE 'resolved' END AS status FROM (SELECT c.*, x.k IS NOT NULL AS there FROM c LEFT JOIN s x ON x.k = c.k AND x.run = c.closed)""")
def incident_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    severity = F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 20, "high").otherwise("medium")
    key = F.col("l_orderkey").cast("string")
    seen = lines.select(
        F.col("l_linenumber").alias("run"), F.lit(incidents.EXTERNAL).alias("source_kind"), key.alias("source_id"), F.lit("order").alias("kind"), F.lit("lines").alias("category"), severity.alias("severity"), F.lit("high").alias("confidence"),
        F.concat(F.lit("orders/"), key).alias("path"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("hunk"), F.sha2(key, 256).alias("evidence_digest"), F.length(key).alias("evidence_length"),
    )
    root = _folder(spark, "incidents")
    stored = incidents.none_yet(spark)
    for run in (1, 2, 3):
        # a fact gathers distinct observations, so repeated ones need no shuffle of their own
        facts = incidents.facts(incidents.of_external(seen.where(F.col("run") == run).drop("run"))[0], "tables")
        stored, _ = incidents.merge(stored, facts, run, "tables")
        if run < 3:  # the last run is only read once; digests are half as large in zstd
            stored.write.option("compression", "zstd").parquet(f"{root}/{run}")
            stored = spark.read.schema(incidents.INCIDENTS).parquet(f"{root}/{run}")
    subject = incidents.digest("subject", "tables", *[F.col(c) for c in ("source_kind", "source_id", "kind", "category", "path", "evidence_digest")])
    names = seen.select(subject.alias("subject"), F.col("source_id").cast("long").alias("orderkey")).distinct()
    return stored.join(names, "subject").select("orderkey", "severity", "opened_run", "closed_run", F.col("occurrence").cast("long").alias("occurrence"), "status")


@query(f"{_GROUPED} SELECT a AS advisory_id, min(b) AS root FROM r GROUP BY a")
def alias_components_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Labels(spark, _folder(spark, "labels"))
    all_ = advisories(spark, sf_dir).withColumn("batch", F.pmod(F.hash("id"), F.lit(4)))
    for batch in range(4):
        kept.add_advisories(all_.where(F.col("batch") == batch))
    return kept.groups()


#: Of a project's fifty files: a chain of thirty includes, a diamond, a cycle behind it and one of a file alone.
_EDGES = (*[(i, i + 1) for i in range(30)], (0, 31), (0, 32), (31, 33), (32, 33), (33, 34), (34, 35), (35, 36), (36, 34), (37, 37), (0, 37))
_FILES = "SELECT s_suppkey AS k, s_suppkey // 50 AS p, s_suppkey % 50 AS i FROM supplier"


@query(f"""WITH RECURSIVE f AS ({_FILES}), e AS (SELECT f.p, a, b FROM f JOIN (VALUES {', '.join(map(str, _EDGES))}) AS t(a, b) ON f.i = a JOIN f g ON g.p = f.p AND g.i = b),
r(p, i, depth) AS (SELECT p, i, 0 FROM f WHERE i = 0 UNION SELECT r.p, e.b, r.depth + 1 FROM r JOIN e ON e.p = r.p AND e.a = r.i WHERE r.depth < 45),
d AS (SELECT p, i, min(depth) AS depth FROM r GROUP BY p, i), w(p, a, b) AS (SELECT p, a, b FROM e UNION SELECT w.p, w.a, e.b FROM w JOIN e ON e.p = w.p AND e.a = w.b)
SELECT p AS project, i AS file, CAST(depth AS BIGINT) AS depth, 'read' AS state FROM d
UNION ALL SELECT e.p, e.b, min(x.depth) + 1, 'cycle' FROM e JOIN w ON w.p = e.p AND w.a = e.b AND w.b = e.a JOIN d x ON x.p = e.p AND x.i = e.a JOIN d y ON y.p = e.p AND y.i = e.b WHERE y.depth <= x.depth GROUP BY e.p, e.b""")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 50").alias("p"), (k % 50).alias("i"))
    name = lambda p, i: F.concat_ws("/", p.cast("string"), i.cast("string"))
    pairs = spark.createDataFrame(_EDGES, "i long, j long")
    there = own.select("p", F.col("i").alias("j"))
    edges = own.join(F.broadcast(pairs), "i").join(there, ["p", "j"]).select(name(F.col("p"), F.col("i")).alias("path"), name(F.col("p"), F.col("j")).alias("target"))
    got = manifests.closure(edges, own.where("i = 0").select(name(F.col("p"), F.col("i")).alias("path")))
    part = lambda n: F.split("path", "/")[n].cast("long")
    return got.select(part(0).alias("project"), part(1).alias("file"), F.col("depth").cast("long").alias("depth"), F.coalesce("warning", F.lit("read")).alias("state"))


@query("SELECT 'p' || s_suppkey AS product_id, 'pkg:npm/p' || s_suppkey || '@1' AS purl FROM supplier")
def csaf_deep_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of up to forty branches a document, in each a product."""
    name = F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))
    leaf = F.to_json(F.struct(F.struct(name.alias("product_id"), F.struct(F.concat(F.lit("pkg:npm/"), name, F.lit("@1")).alias("purl")).alias("product_identification_helper")).alias("product")))
    depth = (F.col("s_suppkey") % 41).cast("int")
    record = F.concat(F.lit('{"product_tree":'), F.repeat(F.lit('{"branches":['), depth), leaf, F.repeat(F.lit("]}"), depth), F.lit("}"))
    return feeds.csaf_products(table(spark, sf_dir, "supplier").select(record.alias("record"))).select("product_id", "purl")


@query("""SELECT 'advisories' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'packages', count(*) FROM supplier UNION ALL SELECT 'ledger', count(*) FROM supplier UNION ALL SELECT 'errors', 0 UNION ALL SELECT 'about', 1
UNION ALL SELECT 'epss', (SELECT count(*) FROM customer WHERE c_custkey <= (SELECT max(s_suppkey) FROM supplier)) UNION ALL SELECT 'epss_unresolved', (SELECT count(*) FROM customer WHERE c_custkey > (SELECT max(s_suppkey) FROM supplier))""")
def update_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update from two feeds that stops after the first, and goes on."""
    root, k, c = _folder(spark, "update"), F.col("s_suppkey"), F.col("c_custkey")
    cve = lambda x: F.concat(F.lit("CVE-2024-"), F.lpad(x.cast("string"), 7, "0"))
    package = F.struct(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), k.cast("string")).alias("name"))
    record = F.to_json(F.struct(F.concat(F.lit("OSV-"), k.cast("string")).alias("id"), F.lit("2024").alias("modified"), F.array(cve(k)).alias("aliases"), F.array(F.struct(package.alias("package"), F.array(F.lit("1.0.0")).alias("versions"))).alias("affected")))
    table(spark, sf_dir, "supplier").select(record.alias("value")).write.text(f"{root}/osv.jsonl")
    score = F.to_json(F.struct(cve(c).alias("cve"), F.lit("0.5").alias("epss"), F.lit("0.5").alias("percentile"), F.lit("2024-01-01").alias("date")))
    table(spark, sf_dir, "customer").select(score.alias("value")).write.text(f"{root}/epss.jsonl")
    s = stores.Store(spark, f"{root}/db")
    paths = {"osv": f"{root}/osv.jsonl", "epss": f"{root}/epss.jsonl"}
    updates.Update(s, "full", paths).make("osv", updates.source_digest(spark, paths["osv"]))
    done = updates.Update(s, "full", paths).run(apply=True)
    if done["made"] != ["epss"]:
        raise RuntimeError(f"the first feed was made again: {done['made']}")
    return s.manifest(s.active()).select("name", F.col("rows").alias("n"))


@query(ORACLE["context_sequence"])
def stream_context_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered rules of ``context_sequence`` over the same lines as a stream."""
    root = _folder(spark, "stream")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.hash("path"), F.lit(600)))
    lines = scan.file_lines(documents(spark, sf_dir)).where(~F.col("too_long")).select("path", F.lit(0).alias("hunk"), F.col("line").cast("long").alias("line"), "content", at.alias("at"))
    lines.write.parquet(f"{root}/in")
    last = spark.range(1).select(F.lit("end").alias("path"), F.lit(0).alias("hunk"), F.lit(1).cast("long").alias("line"), F.lit("").alias("content"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    before = spark.conf.get(ordered.STORE[0], None)
    spark.conf.set(*ordered.STORE)
    try:
        for part in (None, last):  # the second start moves the watermark on, and all timers end
            if part is not None:
                part.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(lines.schema).parquet(f"{root}/in")
            found = ordered.stream_matches(stream, _CTX, "10 minutes")
            found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
        m = spark.read.schema(found.schema).parquet(f"{root}/out")
    finally:
        spark.conf.unset(ordered.STORE[0]) if before is None else spark.conf.set(ordered.STORE[0], before)
    return m.select("rule_id", F.col("path").alias("file"), F.col("line").cast("long").alias("line"), F.col("components")[1].cast("long").alias("next_line"))
