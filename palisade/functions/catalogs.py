"""What feeds there are, how they are reached, and which of them a build of a database takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (source, family, status).
FEEDS = (
    ("osv", "advisory", "staging-ready"), ("nvd", "enrichment", "staging-ready"), ("cisa-kev", "exploitation", "staging-ready"), ("epss", "exploitation", "staging-ready"),
    ("github-advisories", "advisory", "staging-ready"), ("debian-security", "linux", "bounded"), ("ubuntu-security", "linux", "bounded"), ("redhat-security", "linux", "bounded"),
    ("suse-security", "linux", "bounded"), ("alpine-security", "linux", "bounded"), ("csaf-generic", "csaf", "bounded"), ("pypi", "ecosystem", "contract-only"),
    ("npm", "ecosystem", "contract-only"), ("crates", "ecosystem", "contract-only"), ("maven", "ecosystem", "bounded"), ("nuget", "ecosystem", "bounded"),
)
# Fixed values: (source, format, url, enabled).
SOURCES = (
    ("nvd", "nvd", "https://services.nvd.nist.gov/rest/json/cves/2.0?resultsPerPage=2000", False),
    ("cisa-kev", "kev", "https://www.cisa.gov/sites/default/files/feeds/known_exploited_vulnerabilities.json", True),
    ("epss", "epss", "https://api.first.org/data/v1/epss?limit=1000", True),
    ("github-advisories", "github-advisories", "https://api.github.com/advisories?per_page=100", True),
    ("osv", "osv-jsonl", "https://osv.dev/vulns/all.jsonl", True),
    ("cve-v5", "cve-v5", "https://cveawg.mitre.org/api/cve/", False),
    ("debian-security", "debian", "https://security-tracker.debian.org/tracker/data/json", False),
    ("ubuntu-security", "ubuntu", "https://ubuntu.com/security/notices.json", False),
    ("rustsec", "osv-json", "https://github.com/RustSec/advisory-db/archive/refs/heads/main.zip", False),
)
# What each profile takes, and its bounds in bytes.
CORE = ("osv", "github-advisories", "cisa-kev", "epss")
PROFILES = {
    "seed": (CORE, 512 << 20, 256 << 20),
    "core": (CORE, 8 << 30, 6 << 30),
    "extended": ((*CORE, "cve-v5", "nvd", "cwe", "cpe", "debian-security", "ubuntu-security", "redhat-security", "alpine", "rustsec"), 32 << 30, 24 << 30),
}


def feed_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEEDS, "source string, family string, status string")


def feed_counts(spark: SparkSession) -> DataFrame:
    """(status, feeds), and whether all feeds are ready."""
    return feed_catalog(spark).groupBy("status").agg(F.count("*").alias("feeds"))


def update_config() -> dict:
    """The sources of an update, with the one host that each may be fetched from."""
    return {"schema_version": 1, "sources": [{"source_id": s, "format": f, "url": u, "allowed_hosts": [u.split("/")[2]], "enabled": on} for s, f, u, on in SOURCES]}


def with_profile(config: dict, profile: str) -> dict:
    """The configuration in which only the profile's sources are enabled, of those that were."""
    if profile not in PROFILES:
        raise ValueError("unknown profile")
    chosen = PROFILES[profile][0]
    return config | {"profile": profile, "sources": [s | {"enabled": bool(s.get("enabled", True)) and s["source_id"] in chosen} for s in config["sources"]]}
