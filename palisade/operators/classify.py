"""Paths of configuration files, by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, what names them, severity.
CATEGORIES = (
    ("ENV_CONFIG", "high", (".env", ".env.local", ".env.production", ".env.staging", ".env.test")),
    ("AUTH_CONFIG", "medium", ("config.json", "config.yaml", "config.yml", "settings.py", "application.properties", "application.yml")),
    ("CI_CONFIG", "high", (".github/workflows/", "Jenkinsfile", ".gitlab-ci.yml", "circle.yml", ".circleci/")),
    ("INFRA_CONFIG", "medium", ("docker-compose.yml", "docker-compose.yaml", "Dockerfile", "terraform.tf", "kubernetes.yaml", "k8s.yaml")),
)
KEYWORDS = ("auth", "password", "session", "oauth", "token", "security", "certificate", "ssl", "tls", "encrypt", "credential")


def categories(path: Column, exact_case: bool = True) -> Column:
    """Array of struct(category, severity) of a path, in the categories' order.

    Names with capitals never fit a lower-cased path; exact_case=False lower-cases them too.
    """
    low = F.lower(path)
    out = []
    for name, severity, patterns in CATEGORIES:
        test = F.lit(False)
        for p in patterns if exact_case else [x.lower() for x in patterns]:
            test = test | (F.contains(F.concat(F.lit("/"), low), F.lit("/" + p)) if p.endswith("/") else low.endswith(p))
        out.append(F.when(test, F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"))))
    out.append(F.when(low.rlike("|".join(KEYWORDS)), F.struct(F.lit("SECURITY_CONFIG").alias("category"), F.lit("high").alias("severity"))))
    return F.array_compact(F.array(*out))


def config_changes(paths: DataFrame, change: Column | None = None) -> DataFrame:
    """(type, file, severity, change_type, category) for each category of each path."""
    each = paths.select(F.col("path").alias("file"), (F.lit("modified") if change is None else change).alias("change_type"), F.explode(categories(F.col("path"))).alias("c"))
    return each.select(F.lit("config").alias("type"), "file", "c.severity", "change_type", "c.category")
