"""Dependency manifests to components, unresolved requirements and warnings.

Each parser takes (path, text) rows and returns (path, kind, ecosystem, name, version, requirement,
reason) with kind component, unresolved or warning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.tables import materialize

#: Names of manifests, by parser (fixed values).
NAMES = {
    "requirements": r"(^|/)requirements[^/]*\.txt$|(^|/)requirements/[^/]+\.txt$", "package_lock": r"(^|/)package-lock\.json$", "cargo_lock": r"(^|/)Cargo\.lock$", "go_mod": r"(^|/)go\.mod$",
    "go_sum": r"(^|/)go\.sum$", "composer_lock": r"(^|/)composer\.lock$", "poetry_lock": r"(^|/)poetry\.lock$", "uv_lock": r"(^|/)uv\.lock$",
}


def _row(kind: Column | str, eco: str, name: Column, version: Column | None = None, requirement: Column | None = None, reason: Column | str | None = None) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return [lit(kind).alias("kind"), F.lit(eco).alias("ecosystem"), name.alias("name"), lit(version).alias("version"), lit(requirement).alias("requirement"), lit(reason).alias("reason")]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("at", "line"))


def pep503(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def requirements(files: DataFrame) -> DataFrame:
    """Pins (== or ===) are components; ranges and bare names are unresolved; options and URLs warn."""
    x = F.trim(F.regexp_replace(F.split("line", ";", 2)[0], r"(^|\s)#.*$", ""))
    rows = _lines(files).select("path", x.alias("x")).where("x <> ''")
    pattern = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(.*)$"
    name, rest = pep503(F.regexp_extract("x", pattern, 1)), F.trim(F.regexp_extract("x", pattern, 2))
    pin = F.regexp_extract(rest, r"^===?\s*([^\s,*]+)$", 1)
    odd = F.col("x").startswith("-") | F.col("x").rlike("^[a-z+]+://|@\\s*[a-z+]+://") | (name == "")
    kind = F.when(odd, "warning").when(pin != "", "component").otherwise("unresolved")
    reason = F.when(odd, "unsupported").when(pin != "", None).when(rest == "", "version_unknown").otherwise("version_range")
    return rows.select("path", *_row(kind, "pypi", F.when(odd, None).otherwise(name), F.when(~odd & (pin != ""), pin), F.when(odd | (pin == ""), F.col("x")), reason))


def includes(files: DataFrame) -> DataFrame:
    """(path, target): the files that -r and -c lines of requirements name, beside their own."""
    target = F.regexp_extract("line", r"^\s*(?:-r|-c|--requirement|--constraint)[\s=]+(\S+)", 1)
    rows = _lines(files).select("path", target.alias("t")).where("t <> ''")
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    return rows.select("path", F.concat(folder, F.col("t")).alias("target"))


def closure(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, path, depth, warning) of the files that includes lead to from each root, the root itself at depth 0.

    edges: path, target; roots: path. Each round joins the files that the last one reached first with the edges and
    keeps those that are new to their root, until none is; a file's depth is the least. warning is null for a file
    that is read, ``cycle`` for one that a file no less deep, to which it leads, includes again, and ``depth`` for one beyond
    most levels, which is not followed. The rounds grow with the longest chain of includes; each is written.
    """
    edges = materialize(edges.select("path", "target").where("target is not null").distinct(), "edges")
    first = roots.select(F.col("path").alias("root"), "path").where("path is not null").distinct()
    seen = materialize(first.withColumn("depth", F.lit(0)), "reached")
    front, depth, beyond = seen, 0, None
    while True:
        depth += 1
        step = front.select("root", "path").join(edges, "path").select("root", F.col("target").alias("path")).distinct().join(seen, ["root", "path"], "left_anti").withColumn("depth", F.lit(depth))
        step = materialize(step, "reached")
        if step.isEmpty():
            break
        if most is not None and depth > most:
            beyond = step
            break
        seen, front = seen.unionByName(step), step
    out = seen.withColumn("warning", F.lit(None).cast("string"))
    if beyond is not None:
        out = out.unionByName(beyond.withColumn("warning", F.lit("depth")))
    return out.unionByName(_cycles(edges, seen))


def _cycles(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """A row for each file that an include of a root's files, which is no less deep, closes a cycle with."""
    own = cyclic(edges)
    ends = lambda c: own.select(F.col("node").alias(c), F.col("cycle").alias(f"{c}_cycle"))
    inside = edges.join(ends("path"), "path").join(ends("target"), "target").where("path_cycle = target_cycle").select("path", "target")
    deep = lambda c, d: seen.select("root", F.col("path").alias(c), F.col("depth").alias(d))
    back = inside.join(deep("path", "from"), "path").join(deep("target", "to"), ["root", "target"]).where(F.col("to") <= F.col("from"))
    return back.groupBy("root", F.col("target").alias("path")).agg((F.min("from") + 1).cast("int").alias("depth")).withColumn("warning", F.lit("cycle"))


def cyclic(edges: DataFrame) -> DataFrame:
    """(node, cycle) of the nodes of directed edges (path, target) that lead back to themselves: those of one strongly
    connected part have the same cycle.

    Nodes that nothing leads to, or that lead nowhere, are taken away again and again. Of the rest each takes the
    greatest name that leads to it; what in turn leads to that name, among those that took it, is its part. Parts are
    taken away until nothing is left. Rows are never more than the edges.
    """
    out = edges.sparkSession.createDataFrame([], "node string, cycle string")
    rest = edges.select("path", "target").distinct()
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            return out
        color = materialize(rest.select(F.col("path").alias("node")).distinct().withColumn("cycle", F.col("node")), "colors")
        moved = True
        while moved:
            come = rest.join(color.withColumnRenamed("node", "path"), "path").groupBy(F.col("target").alias("node")).agg(F.max("cycle").alias("come"))
            step = color.join(come, "node").select("node", F.greatest("cycle", "come").alias("cycle"), (F.col("come") > F.col("cycle")).alias("moved"))
            step = materialize(step, "colors")
            moved, color = not step.where("moved").isEmpty(), step.select("node", "cycle")
        back = rest.join(color.withColumnRenamed("node", "path").withColumnRenamed("cycle", "a"), "path").join(color.withColumnRenamed("node", "target").withColumnRenamed("cycle", "b"), "target").where("a = b").select("path", "target", F.col("a").alias("cycle"))
        back = materialize(back, "inside")
        part = front = color.where("node = cycle")
        while True:
            front = back.join(front.select(F.col("node").alias("target"), "cycle"), ["target", "cycle"]).select(F.col("path").alias("node"), "cycle").distinct().join(part, ["node", "cycle"], "left_anti")
            front = materialize(front, "part")
            if front.isEmpty():
                break
            part = part.unionByName(front)
        part = materialize(part, "part")
        out = out.unionByName(part)
        gone = part.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "path"), "path", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("path", "target")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose nodes have both an edge in and one out, among these again."""
    rest = materialize(edges, "rest")
    n = rest.count()
    while n:
        into, out = rest.select(F.col("target").alias("path")).distinct(), rest.select(F.col("path").alias("target")).distinct()
        rest = materialize(rest.join(into, "path", "left_semi").join(out, "target", "left_semi").select("path", "target"), "rest")
        if (now := rest.count()) == n:
            break
        n = now
    return rest




def package_lock(files: DataFrame) -> DataFrame:
    """Versions 2 and 3: the packages map; version 1: dependencies, nested to any depth by JSON paths of levels."""
    entry = "struct<version:string,link:boolean,name:string>"
    doc = F.from_json("text", f"struct<lockfileVersion:int,packages:map<string,{entry}>>")
    rows = files.select("path", "text", doc.alias("d"))
    v2 = rows.select("path", F.explode("d.packages").alias("k", "e")).where("k <> '' and not coalesce(e.link, false)")
    name = F.coalesce("e.name", F.regexp_extract("k", r"^(?:.*/)?node_modules/(.+)$", 1))
    out = v2.where(F.col("e.version").isNotNull() & (name != "")).select("path", *_row("component", "npm", name, F.col("e.version")))
    level = rows.where("d.packages is null").select("path", F.get_json_object("text", "$.dependencies").alias("deps"))
    for _ in range(8):
        each = level.select("path", F.explode(F.from_json("deps", "map<string,string>")).alias("k", "e"))
        version = F.get_json_object("e", "$.version")
        out = out.unionByName(each.where(version.isNotNull()).select("path", *_row("component", "npm", F.col("k"), version)))
        level = each.select("path", F.get_json_object("e", "$.dependencies").alias("deps")).where("deps is not null")
    return out


def _stanzas(eco: str, fold: bool) -> Callable[[DataFrame], DataFrame]:
    def parse(files: DataFrame) -> DataFrame:
        parts = files.select("path", F.explode(F.split("text", r"(?m)^\[\[package\]\]\s*$")).alias("s"))
        field = lambda f: F.regexp_extract("s", rf'(?m)^{f}\s*=\s*"([^"]*)"', 1)
        name = pep503(field("name")) if fold else field("name")
        body = parts.where(F.col("s").rlike(r"(?m)^(name|version)\s*=")).where(~F.col("s").rlike(r"^\s*(#.*\n|version\s*=.*\n|requires-python.*\n)*\s*$"))
        bad = (field("name") == "") | (field("version") == "")
        return body.where(F.col("s").rlike(r"(?m)^name\s*=")).select("path", *_row(F.when(bad, "warning").otherwise("component"), eco, name, F.when(~bad, field("version")), None, F.when(bad, "incomplete package")))

    return parse


cargo_lock = _stanzas("cargo", False)
poetry_lock = _stanzas("pypi", True)
uv_lock = _stanzas("pypi", True)


def go_mod(files: DataFrame) -> DataFrame:
    """require lines and blocks; the blocks of other directives are cut out first."""
    text = F.regexp_replace(F.regexp_replace("text", "//[^\n]*", ""), r"(?ms)^\s*(?:replace|exclude|retract)\s*\(.*?^\s*\)", "")
    block = F.regexp_extract_all(text, F.lit(r"(?ms)^\s*require\s*\((.*?)^\s*\)"), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"(?m)^\s*require\s+([^\s(]\S*\s+\S+)\s*$"), F.lit(1))
    lines = F.concat(F.flatten(F.transform(block, lambda b: F.split(b, "\n"))), single)
    rows = files.select("path", F.explode(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("x")).where("x <> ''").distinct()
    return rows.select("path", *_row("component", "golang", F.split("x", r"\s+")[0], F.split("x", r"\s+")[1]))


def go_sum(files: DataFrame) -> DataFrame:
    rows = _lines(files).select("path", F.split(F.trim("line"), r"\s+").alias("p")).where("size(p) = 3 and p[2] like 'h1:%' and not p[1] like '%/go.mod'")
    return rows.select("path", *_row("component", "golang", F.col("p")[0], F.col("p")[1])).distinct()


def composer_lock(files: DataFrame) -> DataFrame:
    one = "array<struct<name:string,version:string>>"
    doc = F.from_json("text", f"struct<packages:{one},`packages-dev`:{one}>")
    rows = files.select("path", doc.alias("d")).select("path", F.explode(F.concat(F.coalesce("d.packages", F.array().cast(one)), F.coalesce("d.packages-dev", F.array().cast(one)))).alias("p"))
    return rows.where("p.name is not null and p.version is not null").select("path", *_row("component", "composer", F.col("p.name"), F.regexp_replace("p.version", "^v", "")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {k: globals()[k] for k in NAMES}


def inventory(files: DataFrame, repositories: bool = False) -> DataFrame:
    """What all manifests among files (path, text) name; of one package URL the first by path stays. With repositories a
    path's first folder is a repository, and of each repository the first stays."""
    out = None
    for k, parse in PARSERS.items():
        one = parse(files.where(F.col("path").rlike(NAMES[k])))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("purl", F.when(F.col("kind") == "component", F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), "version")))
    own = [F.split("path", "/", 2)[0].alias("__repository")] if repositories else []
    first = out.where("purl is not null").groupBy(*own, "purl").agg(F.min(F.struct("path", "kind", "ecosystem", "name", "version", "requirement", "reason")).alias("x")).select("x.*", "purl")
    return first.unionByName(out.where("purl is null"))
