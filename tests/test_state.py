"""What is kept between runs: incidents, component labels, snapshots, updates and streams; and walks to a fixpoint."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from palisade.functions.registry import ContextRule
from palisade.operators import context, correlate, incidents, labels
from palisade.operators import scan as scans_of_lines
from palisade.plans import incidentlog, scans, snapshots, updates
from palisade.plans import store as stores
from palisade.sources import commits, feeds, files, manifests
from palisade.streaming import ordered

TOKEN = "ghp_" + "A" * 36


def test_commit_numbers_are_taken_once(spark, tmp_path):
    log = commits.Commits(spark, f"file:{tmp_path}/log dir")
    assert log.last() == (0, {})
    won, lost = [], []

    def put(i):
        try:
            commits.Commits(spark, f"file:{tmp_path}/log dir").put(1, {"by": i})
            won.append(i)
        except commits.Conflict:
            lost.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and log.last() == (1, {"by": won[0]})
    log._rename(b'{"by": "rename"}', f"{2:020}.json")  # as in a distributed file system
    with pytest.raises(commits.Conflict):
        log._rename(b"{}", f"{2:020}.json")
    assert log.last() == (2, {"by": "rename"}) and not [f for f in tmp_path.glob("log dir/.*") if f.suffix != ".crc"]


def test_two_activations_leave_one(spark, tmp_path):
    a, b = (snapshots.Store(spark, f"{tmp_path}/db") for _ in range(2))
    rows = spark.range(3).withColumnRenamed("id", "x")
    for s in ("one", "two", "three"):
        a.stage(s, {"t": rows})
    a.activate("one")
    verify, entered = b.verify, []

    def slow(snapshot_id, keys=None):  # the other activates while this one verifies
        entered.append(snapshot_id)
        a.activate("two")
        return verify(snapshot_id, keys)

    b.verify = slow
    with pytest.raises(commits.Conflict):
        b.activate("three")
    assert entered == ["three"] and a.active() == b.active() == "two"
    assert {r.snapshot_id: r.state for r in a.states().collect()} == {"one": "retired", "two": "active", "three": "staged"}
    assert a.table("two", "t").count() == 3


def test_a_dead_stage_is_recovered_and_fenced(spark, tmp_path, monkeypatch):
    s = snapshots.Store(spark, f"{tmp_path}/db")
    token = s.begin("snap")
    spark.range(5).write.parquet(f"{s.folder('snap')}/t")  # the writer dies here
    with pytest.raises(FileExistsError):
        s.stage("snap", {"t": spark.range(2)})
    with pytest.raises(KeyError):
        s.activate("snap")
    assert s.recover() == ["snap"] and s.recover() == [] and not list(tmp_path.glob(f"db/snap/{token}/t"))
    s.stage("snap", {"t": spark.range(2)})
    with pytest.raises(snapshots.Fenced):  # the dead writer comes back
        s.finish("snap", token)
    s.activate("snap")
    assert s.table("snap", "t").count() == 2 and s.active() == "snap"
    # a stage that is given up while its tables are written
    made = snapshots.digest

    def given_up(df):
        out = made(df)
        s.discard("late", ("begun",))
        monkeypatch.setattr(snapshots, "digest", made)
        return out

    monkeypatch.setattr(snapshots, "digest", given_up)
    with pytest.raises(snapshots.Fenced):
        s.stage("late", {"t": spark.range(2)})
    assert {r.snapshot_id: r.state for r in s.states().collect()} == {"snap": "active", "late": "given up"}
    assert s.prune(set(), apply=True) == []


def test_rollback_needs_a_snapshot_that_verifies(spark, tmp_path):
    s = stores.default_store(spark, f"{tmp_path}/db")
    tables = {"advisories": spark.createDataFrame([("A",)], "id string")}
    for name in ("one", "two"):
        s.stage(name, tables)
        s.activate(name)
    assert stores.rollback_ready(s, {"one"}) == {"ready": True, "applied": False, "plan": [], "targets": ["one"], "issues": {}}
    assert stores.rollback_ready(s, set())["ready"] is False  # the plan would delete it
    spark.createDataFrame([("B",)], "id string").write.mode("append").parquet(f"{s.folder('one')}/advisories")
    assert stores.rollback_ready(s, {"one"})["ready"] is False and list(stores.rollback_ready(s, {"one"})["issues"]) == ["one"]


def observed(spark, rows):
    """External observations (source_id, path, line, severity, evidence)."""
    import hashlib

    full = [("external-adapter", s, "k", "c", sev, "high", p, n, n, None, hashlib.sha256(e.encode()).hexdigest(), len(e)) for s, p, n, sev, e in rows]
    return spark.createDataFrame(full, "source_kind string, source_id string, kind string, category string, severity string, confidence string, path string, line int, end_line int, hunk string, evidence_digest string, evidence_length int")


def by_force(runs):
    """Incidents (subject, occurrence, status, opened, closed) of successive sets of {subject: fact}."""
    out, open_, times = [], {}, {}
    for n, now in enumerate(runs, 1):
        for s in sorted(set(open_) | set(now)):
            old = open_.get(s)
            if s in now and (old is None or old["fact"] != now[s]):
                if old:
                    old.update(status="superseded", closed=n)
                times[s] = times.get(s, 0) + 1
                open_[s] = {"subject": s, "fact": now[s], "n": times[s], "status": "open", "opened": n, "closed": None}
                out.append(open_[s])
            elif old and s not in now:
                old.update(status="resolved", closed=n)
                del open_[s]
    return sorted((o["subject"], o["n"], o["status"], o["opened"], o["closed"] or 0) for o in out)


def test_incidents_over_scans(spark, tmp_path):
    r = random.Random(4)
    runs = [[(f"r{r.randrange(4)}", f"f{r.randrange(5)}.py", r.randrange(1, 4), r.choice(["low", "high"]), f"e{r.randrange(3)}") for _ in range(25)] for _ in range(4)]
    log = incidentlog.IncidentLog(spark, f"{tmp_path}/incidents")
    for rows in runs:
        log.advance(external=observed(spark, rows), scope="repo")
    facts = []
    for rows in runs:
        now = {}
        for s, p, n, sev, e in rows:
            now.setdefault((s, p, e), set()).add((n, sev))
        facts.append(now)
    got = [x.asDict() for x in log.current().collect()]
    want = by_force(facts)
    assert sorted((x["occurrence"], x["status"], x["opened_run"], x["closed_run"] or 0) for x in got) == sorted(w[1:] for w in want)
    assert {x["status"] for x in got} == {"open", "resolved", "superseded"} and len({x["incident_id"] for x in got}) == len(got)
    chain = {x["incident_id"]: x for x in got}
    for x in got:
        if x["status"] == "superseded":
            after = chain[x["next_id"]]
            assert after["subject"] == x["subject"] and after["occurrence"] == x["occurrence"] + 1 and after["opened_run"] == x["closed_run"]
    kinds = {k: v for k, v in log.deltas(4).groupBy("kind").count().collect()}
    assert set(kinds) <= {"added", "removed", "changed"} and sum(kinds.values()) > 0
    # the same again changes nothing but the run that saw them last; another scope is left alone
    current = incidents.facts(incidents.observations(external=observed(spark, runs[-1])), "repo")
    again, deltas = incidents.merge(log.current(), current, 4, "repo")
    assert deltas.isEmpty() and again.exceptAll(log.current()).isEmpty()
    other, _ = incidents.merge(log.current(), incidents.facts(incidents.observations(external=observed(spark, [])), "else"), 5, "else")
    assert other.exceptAll(log.current()).isEmpty()


def test_incidents_of_findings_and_changes(spark, tmp_path, monkeypatch):
    log = incidentlog.IncidentLog(spark, f"{tmp_path}/incidents")
    text = lambda *lines: spark.createDataFrame([("src/a.py", 100, "\n".join(lines)), (".env", 10, "x")], "path string, length long, text string")
    run = lambda rows: scans.texts(rows)
    first = run(text(f"k = '{TOKEN}'"))
    log.advance(first.findings, first.changes, scope="repo")
    kinds = {r.source_kind: r for r in incidents.observations(first.findings, first.changes).collect()}
    assert set(kinds) == {"native-line-rule", "config-classifier"}
    assert kinds["config-classifier"].source_id == "config:modified:.env" and kinds["config-classifier"].line == 0
    assert TOKEN not in str([r.asDict() for r in log.current().collect()])
    moved = run(text("", "", f"k = '{TOKEN}'"))  # on another line: the subject is the same, the fact is not
    log.advance(moved.findings, moved.changes, scope="repo")
    assert sorted((r.status, r.occurrence) for r in log.current().collect()) == [("open", 1), ("open", 2), ("superseded", 1)]
    gone = run(text("nothing"))
    unread = spark.createDataFrame([("src/a.py",)], "path string")
    # a run that dies between its stage and its activation leaves the last one in force
    activate = log.store.activate
    monkeypatch.setattr(log.store, "activate", lambda name: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        log.advance(gone.findings, gone.changes, scope="repo")
    monkeypatch.setattr(log.store, "activate", activate)
    assert log.last_run() == 2
    assert log.advance(gone.findings, gone.changes, scope="repo", unread=unread) == 3  # the file could not be read
    assert log.current().where("status = 'open'").count() == 2
    assert log.advance(gone.findings, gone.changes, scope="repo") == 4
    assert sorted(r.status for r in log.current().collect()) == ["open", "resolved", "superseded"]


def test_external_observations_are_checked(spark):
    good = observed(spark, [("s", "a/b.py", 1, "high", "e")])
    bad = good.withColumn("source_kind", F.lit("native-line-rule")).unionByName(good.withColumn("path", F.lit("../x"))).unionByName(good.withColumn("severity", F.lit(None).cast("string"))).unionByName(good.withColumn("end_line", F.lit(0))).unionByName(good.withColumn("evidence_digest", F.lit("x")))
    kept, rejected = incidents.of_external(good.unionByName(bad))
    assert kept.count() == 1 and rejected.count() == 5 and rejected.where("reject_reason is null").isEmpty()
    with pytest.raises(ValueError):
        incidents.merge(incidents.none_yet(spark), incidents.facts(kept, "s"), 1, "s", summary="matched_text=x")


def test_kept_labels_equal_a_rebuild(spark, tmp_path):
    r = random.Random(8)
    kept = labels.Labels(spark, f"{tmp_path}/labels")
    all_ = []
    for batch in range(5):
        new = [(f"n{r.randrange(120):03}", f"n{r.randrange(120):03}") for _ in range(18)] + [(f"x{batch}", f"x{batch}")]
        all_ += new
        kept.add(spark.createDataFrame([*new, (None, "n001")], "a string, b string"))
        up = {}

        def find(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in all_:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        assert {(x.node, x.root) for x in kept.all().collect()} == {(n, find(n)) for n in list(up)}
    kept.compact()
    assert kept.all().count() == len(up) and len(kept.log.last()[1]["parts"]) == 1
    kept.add(spark.createDataFrame([("n000", "n119"), ("a", "n050")], "a string, b string"))
    assert kept.all().where("node = 'n050'").first().root == "a"


def test_kept_groups_equal_the_operator(spark, tmp_path):
    rows = [(f"ADV-{i}", [f"CVE-2020-{i % 11:04}", f" nat-{i % 7} ", "bad alias", None], "osv") for i in range(60)] + [("ADV-X", None, "osv"), ("ADV-Y", ["ADV-3"], "ghsa")]
    r = random.Random(1)
    r.shuffle(rows)
    kept = labels.Labels(spark, f"{tmp_path}/labels")
    frame = lambda some: spark.createDataFrame(some, "id string, aliases array<string>, source string")
    for i in range(0, len(rows), 20):
        kept.add_advisories(frame(rows[i : i + 20]))
    want = correlate.groups(correlate.alias_index(frame(rows)), frame(rows))
    assert {(x.root, x.advisory_id) for x in kept.groups().collect()} == {(x.root, x.advisory_id) for x in want.collect()}


def tree(depth, leaf):
    node = {"product": {"product_id": leaf, "product_identification_helper": {"purl": f"pkg:npm/{leaf}@1"}}}
    for _ in range(depth):
        node = {"branches": [node]}
    return node


def test_product_trees_of_any_depth(spark):
    docs = [{"product_tree": {"branches": [tree(d, f"p{d}"), tree(1, "q")]}} for d in (0, 1, 5, 6, 12, 40)]
    docs += [{"product_tree": {"full_product_names": [{"product_id": "f"}]}}, {"product_tree": {}}, {}]
    got = feeds.csaf_products(spark.createDataFrame([(json.dumps(d),) for d in docs] + [("nonsense",), (None,)], "record string"))
    assert sorted((x.product_id, x.purl) for x in got.collect()) == sorted([(f"p{d}", f"pkg:npm/p{d}@1") for d in (0, 1, 5, 6, 12, 40)] + [("q", "pkg:npm/q@1")] * 6 + [("f", None)])


def test_product_tree_of_two_hundred_levels(spark):
    rows = spark.createDataFrame([(json.dumps({"product_tree": tree(200, "deep")}),)], "record string")
    assert [(x.product_id, x.purl) for x in feeds.csaf_products(rows).collect()] == [("deep", "pkg:npm/deep@1")]


def test_include_closure(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    diamond = [("c00", "d1"), ("c00", "d2"), ("d1", "d3"), ("d2", "d3")]
    cycle = [("d3", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "z"), ("y", "out")]
    edges = spark.createDataFrame(chain + diamond + cycle + [(None, "q"), ("q", None), ("alone", "alone2"), ("alone2", "alone")] + chain[:3], "path string, target string")
    roots = spark.createDataFrame([("c00",), ("y",), ("none",), (None,)], "path string")
    got = manifests.closure(edges, roots).collect()
    read = {(g.root, g.path): g.depth for g in got if g.warning is None}
    assert read[("c00", "c30")] == 30 and read[("c00", "d3")] == 2 and read[("c00", "z")] == 5 and read[("none", "none")] == 0
    assert {g.path for g in got if g.root == "y" and g.warning is None} == {"y", "z", "x", "out"}
    assert {(g.root, g.path) for g in got if g.warning == "cycle"} == {("c00", "x"), ("c00", "z"), ("y", "y"), ("y", "z")}
    assert len(read) == len([g for g in got if g.warning is None])
    short = manifests.closure(edges, roots.where("path = 'c00'"), most=3).collect()
    assert {g.path for g in short if g.warning == "depth"} == {"c04", "y"} and max(g.depth for g in short if g.warning is None) == 3


def test_strongly_connected_parts_by_force(spark):
    r = random.Random(7)
    edges = sorted({(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}") for _ in range(45)})
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, front = set(), list(after.get(x, ()))
        while front:
            y = front.pop()
            if y not in seen:
                seen.add(y)
                front += after.get(y, ())
        return seen

    nodes = {n for e in edges for n in e}
    want = {frozenset(y for y in nodes if y in reach(x) and x in reach(y)) for x in nodes if x in reach(x)}
    got = {}
    for x in manifests.cyclic(spark.createDataFrame(edges, "path string, target string")).collect():
        got.setdefault(x.cycle, set()).add(x.node)
    assert {frozenset(v) for v in got.values()} == want and want


def test_an_update_that_is_killed_goes_on(spark, tmp_path, monkeypatch):
    vuln = lambda i: {"id": f"OSV-{i}", "modified": "2024", "aliases": [f"CVE-2024-{1000 + i}"], "affected": [{"package": {"ecosystem": "npm", "name": f"p{i}"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}]}]}
    (tmp_path / "osv.jsonl").write_text("\n".join(json.dumps(vuln(i)) for i in range(6)) + "\n\n")
    cve = {"dataType": "CVE_RECORD", "cveMetadata": {"cveId": "CVE-2024-9999", "state": "PUBLISHED", "datePublished": "2024", "dateUpdated": "2024"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": "text"}]}}}
    (tmp_path / "cve.json").write_text(json.dumps([cve]))
    kev = [{k: "x" for k in ("vendorProject", "product", "vulnerabilityName", "shortDescription", "requiredAction")} | {"cveID": c, "dateAdded": "2024-01-01", "dueDate": "2024-01-02"} for c in ("CVE-2024-1001", "CVE-1999-1000")]
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": kev}))
    metric = {"cvssMetricV31": [{"source": "n", "type": "Primary", "cvssData": {"version": "3.1", "baseScore": 7.5, "baseSeverity": "HIGH", "vectorString": "v"}}]}
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": [{"cve": {"id": f"CVE-2024-{n}", "lastModified": "2024", "published": "2024", "vulnStatus": "Analyzed", "metrics": metric}} for n in (1002, 5555)]}))
    ssvc = {"cveMetadata": {"cveId": "CVE-2024-1003"}, "containers": {"adp": [{"providerMetadata": {"shortName": "CISA-ADP"}, "metrics": [{"other": {"type": "ssvc", "content": {"options": [{"Exploitation": "active"}, {"Automatable": "yes"}, {"Technical Impact": "total"}]}}}]}]}}
    (tmp_path / "ssvc.jsonl").write_text(json.dumps(ssvc))
    paths = {"osv": "osv.jsonl", "cve-v5": "cve.json", "cisa-kev": "kev.json", "nvd": "nvd.json", "vulnrichment": "ssvc.jsonl"}
    s = stores.default_store(spark, f"{tmp_path}/db")
    update = lambda: updates.Update(s, "full", {k: f"{tmp_path}/{v}" for k, v in paths.items()}, "extended")
    load, calls = updates.load, []

    def dies(rows, source, index=None):
        calls.append(source)
        if source == "nvd" and calls.count("nvd") == 1:
            raise RuntimeError("killed")
        return load(rows, source, index)

    monkeypatch.setattr(updates, "load", dies)
    with pytest.raises(RuntimeError):
        update().run(apply=True)
    assert s.active() is None and set(update().done()) == {"osv", "cve-v5", "cisa-kev", "vulnrichment"}
    r = update().run(apply=True)
    assert r["made"] == ["nvd"] and s.active() == r["snapshot_id"] and calls.count("osv") == 1
    table = lambda n: s.table(s.active(), n)
    assert {x.id for x in table("advisories").collect()} == {*[f"OSV-{i}" for i in range(6)], "CVE-2024-9999"}
    assert [x.cve_id for x in table("kev").collect()] == ["CVE-2024-1001"] and table("kev_unresolved").count() == 1
    assert [x.cve_id for x in table("nvd_revisions").collect()] == ["CVE-2024-1002"] and table("nvd_unresolved").count() == 1 and table("vulnrichment").count() == 1
    assert update().run(apply=True)["made"] == []  # nothing is left to do
    with open(tmp_path / "osv.jsonl", "a") as f:
        f.write(json.dumps(vuln(7)) + "\n")
    assert "osv" in (again := update().run(apply=True))["made"] and "cve-v5" not in again["made"] and again["snapshot_id"] != r["snapshot_id"]
    (tmp_path / "kev.json").write_text('{"vulnerabilities": [{"cveID": "CVE-2024-1001"}]}')
    with pytest.raises(ValueError, match="cisa-kev"):
        update().run(apply=True)
    assert s.active() == again["snapshot_id"]


def test_history_reports_what_it_could_not_scan(spark):
    text = lambda path, line: f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,1 +1,2 @@\n keep\n+{line}\n"
    rows = spark.createDataFrame([("c3", 0, text("x.py", f"k = '{TOKEN}'")), ("c2", 1, text("y.py", "z" * 300_017)), ("c1", 2, "diff --git nonsense"), ("c0", 3, text(".env", f"k = '{TOKEN}'")), ("b9", 4, text(".env", f"k = '{TOKEN}'"))], "diff_id string, seq int, text string")
    r = scans.history(rows)
    assert sorted((x.seq, x.file) for x in r.findings.collect()) == [(0, "x.py"), (3, ".env")]
    assert len({x.reason for x in r.rejected.collect()}) == r.rejected.count() == 2  # a line that is too long, a diff that is none
    assert [(x.file, x.change_type) for x in r.changes.collect()] == [(".env", "modified")]
    counts = r.summary().first()
    assert counts.rejected_lines == 2 and counts.exit_code != 0
    base = r.findings.where("file = 'x.py'").select("fingerprint")
    after = scans.history(rows, baseline=base, config=scans.Config(config_check=False))
    assert [x.file for x in after.findings.collect()] == [".env"] and after.changes.isEmpty() and after.counters.first().suppressed == 1


def test_a_file_that_grew_is_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("small")
    (tmp_path / "b.txt").write_text("b")
    listed = files.listing(spark, str(tmp_path))
    listed.collect()
    (tmp_path / "a.txt").write_text("x" * (files.MAX_FILE_BYTES + 5))
    r = scans.texts(files.contents(listed, str(tmp_path)))
    assert [(x.path, x.n_chars, x.reason) for x in r.rejected.collect()] == [("a.txt", files.MAX_FILE_BYTES + 5, "file-exceeds-limit")]


RULES = [ContextRule("CRT-AI-900", "PAIR", "high", 4, (r"\bopen\b", r"\bclose\b"), ()), ContextRule("CRT-AI-901", "THREE", "low", 9, (r"^a", r"b$", r"c"), ()), ContextRule("CRT-AI-902", "OTHER", "low", 3, (r"open", r"a"), ("*.yml",))]


def test_sequences_equal_the_batch_operator(spark):
    r = random.Random(3)
    word = lambda: r.choice(["open it", "close it", "a b", "c", "a c b", "none", "open close", "b"])
    rows = [(f"f{f}.{'yml' if f % 2 else 'py'}", h, n, word()) for f in range(6) for h in range(3) for n in range(1, 30)]
    lines = spark.createDataFrame(rows, "path string, hunk int, line bigint, content string")
    want = context.context_matches(lines, RULES, ["path", "hunk"])
    by = {}
    for x in context.component_lines(lines, RULES, ["path", "hunk"]).collect():
        by.setdefault((x.path, x.hunk, x.rule), []).append((x.line, list(x.parts), x.content))
    got = {(p, h, RULES[k].rule_id, line, tuple(more)) for (p, h, k), held in by.items() for line, _, more in ordered.sequences(held, RULES[k].span, len(RULES[k].patterns))}
    assert got == {(x.path, x.hunk, x.rule_id, x.line, tuple(x.components[1:])) for x in want.collect()} and len(got) > 50


def test_a_replayed_stream_equals_the_batch(spark, tmp_path):
    """Lines in any order, some twice, over two starts of the query."""
    r = random.Random(5)
    word = lambda: r.choice(["open it", "close it", "a b", "c", "a c b", "none"])
    base = 1_700_000_000
    rows = [(f"f{f}.py", h, n, word(), base + f * 30 + r.randrange(20)) for f in range(5) for h in range(2) for n in range(1, 25)]
    rows += [("f1.py", 0, 99, "open " + "z" * 300_000, base + 40)]
    shape = "path string, hunk int, line bigint, content string, at timestamp"
    stamped = lambda some: spark.createDataFrame(some, "path string, hunk int, line bigint, content string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    sent = [*rows, *r.sample(rows, 40)]
    r.shuffle(sent)
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    before = spark.conf.get(ordered.STORE[0], None)
    spark.conf.set(*ordered.STORE)
    try:
        for part in (sent[:100], sent[100:180], sent[180:], [("end", 0, 1, "open", base + 100_000)], [("end", 1, 1, "open", base + 200_000)]):
            stamped(part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
            found = ordered.stream_matches(stream, RULES, "1 hour").withColumn("components", F.col("components").cast("string"))
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()  # each start goes on from the last
        rejected = ordered.stream_rejected(spark.readStream.schema(shape).parquet(source))
        rejected.writeStream.format("parquet").option("path", f"{out}2").option("checkpointLocation", f"{check}2").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ordered.STORE[0]) if before is None else spark.conf.set(ordered.STORE[0], before)
    lines = stamped(rows).where(F.char_length("content") <= scans_of_lines.MAX_LINE_CHARS)
    want = context.context_matches(lines.drop("at"), RULES, ["path", "hunk"]).withColumn("components", F.col("components").cast("string"))
    columns = ("path", "hunk", "rule_id", "severity", "line", "matched_text", "line_content", "components")
    assert sorted(map(tuple, spark.read.parquet(out).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert want.count() > 20
    assert {(x.path, x.line, x.reason) for x in spark.read.parquet(f"{out}2").collect()} == {("f1.py", 99, "line-exceeds-limit")}
