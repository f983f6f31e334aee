"""Faults that the third review found, last part."""

import re

from pyspark.sql import Row

from palisade.operators import vuln
from palisade.streaming import ordered


def test_members_of_packs_are_dealt_to_many_tasks(spark):
    none = "cast(null as string)"
    c = spark.range(40).selectExpr("'composer' as ecosystem", "concat('m', id % 4) as name", "concat('1.', id % 5, '.0') as version", f"{none} as purl", "'lock' as manifest_path")
    p = spark.range(60).selectExpr("concat('A', id) as advisory_id", "'composer' as ecosystem", "concat('m', id % 4) as name", "array('C-1') as aliases", f"{none} as withdrawn", "'osv' as source", "array('1.4.0') as versions", f"array(array(named_struct('introduced', '1.1.0', 'fixed', {none}, 'last_affected', {none}))) as ranges")
    m = vuln.match(c, p).select("version", "advisory_id")
    plan = m._jdf.queryExecution().executedPlan().toString()
    # before, versions met the members of packages alike in as many tasks as the sizes of the small rows asked for: in one
    assert len(re.findall(r"hashpartitioning\(package#\d+L?, pack#\d+, \d+\), REPARTITION_BY_NUM", plan)) == 2
    assert m.count() == sum(1 for k in range(40) for a in range(60) if k % 4 == a % 4 and k % 5 > 0)


class _State:
    """A value or map of a hunk, with the messages that it would send."""

    def __init__(self):
        self.at, self.calls = {}, 0

    def _sent(self, value=None):
        self.calls += 1
        return value

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        return self._sent(self.at.get(key))

    def updateValue(self, key, value):
        self._sent(self.at.update({key: value}))

    def values(self):
        return self._sent(list(self.at.values()))

    def clear(self):
        self._sent(self.at.clear())


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def _state(self, name, *_):
        return self.states.setdefault(name, _State())

    getValueState = getMapState = _state

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_lines_of_a_hunk_are_kept_in_pages():
    rules = ordered.HunkRules([(3, 2), (5000, 2)])
    handle = _Handle()
    rules.init(handle)
    calls = lambda: sum(s.calls for s in handle.states.values())
    row = lambda line, parts, ms, rule=0: Row(path="a", hunk=0, ms=ms, line=line, content="x" if 0 in parts else None, rule=rule, parts=parts)
    rules.handleInputRows(("a", 0), iter([row(n, [n % 2], 5) for n in range(200)]), None)
    assert calls() == 2  # before, a message for each line
    rules.handleInputRows(("a", 0), iter([row(7, [1], 4), row(7, [1], 9), row(2000, [0], 3), row(2001, [1], 3), row(4000, [1], 2, 1)]), None)
    rules.handleInputRows(("a", 0), iter([row(0, [0], 1, 1), row(2001, [1], 1), row(10, [0, 1], 1)]), None)
    assert handle.timers == [9]
    assert calls() == 2 + 4 + 4  # head read and written, two pages written; head, and one page read and written
    got = {(r.rule, r.line, r.content, tuple(r.got)) for r in rules.handleExpiredTimer(("a", 0), None, None)}
    assert got == {*[(0, n, "x", (n + 1,)) for n in range(0, 200, 2)], (0, 2000, "x", (2001,)), (1, 0, "x", (4000,))}
    assert not any(s.at for s in handle.states.values())
