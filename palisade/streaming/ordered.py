"""Ordered rules over a stream of lines.

Lines of a file's hunk may come in any order and in any batch. Of each hunk the lines that hold a part of a
rule are kept as state, each once; when the watermark has passed the hunk's last line, a timer finds its
matches, as the batch operator does, and the state goes. What is kept is thus bounded by the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.functions.registry import ContextRule, builtin_context_rules
from palisade.operators import context, scan

#: The state store that keeps maps and timers; a session's setting before its first query.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Lines of a hunk whose parts of rules are one value of its state.
PAGE = 256


def sequences(held: list[tuple[int, list[int], str | None]], span: int, parts: int) -> list[tuple[int, str | None, list[int]]]:
    """(line, content, further lines) of a rule's matches among its lines (line, parts, content), as ``context_matches`` tells them."""
    held = sorted(held, key=lambda x: (x[0], x[1]))
    best: dict[tuple[int, ...], tuple[int, str | None]] = {}
    for i, (anchor, own, content) in enumerate(held):
        if 0 not in own:
            continue
        got: list[int] = []
        for line, has, _ in held[i + 1 : i + 1 + span]:
            last = got[-1] if got else anchor
            if len(got) < parts - 1 and line > last and line - anchor <= span and len(got) + 1 in has:
                got.append(line)
        if len(got) == parts - 1 and (tuple(got) not in best or best[tuple(got)][0] > anchor):
            best[tuple(got)] = (anchor, content)
    return [(line, content, list(got)) for got, (line, content) in best.items()]


class HunkRules(StatefulProcessor):
    """The lines of one hunk that hold a part of a rule, until the watermark passes its last.

    Each call of the state is a message to the JVM, so lines are kept in pages of PAGE lines of a hunk: a batch reads and
    writes a page once, however many of its lines come, and the pages that it has no line of stay as they are. The first page
    that came stands with the hunk's time in its head, so most hunks have no other value.
    """

    def __init__(self, shapes: list[tuple[int, int]]) -> None:
        self.shapes = shapes  # span and number of patterns of each rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lines = "rules array<int>, lines array<bigint>, parts array<array<int>>, contents array<string>"
        self.head = handle.getValueState("head", f"at bigint, more boolean, page bigint, {lines}")
        self.pages = handle.getMapState("pages", "page bigint", lines)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new: dict[int, dict[tuple[int, int], tuple[list[int], str | None]]] = {}
        latest = None
        for r in rows:
            new.setdefault(r.line // PAGE, {})[r.rule, r.line] = (list(r.parts), r.content)
            latest = r.ms if latest is None else max(latest, r.ms)
        head = self.head.get()
        at, more, first, *held = head or (None, False, min(new))
        own = _merged(held or None, new.pop(first, {}))
        for page, lines in new.items():
            self.pages.updateValue((page,), _merged(self.pages.getValue((page,)) if more else None, lines))
        latest = latest if at is None else max(at, latest)
        if latest != at:
            if at is not None:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(latest)
        self.head.update((latest, more or bool(new), first, *own))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        _, more, _, *own = self.head.get()
        by: dict[int, list[tuple[int, list[int], str | None]]] = {}
        for page in (own, *(self.pages.values() if more else ())):
            for rule, line, parts, content in zip(*page, strict=True):
                by.setdefault(rule, []).append((line, list(parts), content))
        out = [(rule, *m) for rule, held in by.items() for m in sequences(held, *self.shapes[rule])]
        self.head.clear()
        if more:
            self.pages.clear()
        for rule, line, content, got in out:
            yield Row(path=key[0], hunk=key[1], rule=rule, line=line, content=content, got=got)

    def close(self) -> None:
        pass


def _merged(held: Sequence[Sequence] | None, new: dict[tuple[int, int], tuple[list[int], str | None]]) -> tuple[list, list, list, list]:
    """A page's rules, lines, parts and contents with those of a batch, each (rule, line) once."""
    if held is not None:
        new = {(rule, line): (list(parts), content) for rule, line, parts, content in zip(*held, strict=True)} | new
    return [k[0] for k in new], [k[1] for k in new], [v[0] for v in new.values()], [v[1] for v in new.values()]


def stream_matches(lines: DataFrame, rules: list[ContextRule] | None = None, late: str = "10 minutes") -> DataFrame:
    """Matches of ordered rules over a stream of lines (path, hunk, line, content, at): path, hunk, rule_id, pattern_name,
    severity, line, matched_text, line_content, components.

    A hunk's matches come when the watermark, ``late`` behind the latest line, has passed its last line. A line that
    comes twice counts once. A line that comes behind the watermark is left out; the query's progress
    counts such lines (numRowsDroppedByWatermark). Lines over the limit are left out; ``stream_rejected`` reports them.
    The session must keep state in STORE.
    """
    rules = builtin_context_rules() if rules is None else rules
    kept = lines.where(F.char_length("content") <= scan.MAX_LINE_CHARS).withWatermark("at", late)
    hits = context.component_lines(kept.withColumn("ms", F.unix_millis("at")), rules, ["path", "hunk", "at", "ms"])
    hits = hits.withColumn("content", F.when(F.array_contains("parts", 0), F.col("content")))
    shapes = [(r.span, len(r.patterns)) for r in rules]
    found = hits.groupBy("path", "hunk").transformWithState(HunkRules(shapes), "path string, hunk int, rule int, line bigint, content string, got array<int>", "Append", "EventTime")
    return context.described(found, rules, ["path", "hunk"])


def stream_rejected(lines: DataFrame) -> DataFrame:
    """(path, line, n_chars, reason, at) of a stream's lines that no scan reads; it makes the result of a stream incomplete."""
    n = F.char_length("content")
    return lines.where(n > scan.MAX_LINE_CHARS).select("path", "line", n.alias("n_chars"), F.lit("line-exceeds-limit").alias("reason"), "at")
