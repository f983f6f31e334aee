"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines.

States are roles, observations are lines: a speaker marker and features such as a question
mark, code or length. Viterbi's path gives every line a role; runs of a role are rendered as turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, numbered

ROLES = ("system", "user", "assistant")
#: Names of speakers and their roles (fixed values).
NAMES = {
    "system": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "prompter": 1, "customer": 1, "question": 1, "instruction": 1, "q": 1, "you": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "chatgpt": 2, "model": 2, "agent": 2, "response": 2, "answer": 2, "a": 2,
}
_NAMED = "|".join(sorted(NAMES, key=lambda n: (-len(n), n)))
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*(?P<t>{_NAMED})\s*(?:\|>)?\s*|(?:#{{1,4}}\s*|\*\*|\[)?(?P<n>{_NAMED})(?:\*\*|\])?\s*:(?:\*\*)?(?=\s|$)\s*|#{{2,4}}\s*(?P<h>{_NAMED})\s*$|\[(?P<b>{_NAMED})\]\s*)", re.IGNORECASE)
#: Turns whose lines one task decodes together; longer conversations are joined exactly by the scores of their parts.
CHUNK = 256
#: How likely a marker names the true role, and a new role starts inside a turn without one (documented parameters).
MARKED, SWITCH = 0.98, 0.01
BUCKETS = (0, 20, 80, 200, 500)
CODE = re.compile(r"\s*(```|def |class |import |#include|[{}<]|\$ )")
#: Log probabilities by role, and of a move [from][to].
Row = tuple[float, ...]
Table = tuple[Row, ...]


def _order() -> list[Column]:
    """Order of a conversation's turns."""
    return [F.col(c).asc_nulls_first() for c in ("turn", "text", "role")]


def marker(line: str) -> tuple[int | None, str]:
    """(role that a line's marker names, the line without it)."""
    m = MARKER.match(line) if ":" in line or "<|" in line or "#" in line or "[" in line else None
    if not m:
        return None, line
    return NAMES[next(g for g in m.groups() if g).lower()], line[m.end() :]


def features(line: str) -> tuple[int, int, int]:
    """(ends in or holds a question mark, looks like code, length class)."""
    code = CODE.match(line) is not None or line.endswith((";", "{", "}"))
    return int("?" in line), int(code), sum(len(line) > b for b in BUCKETS)


#: The same features of a column, for counting.
def _counted(line: F.Column) -> list[F.Column]:
    code = line.rlike(r"^\s*(```|def |class |import |#include|[{}<]|\$ )") | line.rlike("[;{}]$")
    length = sum((F.length(line) > b).cast("int") for b in BUCKETS)
    return [F.contains(line, F.lit("?")).cast("int").alias("q"), code.cast("int").alias("c"), length.alias("l")]


class Model:
    """Log probabilities: start, between turns, and of each feature by role."""

    def __init__(self, start: np.ndarray, turn: np.ndarray, emit: list[np.ndarray]) -> None:
        norm = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True))
        n = len(ROLES)
        rows = lambda x: tuple(tuple(r) for r in x.tolist())
        self.start, self.turn, self.emit = tuple(norm(start).tolist()), rows(norm(turn)), [rows(norm(e)) for e in emit]
        self.stay = rows(np.log(np.full((n, n), SWITCH) + np.eye(n) * (1 - n * SWITCH)))
        self.free = rows(np.log(np.full((n, n), 1 / n)))
        self.mark = rows(np.log(np.full((n, n), (1 - MARKED) / (n - 1)) + np.eye(n) * (MARKED - (1 - MARKED) / (n - 1))))
        self.seen: dict[tuple, Row] = {}

    def line(self, named: int | None, said: int | None, line: str) -> Row:
        """Log probability by role of a line whose marker names ``named`` and whose turn's role column says ``said``."""
        key = (named, said, *features(line))
        if (out := self.seen.get(key)) is None:
            told = [x for x in (named, said) if x is not None]
            out = self.seen[key] = tuple(sum(self.mark[s][t] for t in told) + sum(e[s][f] for e, f in zip(self.emit, key[2:], strict=True)) for s in range(len(ROLES)))
        return out


def fit(turns: DataFrame) -> Model:
    """Counts over all turns (conv_id, chunk, low, turn, role, text) whose role is a known name; a few
    hundred counts reach the driver. A conversation starts with the first turn of its chunk ``low``."""
    known = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])
    rows = turns.select("conv_id", "chunk", "low", "turn", "text", "role", F.try_element_at(known, F.lower(F.trim("role"))).alias("r"))
    n = len(ROLES)
    start, turn = np.zeros(n), np.zeros((n, n))
    w = Window.partitionBy("conv_id", "chunk").orderBy(*_order())
    moved = rows.withColumn("p", F.lag("r").over(w)).withColumn("first", (F.row_number().over(w) == 1) & (F.col("chunk") == F.col("low")))
    for r in moved.where("r is not null").groupBy("p", "r", "first").count().collect():
        if r["first"]:
            start[r["r"]] += r["count"]
        elif r["p"] is not None:
            turn[r["p"], r["r"]] += r["count"]
    emit = [np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, len(BUCKETS) + 1))]
    lines = rows.where("r is not null").select("r", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    for r in lines.select("r", *_counted(F.col("line"))).groupBy("r", "q", "c", "l").count().collect():
        for e, f in zip(emit, ("q", "c", "l"), strict=True):
            e[r["r"], r[f]] += r["count"]
    return Model(start, turn, emit)


def observe(model: Model, texts: list[str | None], roles: list[str | None]) -> tuple[list[tuple[int, str]], list[Row], list[Table]]:
    """Of the lines of some turns: (turn, line without marker), emissions, and transitions into each."""
    lines: list[tuple[int, str]] = []
    emissions, moves = [], []
    for i, (text, role) in enumerate(zip(texts, roles, strict=True)):
        said = NAMES.get((role or "").strip().lower())
        for k, raw in enumerate((text or "").split("\n")):
            named, line = marker(raw)
            lines.append((i, line))
            emissions.append(model.line(named, said if k == 0 and named is None else None, line))
            moves.append(model.turn if k == 0 else model.free if named is not None else model.stay)
    return lines, emissions, moves


def _step(score: list[float], e: Row, m: Table) -> tuple[list[float], list[int]]:
    """Scores after one more line, and the state that each best way comes from (the first of equals)."""
    new, back = [], []
    for j, own in enumerate(e):
        best, at = score[0] + m[0][j], 0
        for i in range(1, len(score)):
            if (x := score[i] + m[i][j]) > best:
                best, at = x, i
        new.append(best + own)
        back.append(at)
    return new, back


def _add(a: Row, b: Row) -> list[float]:
    return [x + y for x, y in zip(a, b, strict=True)]


def viterbi(model: Model, emissions: list[Row], moves: list[Table], before: int | None = None, last: int | None = None) -> list[int]:
    """States of the best path, of equally good ones that of the least states from the end; before is the
    state ahead of the first line, last that of the last, if known."""
    score = _add(emissions[0], model.start if before is None else moves[0][before])
    back = []
    for e, m in zip(emissions[1:], moves[1:], strict=True):
        score, ways = _step(score, e, m)
        back.append(ways)
    path = [max(range(len(score)), key=score.__getitem__) if last is None else last]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def through(model: Model, emissions: list[Row], moves: list[Table], first: bool) -> list[list[float]]:
    """Best scores [state before, state of the last line] of the ways through a chunk."""
    out = []
    for s in range(len(ROLES)):
        score = _add(emissions[0], model.start if first else moves[0][s])
        for e, m in zip(emissions[1:], moves[1:], strict=True):
            score, _ = _step(score, e, m)
        out.append(score)
    return out


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of rows that agree in conv and chunk, of sorted batches. conv and turn are texts, as numbers
    beside nulls would become floats."""
    held: list[pd.DataFrame] = []
    at = None
    for pdf in batches:
        conv, chunk = pdf["conv"].fillna("\x00").to_numpy(object), pdf["chunk"].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])))) if len(pdf) else []
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            own = (conv[a], chunk[a])
            if held and own != at:
                yield pd.concat(held)
                held = []
            at = own
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held)


def _as_text(rows: DataFrame) -> DataFrame:
    """rows with conv_id and turn as texts conv and turn."""
    return rows.withColumn("conv", F.col("conv_id").cast("string")).withColumn("turn", F.col("turn").cast("string")).drop("conv_id")


def _none(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def format_chats(turns: DataFrame) -> DataFrame:
    """The turns of all conversations as (conv_id, turn, part, role, text, rendered, copies).

    Lines of a turn's text and, as the marker of its first line, its role column if that names a
    speaker, are decoded along the conversation in order of turn, then text. Lines of one role in
    a turn are one part, stripped of markers and closing white space, and rendered as
    ``<|role|>\\ntext<|end|>\\n``. Null texts are one empty line; null turns come first; rows
    with a null conv_id are one conversation; repeated rows are one turn, counted in copies; a
    very long turn is decoded whole. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "rows")
    # longer conversations are dealt by place, whatever their turns are
    many = materialize(rows.groupBy("conv_id").count().where(F.col("count") > CHUNK).select(F.col("conv_id").alias("c"), F.lit(True).alias("is_long")), "many")
    rows = rows.join(maybe_broadcast(many, many.count()), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    short = rows.where("is_long is null").drop("is_long").withColumn("chunk", F.lit(0).cast("long")).withColumn("low", F.lit(0).cast("long"))
    long_ = None
    if not many.isEmpty():
        placed = numbered(rows.where("is_long").drop("is_long"), F.col("conv_id").asc_nulls_first(), *_order())
        placed = materialize(placed.withColumn("chunk", F.floor(F.col("__n") / CHUNK)).drop("__n"), "placed")
        lows = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("chunk").alias("low"))
        long_ = placed.join(maybe_broadcast(lows, many.count()), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    rows = materialize(short if long_ is None else short.unionByName(long_), "turns")
    model = fit(rows)
    order = [F.col("conv_id").asc_nulls_first(), F.col("chunk"), *_order()]
    ends = None
    if long_ is not None:
        parts = long_.withColumn("is_first", F.col("chunk") == F.col("low")).drop("low")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in _groups(batches):
                _, e, m = observe(model, g["text"].tolist(), g["role"].tolist())
                yield pd.DataFrame({"conv": g["conv"].iloc[:1], "chunk": g["chunk"].iloc[:1], "m": [sum(through(model, e, m, bool(g["is_first"].iloc[0])), [])]})

        scored = _as_text(parts.repartition("conv_id", "chunk").sortWithinPartitions(*order)).mapInPandas(score, "conv string, chunk long, m array<double>")

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            n, total, back = len(ROLES), np.zeros(len(ROLES)), []
            for i, m in enumerate(pdf["m"]):
                ways = np.array(m).reshape(n, n) if i == 0 else total[:, None] + np.array(m).reshape(n, n)
                back.append(ways.argmax(axis=0))
                total = ways.max(axis=0)
            last = [int(total.argmax())]
            for b in reversed(back[1:]):
                last.append(int(b[last[-1]]))
            last = last[::-1]
            return pd.DataFrame({"k": pdf["conv"], "n": pdf["chunk"], "before": [None, *last[:-1]], "last": last}).astype({"before": "Int32"})

        ends = materialize(scored.groupBy("conv").applyInPandas(join, "k string, n long, before int, last int"), "ends")
    rows = rows.drop("low")
    if ends is None:
        rows = rows.withColumn("before", F.lit(None).cast("int")).withColumn("last", F.lit(None).cast("int"))
    else:
        rows = rows.join(ends, F.col("conv_id").cast("string").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("n")), "left").drop("k", "n")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            lines, e, m = observe(model, g["text"].tolist(), g["role"].tolist())
            path = viterbi(model, e, m, _none(g["before"].iloc[0]), _none(g["last"].iloc[0]))
            out: list[tuple[int, int, str, list[str]]] = []
            for (i, line), state in zip(lines, path, strict=True):
                if out and out[-1][0] == i and out[-1][2] == ROLES[state]:
                    out[-1][3].append(line)
                else:
                    out.append((i, out[-1][1] + 1 if out and out[-1][0] == i else 0, ROLES[state], [line]))
            own = g.iloc[[o[0] for o in out]]
            texts = ["\n".join(x.rstrip() for x in o[3]).rstrip() for o in out]
            yield pd.DataFrame({
                "conv": own["conv"].to_numpy(), "turn": own["turn"].to_numpy(), "part": [o[1] for o in out], "role": [o[2] for o in out],
                "text": texts, "rendered": [f"<|{o[2]}|>\n{t}<|end|>\n" for o, t in zip(out, texts, strict=True)], "copies": own["copies"].to_numpy(),
            })

    kinds = dict(rows.dtypes)
    dealt = _as_text(rows.repartition("conv_id", "chunk").sortWithinPartitions(*order))
    out = dealt.mapInPandas(decode, "conv string, turn string, part int, role string, text string, rendered string, copies long")
    return out.select(F.col("conv").cast(kinds["conv_id"]).alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"), "part", "role", "text", "rendered", "copies")
