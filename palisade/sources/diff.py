"""Unified diffs to files and lines.

A diff's grammar is sequential, so one task walks each diff; all that follows is columns. A diff
that is malformed or too large gives one row with a reject_reason instead of failing the job.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_LINE, MAX_FILES, MAX_PATH = 4 * 1024 * 1024, 256 * 1024, 1024, 4096
#: Digits of git's base85 (fixed value).
BASE85 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"
NULL = "/dev/null"


class Malformed(ValueError):
    """What is wrong with a diff."""


@dataclass
class File:
    source: str
    target: str
    headed: bool = False
    binary: bool = False
    modes: dict[str, str] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)
    lines: list[tuple[int, str, int, str]] = field(default_factory=list)

    @property
    def operation(self) -> str:
        if self.source == NULL:
            return "create"
        if self.target == NULL:
            return "delete"
        return "modify" if self.source == self.target else "rename"


def clean_path(raw: str, prefixed: bool = True) -> str:
    """A path of a header: without a/ or b/, relative, inside its root."""
    raw = raw.split("\t")[0]
    if raw == NULL:
        return raw
    if prefixed and raw[:2] in ("a/", "b/"):
        raw = raw[2:]
    parts = raw.split("/")
    if not raw or len(raw) > MAX_PATH or raw[0] in '/"' or "\\" in raw or "\x00" in raw or ".." in parts or re.match("[A-Za-z]:", raw):
        raise Malformed("unsafe path")
    return raw


def base85_line(line: str) -> bytes:
    """A line of a git binary patch: a letter for the length, then groups of five digits."""
    if not line or not line[0].isalpha() or not line[0].isascii():
        raise Malformed("bad base85 length")
    n = ord(line[0]) - 64 if line[0].isupper() else ord(line[0]) - 70
    body = line[1:]
    if len(body) % 5 or len(body) // 5 != -(-n // 4):
        raise Malformed("bad base85 line")
    out = b""
    for i in range(0, len(body), 5):
        value = 0
        for ch in body[i : i + 5]:
            at = BASE85.find(ch)
            if at < 0:
                raise Malformed("bad base85 digit")
            value = value * 85 + at
        if value >= 1 << 32:
            raise Malformed("base85 overflow")
        out += struct.pack(">I", value)
    return out[:n]


def _size(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("bad delta size")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def check_delta(data: bytes) -> None:
    """Walks a delta's copies and inserts; their sizes must add up to the result's."""
    source, at = _size(data, 0)
    target, at = _size(data, at)
    made = 0
    while at < len(data):
        op = data[at]
        at += 1
        if op & 128:
            args = [0] * 7
            for i in range(7):
                if op >> i & 1:
                    if at >= len(data):
                        raise Malformed("short delta copy")
                    args[i] = data[at]
                    at += 1
            offset = sum(b << 8 * i for i, b in enumerate(args[:4]))
            n = sum(b << 8 * i for i, b in enumerate(args[4:])) or 0x10000
            if offset + n > source:
                raise Malformed("delta copy outside its source")
            made += n
        elif op:
            made, at = made + op, at + op
            if at > len(data):
                raise Malformed("short delta insert")
        else:
            raise Malformed("reserved delta operation")
    if made != target:
        raise Malformed("delta of another size")


def check_binary(kind: str, size: int, chunks: list[bytes]) -> None:
    if not chunks:
        raise Malformed("empty binary block")
    try:
        d = zlib.decompressobj()
        raw = d.decompress(b"".join(chunks), size + 1)
    except zlib.error as e:
        raise Malformed("binary block is not compressed") from e
    if len(raw) != size or not d.eof or d.unused_data:
        raise Malformed("binary block of another size")
    if kind == "delta":
        check_delta(raw)


class Walker:
    """Reads a diff line by line; ``files`` holds what is complete."""

    def __init__(self) -> None:
        self.files: list[File] = []
        self.now: File | None = None
        self.left = [0, 0]
        self.number = [0, 0]
        self.hunk = 0
        self.structural = False
        self.block: list | None = None  # of a binary patch: kind, size, chunks

    def need(self) -> File:
        if self.now is None:
            raise Malformed("metadata or hunk without a file")
        return self.now

    def close(self) -> None:
        f, self.now = self.now, None
        if f is None:
            return
        if f.source == f.target == NULL:
            raise Malformed("both paths are /dev/null")
        op, old, new = f.operation, f.modes.get("old"), f.modes.get("new")
        if op == "rename" and f.renames != {"from": f.source, "to": f.target} or f.renames and f.renames != {"from": f.source, "to": f.target}:
            raise Malformed("paths and rename metadata disagree")
        if op in ("modify", "rename") and (old is None) != (new is None) or op == "create" and old or op == "delete" and new:
            raise Malformed("mode metadata does not fit")
        if len(self.files) >= MAX_FILES:
            raise Malformed("too many files")
        self.files.append(f)

    def open(self, source: str, target: str) -> None:
        self.close()
        self.now = File(source, target)

    def body(self, line: str) -> None:
        """A line of a hunk."""
        f = self.need()
        kind = {"+": "added", "-": "removed", " ": "context"}.get(line[:1])
        takes = {"added": (0, 1), "removed": (1, 0), "context": (1, 1)}.get(kind or "")
        if line == "\\ No newline at end of file":
            return
        if takes is None or any(t > n for t, n in zip(takes, self.left, strict=True)):
            raise Malformed("malformed hunk")
        f.lines.append((self.hunk, kind, self.number[0 if kind == "removed" else 1], line[1:]))
        for i in (0, 1):
            self.left[i] -= takes[i]
            self.number[i] += takes[i]

    def patch(self, line: str) -> bool:
        """A line of a binary patch; false if it ends it."""
        if line.startswith("diff --git "):
            self.end_patch()
            return False
        if m := re.fullmatch("(literal|delta) ([0-9]+)", line):
            if self.block:
                check_binary(*self.block)
            self.block = [m[1], int(m[2]), []]
        elif line:
            if not self.block:
                raise Malformed("binary payload without a block")
            self.block[2].append(base85_line(line))
        return True

    def end_patch(self) -> None:
        if not self.block:
            raise Malformed("incomplete binary patch")
        check_binary(*self.block)
        self.block = None

    def read(self, text: str) -> list[File]:
        if len(text.encode("utf-8", "replace")) > MAX_BYTES:
            raise Malformed("diff too large")
        if not text:
            return []
        lines = re.split("\r\n|\r|\n", text)
        if any(len(x) > MAX_LINE for x in lines):
            raise Malformed("line too long")
        in_patch, at = False, 0
        while at < len(lines):
            line, nxt = lines[at], lines[at + 1] if at + 1 < len(lines) else ""
            at += 1
            if in_patch and (in_patch := self.patch(line)):
                continue
            if any(self.left):
                self.body(line)
            elif line == "\\ No newline at end of file":
                self.need()
            elif line.startswith("--- ") and nxt.startswith("+++ "):
                self.header(clean_path(line[4:]), clean_path(nxt[4:]))
                at += 1
            elif line:
                in_patch = self.meta(line)
        if in_patch:
            self.end_patch()
        if any(self.left):
            raise Malformed("incomplete hunk")
        self.close()
        if not self.structural:
            raise Malformed("not a unified diff")
        return self.files

    def header(self, source: str, target: str) -> None:
        self.structural = True
        f = self.now
        if f is None or f.headed:
            self.open(source, target)
        elif source not in (NULL, f.source) or target not in (NULL, f.target):
            raise Malformed("headers disagree")
        else:
            f.source, f.target = source, target
        self.need().headed = True

    def meta(self, line: str) -> bool:
        """A line outside hunks; true if a binary patch begins."""
        if line.startswith(("similarity index ", "index ")):
            return False
        self.structural = True
        if m := re.fullmatch("diff --git a/(.+) b/(.+)", line):
            if " b/" in m[1] or '"' in line:
                raise Malformed("ambiguous header")
            self.open(clean_path(m[1], False), clean_path(m[2], False))
        elif m := re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*", line):
            self.need()
            self.number, self.left = [int(m[1]), int(m[3])], [int(m[2] or 1), int(m[4] or 1)]
            if any(s == 0 and n for s, n in zip(self.number, self.left, strict=True)):
                raise Malformed("hunk starts at zero")
            self.hunk += 1
        elif m := re.fullmatch("(?:(old|new) mode|(new|deleted) file mode) ([0-7]{6})", line):
            f = self.need()
            side = m[1] or {"new": "new", "deleted": "old"}[m[2]]
            if side in f.modes:
                raise Malformed("repeated mode")
            f.modes[side] = m[3]
            if m[2] == "new":
                f.source = NULL
            elif m[2] == "deleted":
                f.target = NULL
        elif m := re.fullmatch("rename (from|to) (.+)", line):
            self.need().renames[m[1]] = clean_path(m[2], False)
        elif m := re.fullmatch("Binary files (.+) and (.+) differ", line):
            f = self.need()
            for name, said in (("source", clean_path(m[1])), ("target", clean_path(m[2]))):
                if said not in (getattr(f, name), NULL):
                    raise Malformed("headers disagree")
                setattr(f, name, said)
            f.binary = True
        elif line == "GIT binary patch":
            self.need().binary, self.block = True, None
            return True
        else:
            raise Malformed("unknown line")
        return False


def parse(text: str) -> list[File]:
    return Walker().read(text)


_SCHEMA = "diff_id string, path string, source_path string, target_path string, operation string, is_binary boolean, old_mode string, new_mode string, lines array<struct<hunk:int,line_type:string,line:int,content:string>>, reject_reason string"


def diff_files(diffs: DataFrame) -> DataFrame:
    """Files of each diff (diff_id, text), or one row with its reject_reason. A null text is empty."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for diff_id, text in zip(pdf["diff_id"], pdf["text"], strict=True):
                try:
                    out += [
                        (diff_id, f.source if f.operation == "delete" else f.target, f.source, f.target, f.operation, f.binary, f.modes.get("old"), f.modes.get("new"),
                         [dict(zip(("hunk", "line_type", "line", "content"), x, strict=True)) for x in f.lines], None)
                        for f in parse(text or "")
                    ]
                except Malformed as e:
                    out.append((diff_id, None, None, None, None, None, None, None, [], str(e)))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in re.split(r", (?=[a-z_]+ [a-z])", _SCHEMA)])

    return diffs.select(F.col("diff_id").cast("string").alias("diff_id"), "text").mapInPandas(walk, _SCHEMA)


def diff_lines(files: DataFrame) -> DataFrame:
    """(diff_id, path, operation, hunk, line_type, line, content) of diff_files."""
    each = files.where("reject_reason is null").select("diff_id", "path", "operation", F.explode("lines").alias("x"))
    return each.select("diff_id", "path", "operation", "x.hunk", "x.line_type", "x.line", "x.content")
