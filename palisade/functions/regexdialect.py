"""Python patterns and globs as Java regular expressions, and what a pattern must contain."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool) -> str:
    """The pattern under Java flags that keep Python's meaning: only \\n ends a line, \\w, \\d, \\s and
    \\b are Unicode's, and ignoring case folds Unicode."""
    return ("(?diuU)" if ignore_case else "(?dU)") + pattern


def glob(pattern: str) -> str:
    """A regex for fnmatch's dialect, in which * crosses slashes; for lower-cased paths."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})$"


def path_glob(pattern: str) -> str:
    """A regex for the allowlist's dialect: * stops at a slash, ** does not and takes one along."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", pattern):
        out += {"**": ".*", "**/": ".*/?", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def required(pattern: str, ignore_case: bool) -> tuple[str, ...]:
    """Lower-cased literals of which any match holds one; empty if none can be told.

    The longest run of literal characters that every match passes through is taken, or, of a
    branch, one run of each alternative.
    """
    tree = sre_parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    best = _runs(tree)
    return tuple(sorted({x.lower() for x in best})) if best and min(map(len, best)) >= 2 and all(x.isascii() for x in best) else ()


def _runs(tree: object) -> tuple[str, ...]:
    found: list[tuple[str, ...]] = []
    run = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append((run,))
            run = ""
        if op is sre.SUBPATTERN and (sub := _runs(arg[-1])):
            found.append(sub)
        elif op is sre.BRANCH:
            each = [_runs(x) for x in arg[1]]
            if all(each):
                found.append(tuple(y for x in each for y in x))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0 and (sub := _runs(arg[2])):
            found.append(sub)
    if run:
        found.append((run,))
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=())


#: First characters of literals that are tried one by one.
CLASS = 6


def automaton(literals: list[str]) -> str:
    """A regex that finds, at every place of a text, the longest of some literals that starts there.

    The literals share their beginnings as in a tree, so a place is left at the first character that no literal goes on with;
    first characters are told apart by a few classes before they are one by one. It matches nothing but looks ahead, so one
    match does not hide another.
    """
    tree: dict = {}
    for x in literals:
        node = tree
        for c in x:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        each = [re.escape(c) + text(below) for c, below in sorted(node.items()) if c]
        if not each:
            return ""
        return f"(?:{'|'.join(each)})" + ("?" if "" in node else "") if len(each) > 1 or "" in node else each[0]

    first = sorted(c for c in tree if c)
    groups = [first[i : i + CLASS] for i in range(0, len(first), CLASS)]
    each = [f"(?=[{''.join(map(re.escape, g))}])(?:{'|'.join(re.escape(c) + text(tree[c]) for c in g)})" for g in groups]
    return f"(?=({'|'.join(each)}))"


def literals_in(low: Column, literals: list[str]) -> Column:
    """The distinct literals that start somewhere in a text, of those at one place the longest alone."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(automaton(literals)), F.lit(1)))


def folded(text: Column) -> Column:
    """Lower case in which every letter that ignoring case takes for an ASCII one is that one."""
    return F.translate(F.lower(text), "\u017f\u0131", "si")


def any_glob(path: Column, globs: tuple[str, ...], relaxed: bool) -> Column:
    """Whether a path (slashes, no leading ./, lower case) fits one of the globs, or there are
    none; relaxed also tries a **/ glob without it."""
    if not globs:
        return F.lit(True)
    tried = dict.fromkeys(g.lower() for p in globs for g in ((p, p[3:]) if relaxed and p.startswith("**/") else (p,)))
    return path.rlike("|".join(f"(?:{glob(g)})" for g in tried))


def normal_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""))
