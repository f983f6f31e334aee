"""Version orders of package ecosystems, as columns.

``key`` makes of a version arrays of tokens, structs (a, n, s) that order as the ecosystem's do, once for
each version; ``compare_keys`` then orders any two of them. ``compare`` gives -1, 0 or 1, or null if
either version is malformed. Numbers of over 38 digits count as malformed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ecosystem names that stand for another (fixed values), and the order of each ecosystem.
SAME = {"pip": "pypi", "python": "pypi", "go": "golang", "packagist": "composer"}
ORDERS = {
    "debian": "linux", "ubuntu": "linux", "rpm": "linux", "redhat": "linux", "suse": "linux", "alpine": "linux",
    "pypi": "pep440", "npm": "semver", "golang": "go", "maven": "maven", "nuget": "nuget", "rubygems": "rubygems", "composer": "composer",
}
# Fixed values, too: the ranks of qualifiers.
MAVEN = {"alpha": 1, "a": 1, "beta": 2, "b": 2, "milestone": 3, "m": 3, "rc": 4, "snapshot": 5, "final": 6, "ga": 6, "release": 6, "sp": 7}
COMPOSER = {"dev": (0, 0), "alpha": (0, 1), "a": (0, 1), "beta": (0, 2), "b": (0, 2), "rc": (0, 3), "stable": (1, 0), "release": (1, 0), "pl": (2, 0), "p": (2, 0)}
PEP_PRE = {"a": 0, "b": 1, "c": 2, "rc": 2, "pre": 2}
NUMBER = "decimal(38,0)"
TOKEN = f"struct<a:int,n:{NUMBER},s:string>"
KEY = f"array<array<{TOKEN}>>"


def ecosystem(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = None
    for k, v in SAME.items():
        out = F.when(low == k, v) if out is None else out.when(low == k, v)
    return out.otherwise(low)


def _num(x: Column) -> Column:
    return x.try_cast(NUMBER)


def _tok(a: int | Column, n: Column | int = 0, s: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(a).cast("int").alias("a"), lit(n).cast(NUMBER).alias("n"), lit(s).cast("string").alias("s"))


def _is_num(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def _sign(left: Column, right: Column) -> Column:
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def _ids(text: Column, fold: bool) -> Column:
    """Dot-separated identifiers: numbers before words; none for an empty text."""
    each = F.transform(F.split(text, r"\."), lambda t: F.when(_is_num(t), _tok(0, _num(t))).otherwise(_tok(1, 0, F.lower(t) if fold else t)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(f"array<{TOKEN}>")).otherwise(each)


def _released(pattern: str, groups: int, version: Column, fold: bool) -> Column:
    """Keys of x.y.z[-pre][+build] forms: (release numbers, 1 if final, identifiers)."""
    part = lambda i: F.regexp_extract(version, pattern, i)
    release = F.array(*[_tok(0, F.coalesce(_num(part(i)), F.lit(0).cast(NUMBER))) for i in range(1, groups + 1)])
    pre = part(groups + 1)
    key = F.array(release, F.array(_tok((pre == "").cast("int"))), _ids(pre, fold))
    return F.when(version.rlike(pattern) & F.forall(F.array(*[part(i) for i in range(1, groups + 1)]), lambda x: F.length(x) <= 38), key)


_SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
_GO = r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_NUGET = r"^([0-9]+)\.([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"


def _semver(v: Column) -> Column:
    return _released(_SEMVER, 3, F.regexp_replace(v, "^v", ""), False)


def _go(v: Column) -> Column:
    return _released(_GO, 3, v, True)


def _nuget(v: Column) -> Column:
    return _released(_NUGET, 4, v, True)


def _generic(v: Column) -> Column:
    bare = F.replace(F.regexp_replace(v, "^v+", ""), F.lit("-"), F.lit("."))
    return F.array(F.transform(F.split(bare, r"\.", -1), lambda t: F.when(_is_num(t), _tok(0, _num(t))).otherwise(_tok(1, 0, F.lower(t)))))


def _pep440(v: Column) -> Column:
    raw = F.regexp_replace(F.lower(v), "^v", "")
    local = F.regexp_extract(raw, r"^[^+]*\+(.*)$", 1)
    body = F.regexp_extract(raw, r"^([^+]*)", 1)
    epoch = F.regexp_extract(body, "^([0-9]+)!", 1)
    rest = F.translate(F.regexp_replace(body, "^[0-9]+!", ""), "-_", "..")
    release = F.regexp_extract(rest, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    tail = F.regexp_extract(rest, r"^[0-9]+(?:\.[0-9]+)*(.*)$", 1)
    token = r"(?:a|b|rc|c|pre|post|rev|r|dev)[0-9]*"
    kinds = F.transform(F.regexp_extract_all(tail, F.lit(token), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, "^([a-z]+)", 1).alias("k"), F.coalesce(_num(F.regexp_extract(t, "([0-9]*)$", 1)), F.lit(0).cast(NUMBER)).alias("n")))
    of = lambda names: F.filter(kinds, lambda t: t["k"].isin(*names))
    pre, post, dev = of(list(PEP_PRE)), of(["post", "rev", "r"]), of(["dev"])
    stage = F.coalesce(*[F.when(F.get(pre, F.lit(0))["k"] == k, F.lit(n)) for k, n in PEP_PRE.items()])
    n = lambda x: F.get(x, F.lit(0))["n"]
    has_dev = F.size(dev) > 0
    zero = F.lit(0).cast(NUMBER)
    row = lambda *x: F.array(*[_tok(0, y) for y in x])
    phase = (
        F.when(F.size(pre) > 0, row(1, stage, n(pre), F.when(has_dev, 0).otherwise(1), F.coalesce(n(dev), zero)))
        .when(has_dev, row(0, n(dev), 0, 0, 0))
        .when(F.size(post) > 0, row(3, n(post), 1, 0, 0))
        .otherwise(row(2, 0, 0, 0, 0))
    )
    numbers = F.transform(F.split(release, r"\."), _num)
    padded = F.transform(F.concat(numbers, F.array_repeat(zero, F.greatest(8 - F.size(numbers), F.lit(0)))), lambda n: _tok(0, n))
    locals_ = F.transform(F.split(F.regexp_replace(local, r"(?:[._-]0+)+$|^0+$", ""), "[._-]"), lambda t: F.when(_is_num(t), _tok(1, _num(t))).otherwise(_tok(0, 0, t)))
    locals_ = F.when(F.regexp_replace(local, r"(?:[._-]0+)+$|^0+$", "") == "", F.array().cast(f"array<{TOKEN}>")).otherwise(locals_)
    fine = (
        raw.rlike(r"^(?:[0-9]+!)?[0-9]+(?:[._-][0-9]+)*[._-]*(?:(?:a|b|rc|c|pre|post|rev|r|dev)[0-9]*[._-]*)*(?:\+[a-z0-9]+(?:[._-][a-z0-9]+)*)?$")
        & (F.size(pre) <= 1) & (F.size(post) <= 1) & (F.size(dev) <= 1) & F.forall(numbers, lambda x: x.isNotNull())
    )
    return F.when(fine, F.array(F.array(_tok(0, F.coalesce(_num(epoch), zero))), padded, phase, locals_))


def _pieces(v: Column, valid: str, pattern: str, word: Callable[[Column], Column], number: int) -> Column:
    each = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda t: F.when(_is_num(t), _tok(number, _num(t))).otherwise(word(F.lower(t))))
    return F.when(v.rlike(valid) & F.forall(each, lambda t: t["n"].isNotNull()), F.array(each))


def _maven(v: Column) -> Column:
    def word(t: Column) -> Column:
        known = F.coalesce(*[F.when(t == k, F.lit(n)) for k, n in MAVEN.items()])
        return F.when(known.isNotNull(), _tok(1, known)).otherwise(_tok(1, 100, t))

    return _pieces(v, "^[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*$", "[0-9]+|[A-Za-z]+", word, 2)


def _rubygems(v: Column) -> Column:
    return _pieces(v, "^[0-9A-Za-z]+(?:[._-][0-9A-Za-z]+)*$", "[0-9]+|[A-Za-z]+", lambda t: _tok(0, 0, t), 1)


def _composer(v: Column) -> Column:
    def word(t: Column) -> Column:
        known = F.coalesce(*[F.when(t == k, _tok(*n)) for k, n in COMPOSER.items()])
        return F.coalesce(known, _tok(0, 50, t))

    return _pieces(v, "^[0-9A-Za-z]+(?:[._+-][0-9A-Za-z]+)*$", "[0-9]+|[A-Za-z]+", word, 1)


def _linux(v: Column) -> Column:
    rest = F.regexp_replace(v, "^[0-9]+:", "")
    epoch = F.coalesce(_num(F.regexp_extract(v, "^([0-9]+):", 1)), F.lit(0).cast(NUMBER))
    word = lambda t: F.when(t == "~", _tok(0)).when(t == "^", _tok(0, 0, "^")).otherwise(_tok(1, 0, t))
    core = _pieces(rest, "^[0-9A-Za-z.+~^_-]+$", r"~|\^|[0-9]+|[A-Za-z]+", word, 2)
    # the epoch goes first as a token of a kind that no other has, so it decides before all others
    return F.when(core.isNotNull(), F.array(F.concat(F.array(_tok(9, epoch)), F.get(core, F.lit(0)))))


def _padded(left: Column, right: Column, pad: Callable[[Column], Column]) -> Column:
    """Sign of the first tokens that differ; a missing one is what pad makes of the other."""
    signs = F.zip_with(left, right, lambda x, y: _sign(F.coalesce(x, pad(y)), F.coalesce(y, pad(x))))
    return F.aggregate(signs, F.lit(0), lambda acc, s: F.when(acc != 0, acc).otherwise(s))


KEYS: dict[str, Callable[[Column], Column]] = {
    "generic": _generic, "semver": _semver, "pep440": _pep440, "go": _go, "nuget": _nuget, "maven": _maven, "rubygems": _rubygems, "composer": _composer, "linux": _linux,
}
#: What a missing token counts as in the orders that fill the shorter version up; the others compare as arrays do.
PADS: dict[str, Callable[[Column], Column]] = {
    "maven": lambda other: F.when(other["a"] == 2, _tok(2)).otherwise(_tok(1, 6)),
    "rubygems": lambda other: _tok(1), "composer": lambda other: _tok(1), "linux": lambda other: _tok(1),
}


def orders_of(ecosystems: set[str]) -> frozenset[str]:
    """The orders that some ecosystems (normalized) have, beside the generic one."""
    return frozenset(ORDERS[e] for e in ecosystems if e in ORDERS)


def _by_order(eco: Column, of: Callable[[str], Column], only: frozenset[str] | None = None) -> Column:
    """of(order) by the order of the ecosystem (normalized), the generic one if it has none; with only
    just those orders are told apart, as no other ecosystem occurs."""
    out = None
    for order in sorted(set(ORDERS.values()) if only is None else only):
        test = eco.isin([e for e, o in ORDERS.items() if o == order])
        out = F.when(test, of(order)) if out is None else out.when(test, of(order))
    return of("generic") if out is None else out.otherwise(of("generic"))


def key(eco: Column, version: Column, only: frozenset[str] | None = None) -> Column:
    """The tokens of a version under its ecosystem's order, null if it is malformed."""
    return _by_order(eco, lambda order: KEYS[order](version).cast(KEY), only)


def _token_text(t: Column) -> Column:
    """A token as text that orders as it does: kind, length and digits of the number, the string's end marked."""
    n = t["n"].cast("string")
    number = F.when(n.isNull(), F.lit("\x1f")).otherwise(F.concat(F.char(F.length(n) + 0x20), n))
    return F.concat(F.char(t["a"] + 0x20), number, F.replace(t["s"], F.lit("\x00"), F.lit("\x00\x7f")), F.lit("\x00\x01"))


def _plain_text(key: Column) -> Column:
    """Arrays that compare as arrays do: a shorter one comes first."""
    return F.array_join(F.transform(key, lambda part: F.concat(F.array_join(F.transform(part, lambda t: F.concat(F.lit("\x02"), _token_text(t))), ""), F.lit("\x01"))), "")


def _filled_text(key: Column) -> Column:
    """An array that counts as if followed by tokens (1, 0, "") without end.

    Before each other token stands how many of those came since the last: if it is greater than they
    are, fewer of them make the whole greater, else smaller.
    """
    pad = F.struct(F.lit(1).alias("a"), F.lit(0).cast(NUMBER).alias("n"), F.lit("").alias("s"))
    zero = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    digits = lambda k: F.lpad(k.cast("string"), 9, "0")

    def step(acc: Column, t: Column) -> Column:
        lead = F.when(t > pad, F.concat(F.lit("\x03"), digits(F.lit(999_999_999) - acc["k"]))).otherwise(F.concat(F.lit("\x01"), digits(acc["k"])))
        more = F.struct(F.lit(0).alias("k"), F.concat(acc["out"], lead, _token_text(t)).alias("out"))
        return F.when(t == pad, F.struct((acc["k"] + 1).alias("k"), acc["out"].alias("out"))).otherwise(more)

    return F.aggregate(F.get(key, F.lit(0)), zero, step, lambda acc: F.concat(acc["out"], F.lit("\x02")))


def _release_text(key: Column) -> Column:
    """The leading numbers without zeros at their end. Versions that differ in them order as they do."""
    part = F.get(key, F.lit(0))
    upto = F.array_position(F.transform(part, lambda t: t["a"] == 2), False).cast("int")  # the first word, from 1
    numbers = F.when(upto > 0, F.slice(part, F.lit(1), upto - 1)).otherwise(part)
    last = F.array_max(F.transform(numbers, lambda t, i: F.when(t["n"] != 0, i + 1).otherwise(0)))
    kept = F.slice(numbers, F.lit(1), F.coalesce(last, F.lit(0)).cast("int"))
    return F.concat(F.array_join(F.transform(kept, lambda t: F.concat(F.lit("\x02"), _token_text(t))), ""), F.lit("\x01"))


#: How an order's keys become sortable text. Maven's order, in which a missing token equals both a zero and a
#: release while the two differ, has no such text of a whole version: that of its release numbers is coarse.
TEXTS: dict[str, Callable[[Column], Column]] = {"maven": _release_text, "rubygems": _filled_text, "composer": _filled_text, "linux": _filled_text}
#: Texts below and above that of any key.
LOWEST, HIGHEST = "", "\U0010ffff"


def sortable(eco: Column, key: Column, only: frozenset[str] | None = None) -> Column:
    """A text of a key, by whose bytes keys of an ecosystem sort: if a's text is less than b's, a is less than b.

    Under all orders but Maven's, keys of equal texts are equal. Null for a null key.
    """
    return F.when(key.isNotNull(), _by_order(eco, lambda order: TEXTS.get(order, _plain_text)(key), only))


def intervals(eco: Column, steps: Column, only: frozenset[str] | None = None) -> Column:
    """Of one range's steps the intervals (low, high), as sortable texts, outside which no version is in range.

    A version is in range between an introduced step and the step right after it, if that closes, or above a last one. An
    interval with a malformed end holds nothing; ends count as inside.
    """
    told = F.transform(steps, lambda s: F.struct((s["k"] == "introduced").alias("opens"), F.when(s["k"].eqNullSafe(F.lit("introduced")) & s["zero"], F.lit(LOWEST)).otherwise(sortable(eco, s["key"], only)).alias("at")))

    def pair(s: Column, i: Column) -> Column:
        after = F.get(told, i + 1)
        high = F.when(i == F.size(told) - 1, F.lit(HIGHEST)).when(~after["opens"], after["at"])
        return F.struct(F.when(s["opens"], s["at"]).alias("low"), high.alias("high"))

    return F.filter(F.transform(told, pair), lambda x: x["low"].isNotNull() & x["high"].isNotNull() & (x["low"] <= x["high"]))


def merged(spans: Column) -> Column:
    """Intervals (low, high) joined where they meet, so that none overlaps another."""
    kind = "array<struct<low:string,high:string>>"
    zero = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wide = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))
        return F.when((F.size(acc) > 0) & (x["low"] <= last["high"]), joined.cast(kind)).otherwise(F.concat(acc, F.array(x)).cast(kind))

    return F.aggregate(F.array_sort(spans), zero, step)


def compare_keys(eco: Column, left: Column, right: Column, only: frozenset[str] | None = None) -> Column:
    """-1, 0 or 1 of two keys of an ecosystem, null if one is."""
    first = lambda k: F.get(k, F.lit(0))
    either = left.isNotNull() & right.isNotNull()
    return F.when(either, _by_order(eco, lambda order: _padded(first(left), first(right), PADS[order]) if order in PADS else _sign(left, right), only))


def compare_as(order: str, left: Column, right: Column) -> Column:
    """-1, 0 or 1 of two versions by the order of a name, null if either is malformed."""
    x, y = KEYS[order](left), KEYS[order](right)
    return _padded(F.get(x, F.lit(0)), F.get(y, F.lit(0)), PADS[order]) if order in PADS else _sign(x, y)


def compare(eco: Column, left: Column, right: Column) -> Column:
    """-1, 0 or 1 by the order of the ecosystem (normalized), the generic one if it has none."""
    return compare_keys(eco, key(eco, left), key(eco, right))


def steps(eco: Column, events: Column, only: frozenset[str] | None = None) -> Column:
    """Events (array of struct introduced, fixed, last_affected) as steps of kind, whether from "0" on, and key.

    Of an event introduced is taken first, then fixed, then last_affected.
    """
    kinds = ("introduced", "fixed", "last_affected")
    each = F.flatten(F.transform(events, lambda e: F.filter(F.array(*[F.struct(F.lit(k).alias("k"), e[k].alias("v")) for k in kinds]), lambda s: s["v"].isNotNull())))
    return F.transform(each, lambda s: F.struct(s["k"].alias("k"), (s["v"] == "0").alias("zero"), key(eco, s["v"], only).alias("key")))


def affected(eco: Column, version: Column, steps: Column, only: frozenset[str] | None = None) -> Column:
    """struct(hit, bad): whether steps put the version of a key in range, and whether a version on the
    way is malformed; "0" introduces all."""
    told = F.transform(steps, lambda s: F.struct(s["k"].alias("k"), s["zero"].alias("zero"), compare_keys(eco, version, s["key"], only).alias("c")))
    zero = F.struct(F.lit(False).alias("active"), F.lit(False).alias("hit"), F.lit(False).alias("bad"))

    def step(acc: Column, s: Column) -> Column:
        opens = s["k"] == "introduced"
        bad = s["c"].isNull() & ~(opens & s["zero"]) & (opens | acc["active"])
        inside = acc["active"] & F.when(s["k"] == "fixed", s["c"] < 0).otherwise(s["c"] <= 0)
        active = F.when(opens, s["zero"] | F.coalesce(s["c"] >= 0, F.lit(False))).otherwise(F.lit(False))
        hit = acc["hit"] | (~opens & F.coalesce(inside, F.lit(False)))
        return F.struct(active.alias("active"), hit.alias("hit"), (acc["bad"] | (bad & ~acc["hit"])).alias("bad"))

    return F.aggregate(told, zero, step, lambda acc: F.struct((acc["hit"] | acc["active"]).alias("hit"), acc["bad"].alias("bad")))
