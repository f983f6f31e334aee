"""Personal data: format-preserving Feistel pseudonyms of validated values."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import small_batches

ROUNDS = 10
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FIRST, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31
OLD = FIRST - datetime.date(1000, 1, 1).toordinal()  # days from 1000 on before FIRST
LATER = datetime.date.max.toordinal() - FIRST - DAYS + 1


class Cipher:
    """Keyed permutations of whole numbers below a bound.

    A Feistel network of ROUNDS rounds over two halves permutes a range that is the product
    of the halves' sizes; values that leave the bound are permuted again until they return
    (cycle walking), so each bound is permuted onto itself.
    """

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, int, int], int] = {}

    def _round(self, tweak: str, i: int, x: int, size: int) -> int:
        said = f"{tweak}|{i}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=24).digest(), "big") % size

    def permute(self, x: int, bound: int, tweak: str) -> int:
        if bound < 2:
            return x
        if (found := self.known.get((tweak, bound, x))) is not None:
            return found
        a = math.isqrt(bound - 1) + 1
        b, y = -(-bound // a), x
        while True:
            left, right = divmod(y, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(tweak, i, left, b)) % b
                else:
                    left = (left + self._round(tweak, i, right, a)) % a
            y = left * b + right
            if y < bound:
                break
        if len(self.known) < 100_000:
            self.known[tweak, bound, x] = y
        return y

    def digits(self, s: str, tweak: str) -> str:
        return str(self.permute(int(s), 10 ** len(s), f"{tweak}{len(s)}")).zfill(len(s)) if s else s


def luhn_digit(body: str) -> str:
    """The digit that makes body plus it pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _digits_in(form: str, digits: str) -> str:
    """form with its digits replaced in turn."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), form)


def card(value: str, c: Cipher) -> str | None:
    d = re.sub(r"[^0-9]", "", value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = c.digits(d[:-1], "card")
    return _digits_in(value, body + luhn_digit(body))


def iban(value: str, c: Cipher) -> str | None:
    s = value.replace(" ", "")
    number = lambda x: int("".join(str(int(ch, 36)) for ch in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    runs = re.findall(r"[0-9]+|[A-Z]+", s[4:])
    kept = "".join(runs) if not any(r[0].isdigit() for r in runs) else None
    if kept is not None:
        return None
    all_digits = c.digits("".join(r for r in runs if r[0].isdigit()), "iban")
    body = _digits_in(s[4:], all_digits)
    check = f"{98 - number(body + s[:2] + '00') % 97:02d}"
    it = iter(s[:2] + check + body)
    return "".join(ch if ch == " " else next(it) for ch in value)


def ssn(value: str, c: Cipher) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    ok = lambda a, g, n: 0 < a < 900 and a != 666 and g > 0 and n > 0
    if not ok(area, group, serial):
        return None
    x = int(value.replace("-", ""))
    while True:
        x = c.permute(x, 10**9, "ssn")
        s = f"{x:09d}"
        if ok(int(s[:3]), int(s[3:5]), int(s[5:])):
            return f"{s[:3]}-{s[3:5]}-{s[5:]}"


#: Ten digits in three groups, without a country code or brackets.
PLAIN = r"[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}"


def phone(value: str, c: Cipher) -> str | None:
    d = re.sub(r"[^0-9]", "", value)
    if re.fullmatch(PLAIN, value):
        while True:
            d = c.digits(d, "plain phone")
            if re.fullmatch(PLAIN, new := _digits_in(value, d)):
                return new
    if not 8 <= len(d) <= 15:
        return None
    head = len(re.match(r"\+?([0-9]*)", value)[1]) if value.startswith("+") else 0
    head = min(head, len(d) - 7)
    return _digits_in(value, d[:head] + c.digits(d[head:], "phone"))


def address(value: str, c: Cipher) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = 0
    for p in parts:
        x = x << 8 | int(p)
    x = c.permute(x, 1 << 32, "ip")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


#: (pattern, whether the day stands first, second or last); formats are fixed values.
DATES = (
    (re.compile(r"([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})"), (1, 3, 4)),
    (re.compile(r"([0-9]{2})([-/.])([0-9]{2})\2([0-9]{4})"), (4, 3, 1)),
)


def date(value: str, c: Cipher) -> str | None:
    for pattern, (y, m, d) in DATES:
        if not (found := pattern.fullmatch(value)):
            continue
        year, month, day = int(found[y]), int(found[m]), int(found[d])
        swap = False
        if d == 1 and month > 12 >= day:
            month, day, swap = day, month, True
        try:
            x = datetime.date(year, month, day).toordinal() - FIRST
        except ValueError:
            return None
        # dates of 1900 to 2099 are permuted among themselves, as are those before and after
        if 0 <= x < DAYS:
            x = c.permute(x, DAYS, "date")
        elif x >= DAYS:
            x = DAYS + c.permute(x - DAYS, LATER, "later date")
        elif x >= -OLD:
            x = -1 - c.permute(-1 - x, OLD, "older date")
        else:
            return None
        new = datetime.date.fromordinal(FIRST + x)
        sep = found[2]
        if d == 4:
            return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
        a, b = (new.month, new.day) if swap else (new.day, new.month)
        return f"{a:02d}{sep}{b:02d}{sep}{new.year:04d}"
    return None


def email(value: str, c: Cipher) -> str | None:
    """Letters and digits of the part before the @ are permuted, each run within its kind; so is the first label of the domain."""
    local, _, domain = value.rpartition("@")
    first, dot, rest = domain.partition(".")

    def run(m: re.Match[str]) -> str:
        s = m[0]
        if s[0].isdigit():
            return c.digits(s, f"mail {tail}")
        x = 0
        for ch in s.lower():
            x = x * 26 + LETTERS.index(ch)
        x = c.permute(x, 26 ** len(s), f"mail {len(s)} {tail}")
        out = ""
        for _ in s:
            x, r = divmod(x, 26)
            out = LETTERS[r] + out
        return "".join(o.upper() if ch.isupper() else o for o, ch in zip(out, s, strict=True))

    tail = rest
    part = re.compile(r"[0-9]+|[A-Za-z]+")
    return part.sub(run, local) + "@" + part.sub(run, first) + dot + rest


def secret(value: str, c: Cipher) -> str | None:
    """Hex credentials of 32 digits or more."""
    if not (re.search(r"[0-9]", value) and re.search(r"[a-f]", value)):
        return None
    out = f"{c.permute(int(value, 16), 16 ** len(value), f'hex{len(value)}'):0{len(value)}x}"
    return out


KINDS: dict[str, tuple[str, Callable[[str, Cipher], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])", email),
    "secret": (r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])", iban),
    "date": (r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9/-]|\.[0-9])", date),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", address),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
    "phone": (r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{3}\)[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])(?<![0-9][.-])" + PLAIN + r"(?![0-9A-Za-z]|[.-][0-9])", phone),
}
#: Kinds of separated groups whose match may run on into digits or words behind the value.
GROUPED = ("iban", "card", "phone")


def _matches(kind: str, text: str, taken: list[tuple[int, int]], c: Cipher) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of a kind's values outside taken, spans in order of which none overlaps another. If a match
    of groups fails, its shorter beginnings are tried, then the search goes on behind its first group."""
    pattern, change = KINDS[kind]
    form, at = re.compile(pattern), 0
    ends = [e for _, e in taken]

    def free(start: int, end: int) -> bool:
        i = bisect.bisect_right(ends, start)  # the first span that ends behind the start
        return i == len(taken) or taken[i][0] >= end

    while m := form.search(text, at):
        breaks = [b.start() for b in re.finditer("[ .-]", m[0])] if kind in GROUPED else []
        at = m.start() + breaks[0] if breaks and breaks[0] else m.end()
        for n in [len(m[0]), *reversed(breaks)]:
            end = m.start() + n
            if not free(m.start(), end) or (n < len(m[0]) and not form.fullmatch(m[0][:n])):
                continue
            if (new := change(m[0][:n], c)) is not None:
                yield m.start(), end, new
                at = end
                break


def rewrite(text: str | None, c: Cipher) -> tuple[str | None, list[str], int]:
    """(text with pseudonyms, kinds found, values found)."""
    if text is None:
        return None, [], 0
    found: list[tuple[int, int, str, str]] = []
    if re.search(r"[0-9@]", text):
        taken: list[tuple[int, int]] = []
        for kind in KINDS:
            if kind == "email" and "@" not in text:
                continue
            got = list(_matches(kind, text, taken, c))
            found += [(start, end, kind, new) for start, end, new in got]
            if got:
                taken = sorted(taken + [(start, end) for start, end, _ in got])
    if not found:
        return text, [], 0
    found.sort()
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), sorted({f[2] for f in found}), len(found)


#: Where a session keeps its key.
KEY = "spark.palisade.pii.secret"


def session_key(spark: SparkSession) -> bytes:
    """The key that the setting KEY holds, whose name keeps Spark from showing its value in logs and pages; without
    one a random key, which the session keeps there, so that its runs agree and no one else can undo them."""
    said = spark.conf.get(KEY, None)
    if not said:
        said = secrets.token_hex(32)
        spark.conf.set(KEY, said)
    return said.encode()


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Every row of docs as (doc_id, text, kinds, n_found).

    Validated cards (Luhn), IBANs (mod 97), dates, US social security numbers, phone numbers,
    IPv4 addresses, e-mail addresses and hex credentials become other valid values of the same
    format by permutations under key, so equal values stay equal across documents and different
    ones different; numbers that fail their check stay, as do dates before the year 1000. Where
    values of several kinds overlap the kind that stands first in KINDS is taken, of one kind the first value.
    Null texts stay null; very long texts are changed as a whole; repeated rows
    change alike; an empty table gives no rows; other columns are ignored.
    """
    if not key:
        raise ValueError("a key is needed: anyone can undo pseudonyms of a key that is known")
    small_batches(docs.sparkSession)
    kind = StructType().add("text", StringType()).add("kinds", ArrayType(StringType())).add("n_found", IntegerType())
    held: list[Cipher] = []

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Cipher(key))
        return pd.DataFrame([rewrite(t, held[0]) for t in texts], columns=["text", "kinds", "n_found"])

    return docs.select("doc_id", of("text").alias("p")).select("doc_id", "p.text", "p.kinds", "p.n_found")
