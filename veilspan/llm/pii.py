"""Operator 9, PII: format-preserving Feistel pseudonyms.

A value that passes its kind's check (Luhn, IBAN remainder, calendar, octet range, number plan) is turned into an integer below
the size of its format, permuted there by a keyed Feistel network with cycle walking, and written back in the layout it was
found in. The same value gets the same pseudonym in every document, different values get different ones, and
the holder of the key can undo it. Dates are permuted among the dates of 1900 to 2099 that are written alike: those in figures, in whatever
order, among dates with as many digits in month and day and with days on the same side of 12, so that each reads as it was meant; those
with a month's name among dates with as many digits in the day, May and letters that no other name can have staying. Kinds that are not numbers (mail addresses, access keys, passwords) are permuted letter class by
letter class. Each text is read once, where it lies; nothing is shuffled.

Edge cases: null text stays null and has no findings; empty text stays empty; invalid UTF-8 is kept byte for byte if nothing is
found in it; repeated rows get equal results; an empty table gives an empty table; of overlapping findings the kind that stands
first in ``KINDS`` wins, then the leftmost. A card or IBAN next to other numbers or words is looked for
among the groups of the run it stands in. Numbers that fail their check stay as they are. Other columns are passed through by
``pseudonymise`` and are not read by ``findings``.
"""

from __future__ import annotations

import calendar
import hashlib
import ipaddress
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, handing_back, plain, query, read, slices

KEY_SETTING = "spark.veilspan.pii.key"
#: Used where the session names no key, as in tests.
DEFAULT_KEY = "set spark.veilspan.pii.key"
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
MONTHS = [m for m in calendar.month_name if m]
MAY = 5
LOWER, UPPER, DIGITS, HEX, HEX_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef", "0123456789ABCDEF"


class Feistel:
    """A keyed permutation of the integers below ``size``, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _halves(self, size: int) -> tuple[int, int]:
        a = max(1, math.isqrt(size - 1) + 1)
        return a, -(-size // a)

    def _mix(self, tweak: str, turn: int, half: int, modulus: int) -> int:
        data = f"{tweak}\0{turn}\0{half}".encode()
        width = min(64, 16 + (modulus.bit_length() + 7) // 8)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=width).digest()) % modulus

    def _once(self, value: int, size: int, tweak: str, turns: range, sign: int) -> int:
        a, b = self._halves(size)
        left, right = divmod(value, b)
        for turn in turns:
            if turn % 2:
                right = (right + sign * self._mix(tweak, turn, left, b)) % b
            else:
                left = (left + sign * self._mix(tweak, turn, right, a)) % a
        return left * b + right

    def permute(self, value: int, size: int, tweak: str) -> int:
        while True:
            value = self._once(value, size, tweak, range(ROUNDS), 1)
            if value < size:
                return value

    def restore(self, value: int, size: int, tweak: str) -> int:
        while True:
            value = self._once(value, size, tweak, range(ROUNDS - 1, -1, -1), -1)
            if value < size:
                return value


class Pseudonyms:
    """Pseudonyms under one key; ``undo`` turns them back."""

    def __init__(self, key: str, undo: bool = False):
        feistel = Feistel(key.encode())
        self.turn = feistel.restore if undo else feistel.permute

    def places(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        """Digits of a mixed-radix number, permuted as one number."""
        number = 0
        for v, n in zip(values, sizes, strict=True):
            number = number * n + v
        number = self.turn(number, math.prod(sizes), f"{tweak}{sizes}")
        out = []
        for n in reversed(sizes):
            number, v = divmod(number, n)
            out.append(v)
        return out[::-1]

    def letters(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """ASCII letters and digits permuted within their class and place; all else stays."""
        classes = [HEX, HEX_UPPER] if hexadecimal else [DIGITS, LOWER, UPPER]
        if hexadecimal and not set(text) <= set(HEX):
            classes = classes[1:]
        kind = [next((c for c in classes if x in c), "") for x in text]
        at = [i for i, c in enumerate(kind) if c]
        out = list(text)
        for i, v in zip(at, self.places([kind[i].index(text[i]) for i in at], [len(kind[i]) for i in at], tweak), strict=True):
            out[i] = kind[i][v]
        return "".join(out)


def layout(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if x in DIGITS else x for x in shape)


def only_digits(text: str) -> str:
    return "".join(x for x in text if x in DIGITS)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, x in enumerate(reversed(payload)):
        d = int(x) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def card(p: Pseudonyms, m: re.Match) -> str | None:
    digits = only_digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = "".join(map(str, p.places([int(x) for x in digits[:-1]], [10] * (len(digits) - 1), "card")))
    return layout(m[0], payload + luhn_digit(payload))


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(x, 36)) for x in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def iban(p: Pseudonyms, m: re.Match) -> str | None:
    flat = m[0].replace(" ", "")
    if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    rest = p.letters(flat[4:], f"iban{flat[:2]}")
    new = iter(flat[:2] + iban_check(flat[:2], rest) + rest)
    return "".join(x if x == " " else next(new) for x in m[0])


def ssn(p: Pseudonyms, m: re.Match) -> str | None:
    area, group, serial = map(int, m.groups())
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place, group, serial = p.places([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
    return layout(m[0], f"{place + 1 + (place >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def phone(p: Pseudonyms, m: re.Match) -> str | None:
    """North American numbers keep their plan (no area or exchange begins with 0 or 1), others their country code and length."""
    digits = only_digits(m[0])
    code = only_digits(m["flat"] or m["code"] or m["abroad"] or "")
    local = digits[len(code) :]
    if len(local) == 10 and code in ("", "1"):
        first, third = int(local[0]), int(local[3])
        if first < 2 or third < 2:
            return None
        sizes = [8, 10, 10, 8] + [10] * 6
        new = p.places([first - 2, int(local[1]), int(local[2]), third - 2, *map(int, local[4:])], sizes, "phone1")
        new = [new[0] + 2, *new[1:3], new[3] + 2, *new[4:]]
    elif code and 6 <= len(local) <= 14:
        new = p.places([int(x) for x in local], [10] * len(local), f"phone{code}")
    else:
        return None
    return layout(m[0], code + "".join(map(str, new)))


def ipv4(p: Pseudonyms, m: re.Match) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255 or any(x[0] == "0" and len(x) > 1 for x in m[0].split(".")):
        return None
    return ".".join(map(str, p.places(octets, [256] * 4, "ipv4")))


def ipv6(p: Pseudonyms, m: re.Match) -> str | None:
    try:
        ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    return ":".join(p.letters(x, "ipv6", hexadecimal=True) if x else x for x in m[0].split(":")) if re.search("[0-9]", m[0]) else None


def numeric_class(at: date) -> tuple:
    """What a date in figures keeps: the digits of its month and day, and whether the day can be taken for a month."""
    return at.month > 9, (at.day > 9) + (at.day > 12)


def worded_class(at: date) -> tuple:
    """What a date with a month's name keeps: the digits of its day, and May, whose short name is the whole name."""
    return at.month == MAY, at.day > 9


def monthly_class(at: date) -> tuple:
    return at.month, at.day > 9


@cache
def dates_by(kind: Callable[[date], tuple]) -> dict[tuple, list[int]]:
    """All dates of the range by their class, as ascending day numbers."""
    out: dict[tuple, list[int]] = {}
    for day in range(FIRST_DAY, LAST_DAY + 1):
        out.setdefault(kind(date.fromordinal(day)), []).append(day)
    return out


def dated(p: Pseudonyms, year: int, month: int, day: int, kind: Callable[[date], tuple] = numeric_class) -> date | None:
    """Another date of the same class; None if this is no date of the range."""
    try:
        at = date(year, month, day)
    except ValueError:
        return None
    if not FIRST_DAY <= at.toordinal() <= LAST_DAY:
        return None
    peers = dates_by(kind)[kind(at)]
    return date.fromordinal(peers[p.turn(bisect_left(peers, at.toordinal()), len(peers), f"date {kind.__name__} {kind(at)}")])


def iso_date(p: Pseudonyms, m: re.Match) -> str | None:
    new = dated(p, int(m[1]), int(m[3]), int(m[4]))
    return new and f"{new.year:04d}{m[2]}{new.month:02d}{m[2]}{new.day:02d}"


def slash_date(p: Pseudonyms, m: re.Match) -> str | None:
    """Month first where that is a date, else day first; then the day is over 12, and so is its pseudonym's."""
    a, b, year = int(m[1]), int(m[3]), int(m[4])
    month_first = a <= 12
    new = dated(p, year, a, b) if month_first else dated(p, year, b, a)
    if not new:
        return None
    x, y = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{x:0{len(m[1])}d}{m[2]}{y:0{len(m[3])}d}{m[2]}{new.year:04d}"


def long_date(p: Pseudonyms, m: re.Match) -> str | None:
    """Name, day and year change where they stand. A name that others can't stand for letter by letter ("Sept", "mArch", "May") stays."""
    k = "1" if m["m1"] else "2"
    name, digits = m[f"m{k}"], m[f"d{k}"]
    month = next(i for i, x in enumerate(MONTHS, 1) if x.lower().startswith(name[:3].lower()))
    full, case = name.lower() == MONTHS[month - 1].lower(), next((f for f in (str.title, str.upper, str.lower) if f(name) == name), None)
    stays = month == MAY or case is None or not (full or len(name) == 3)
    new = dated(p, int(m["year"]), month, int(digits), monthly_class if stays else worded_class)
    if not new:
        return None
    other = name if stays else case(MONTHS[new.month - 1][: None if full else 3])
    out = m[0]
    for part, text in sorted(((f"m{k}", other), (f"d{k}", f"{new.day:0{len(digits)}d}"), ("year", f"{new.year:04d}")), key=lambda x: -m.start(x[0])):
        out = out[: m.start(part) - m.start()] + text + out[m.end(part) - m.start() :]
    return out


def email(p: Pseudonyms, m: re.Match) -> str:
    body, _, top = m[0].rpartition(".")
    return f"{p.letters(body, 'email')}.{top}"


def secret(p: Pseudonyms, m: re.Match) -> str | None:
    at = m.lastgroup
    value = m[at]
    hexadecimal = bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)) and len(value) >= 16
    new = p.letters(value, "secret", hexadecimal)
    begin = m.start(at) - m.start()
    return m[0][:begin] + new + m[0][begin + len(value) :]


#: Kind, what a text must hold for the pattern to be tried, pattern, replacement. The order is the priority.
KINDS = [
    ("secret", re.compile(r"AKIA|gh[pousr]_|sk-|xox|AIza|[=:]"), re.compile(
        r"\bA[KS]IA(?P<aws>[0-9A-Z]{16})\b|\bgh[pousr]_(?P<hub>[A-Za-z0-9]{36,})|\bsk-(?P<sk>[A-Za-z0-9_-]{20,})|\bxox[abprs]-(?P<chat>[A-Za-z0-9-]{10,})|\bAIza(?P<maps>[0-9A-Za-z_-]{35})"
        r"|(?i:\b(?:[a-z0-9]+[_-])*(?:token|secret|passwords?|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<named>[A-Za-z0-9_+/.=~!@#$%^&*-]*[A-Za-z0-9][A-Za-z0-9_+/.=~-]{4,})"), secret),
    ("email", re.compile("@"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"), email),
    ("iban", re.compile("[A-Z]{2}[0-9]{2}"), re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), iban),
    ("card", re.compile("[0-9]{4}"), re.compile(r"(?<![0-9.-])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"), card),
    ("ssn", re.compile("[0-9]-[0-9]"), re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])"), ssn),
    ("phone", re.compile("[0-9]{3}"), re.compile(
        r"(?<![0-9.+])(?:(?P<flat>\+1)(?=[2-9])[0-9]{10}|(?:(?P<code>\+[0-9]{1,3}|1)[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}"
        r"|(?P<abroad>\+[0-9]{1,3})(?:[ .-]?\(?[0-9]{1,4}\)?){2,5})(?![0-9])"), phone),
    ("ipv4", re.compile(r"[0-9]\.[0-9]"), re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"), ipv4),
    ("ipv6", re.compile(":[0-9a-fA-F:]*:"), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), ipv6),
    ("date", re.compile("[0-9][-/.][0-9]"), re.compile(r"(?<![0-9/.-])([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})(?![0-9]|[-/.][0-9])"), iso_date),
    ("date", re.compile("[0-9][-/.][0-9]"), re.compile(r"(?<![0-9/.-])([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})(?![0-9]|[-/.][0-9])"), slash_date),
    ("date", re.compile(r"(?i)[a-z]\.? [0-9]|[0-9] [a-z]"), re.compile(
        r"\b(?i:(?P<m1>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.? (?P<d1>[0-9]{1,2}),? "
        r"|(?P<d2>[0-9]{1,2}) (?P<m2>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?,? )(?P<year>[0-9]{4})\b"), long_date),
]
DIGIT_OR_AT = re.compile("[0-9@]")
#: Kinds that a pattern may read on into the next number or word: runs of groups, what a group must begin with, least and most characters,
#: and the least of each group but the last (dates, telephone numbers and columns of small numbers are no parts of a card).
RUNS = {
    "iban": (re.compile(r"\b[A-Z0-9]+(?: [A-Z0-9]+)+\b"), re.compile("[A-Z]{2}[0-9]{2}"), 15, 34, 1),
    "card": (re.compile(r"(?<![0-9.-])[0-9]+(?:[ -][0-9]+)+"), re.compile("[0-9]{4}"), 13, 19, 4),
}
GROUP, SPAN = re.compile("[A-Z0-9]+"), re.compile("(?s:.*)")
SECRET_WORDS = ("token", "secret", "passw", "pwd", "key")


def parts(kind: str, text: str) -> Iterator[re.Match]:
    """Spans of a kind that begin and end at groups inside a longer run, by their begin, the longest first."""
    runs, opening, least, most, least_group = RUNS[kind]
    for run in runs.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, run.start(), run.end())]
        for i, (begin, _) in enumerate(groups):
            if not opening.match(text, begin):
                continue
            ends, n = [], 0
            for a, b in groups[i:]:
                n += b - a
                if n > most:
                    break
                if n >= least:
                    ends.append(b)
                if b - a < least_group:
                    break
            yield from (SPAN.fullmatch(text, begin, end) for end in reversed(ends))


def found(text: str, p: Pseudonyms) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, pseudonym) of the findings, by place; none overlap."""
    if not DIGIT_OR_AT.search(text) and not any(x in text.lower() for x in SECRET_WORDS):
        return []
    taken: list[tuple[str, int, int, str]] = []
    begins, ends = [], []  # of the taken spans, by place
    for kind, needs, pattern, make in KINDS:
        if needs.search(text):
            for m in chain(pattern.finditer(text), parts(kind, text) if kind in RUNS else ()):
                at = bisect_left(begins, m.end())
                if (not at or ends[at - 1] <= m.start()) and (new := make(p, m)) is not None:
                    taken.append((kind, m.start(), m.end(), new))
                    begins.insert(at, m.start())
                    ends.insert(at, m.end())
    return sorted(taken, key=lambda x: x[1])


def rewritten(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, begin, end, new in spans:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]])


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)


def findings(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the pseudonymised text, the number of findings and the findings themselves (places in the text as it was)."""

    def rows(batches: Iterator[pa.RecordBatch]):
        p = Pseudonyms(key)
        for batch in (x for whole in batches for x in slices(whole, 1)):
            texts, spans = [], []
            for raw in batch.column(1).to_pylist():
                text = None if raw is None else plain(raw)
                spans.append(found(text, p) if text else [])
                texts.append(rewritten(text, spans[-1]).encode() if spans[-1] else raw)
            yield {
                "doc_id": batch.column(0), "text": texts, "n_pii": [len(x) for x in spans],
                "pii": [[{"kind": k, "begin": a, "end": b, "pseudonym": n} for k, a, b, n in x] for x in spans],
            }

    out = arrow_stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), rows, "doc_id long, text binary, n_pii int, pii array<struct<kind string, begin int, end int, pseudonym string>>")
    return out.withColumn("text", F.col("text").cast("string"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The same rows and columns with pseudonyms in ``text``; a changed row's ``n_chars``, if there is one, follows its text."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in (x for whole in batches for x in slices(whole, at)):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            new = {}
            for i, raw in enumerate(texts):
                if raw and (spans := found(text := plain(raw), p)):
                    new[i] = rewritten(text, spans)
            if new:
                columns = list(batch.columns)
                columns[at] = pa.array([new[i].encode() if i in new else x for i, x in enumerate(texts)], pa.binary()).cast(pa.string(), safe=False)
                if chars is not None:
                    columns[chars] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(batch.column(chars).to_pylist())], batch.column(chars).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(handing_back(rows), docs.schema)


@query("op9_pseudonyms")
def op9_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return findings(read(spark, folder, "documents"), key_of(spark))
