"""Format-preserving pseudonyms for personal data: keyed Feistel permutations of validated values.

Values are found by pattern and must be valid: card numbers by Luhn, account numbers by mod 97, addresses
by their octets, dates by the calendar, social security numbers by their ranges, phone numbers by their
country and length, e-mail addresses by their parts. A value is permuted among
the valid values of its own format, by a key: letters stay letters of the same case, digits digits, signs
stay, check digits are made anew, dates stay dates. What is permuted is the value itself, the day, the national
number or the digits, and the result is written as the value was: equal values keep being equal in every
document, however they are written, and whoever has the key can undo it (``back``). So that a date can be
written like any other, dates are permuted among those whose month and day have as many digits, days over 12
among themselves.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import batch_of

ROUNDS = 10
# Alphabets that are permuted within themselves, the dates' range, and the months' names.
DIGITS, LOWER, UPPER, HEX, BASE32 = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
# Calling codes of one and two digits; all others have three. Words before what is a version, not an address.
CALLING = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
VERSION = re.compile(r"(?:\bv|\bver|version|release|build|firmware|revision)[.:#]? ?$", re.IGNORECASE)

#: Where a value can be; the patterns below run only around such places.
NEAR = re.compile(r"[0-9@]+|AKIA|ghp_|password|passwd|token|secret|api_?key", re.IGNORECASE)
REACH = 330
#: For each kind what a value looks like and what may not follow it; earlier kinds come first.
KINDS = {
    "email": (r"(?<![\w.+%-]) [A-Za-z0-9][A-Za-z0-9._%+-]{0,63} @ [A-Za-z0-9-]+ (?:\.[A-Za-z0-9-]+)* \.[A-Za-z]{2,24}", r"(?![\w@])"),
    "aws": (r"(?<![A-Za-z0-9]) AKIA [A-Z0-9]{16}", r"(?![A-Za-z0-9])"),
    "secret": (r'''(?: (?<=password=) | (?<=password:\ ) | (?<=passwd=) | (?<=token=) | (?<=secret=) | (?<=api_key=) | (?<=apikey=) | (?<=token\ =\ ") | (?<=secret\ =\ ") | (?<=api_key\ =\ ") ) [A-Za-z0-9_\-]{8,128}''', ""),
    "iban": (r"(?<![A-Za-z0-9]) [A-Z]{2}\d{2} (?:[ ]?[A-Z0-9]{4}){2,7} (?:[ ]?[A-Z0-9]{1,3})?", r"(?![A-Za-z0-9])"),
    "ip": (r"(?<![\w.]) \d{1,3} (?:\.\d{1,3}){3}", r"(?![\w]|\.\d)"),
    "iso": (r"(?<![\w-]) \d{4} (?P<is>[-/.]) \d{1,2} (?P=is) \d{1,2}", r"(?![\w-])"),
    "dmy": (r"(?<![\w./-]) \d{1,2} (?P<ds>[-/.]) \d{1,2} (?P=ds) \d{4}", r"(?![\w-])"),
    "ssn": (r"(?<![\w-]) \d{3}-\d{2}-\d{4}", r"(?![\w-])"),
    "card": (r"(?<![\w-]) \d (?:[ -]?\d){12,18}", r"(?![\w-])"),
    "phone": (r"(?<![\w+]) (?: \+\d{1,3}[ .-]? (?:\(\d{1,4}\)[ .-]?)? \d{2,4} (?:[ .-]?\d{2,4}){1,4} | \(\d{3}\)[ ]?\d{3}[ .-]\d{4} | \d{3}[.-]\d{3}[.-]\d{4} )", r"(?![\w])"),
}
PATTERN = re.compile("|".join(f"(?P<{kind}> {body} {after} )" for kind, (body, after) in KINDS.items()), re.VERBOSE)
BODY, AFTER, WHOLE = ({kind: re.compile(form.format(*parts), re.VERBOSE) for kind, parts in KINDS.items()} for form in ("{0}", "{1}", "{0} {1}"))
#: What comes before the groups of a phone number; groups of digits; characters of account numbers by country.
PREFIX, GROUPS = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?"), re.compile(r"\d+")
IBAN_CHARS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20".split()}


class Feistel:
    """Keyed permutations of number pairs, of strings position by position, and of ranges by cycle walking."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def _round(self, kind: str, i: int, half: int, sizes: tuple[int, int]) -> int:
        words = f"{kind}|{i}|{half}|{sizes}".encode()
        return int.from_bytes(hashlib.blake2b(words, key=self.key, digest_size=32 + sizes[i % 2].bit_length() // 8).digest())

    def pair(self, kind: str, a: int, b: int, sizes: tuple[int, int]) -> tuple[int, int]:
        halves, sign = [a, b], -1 if self.back else 1
        for i in range(ROUNDS - 1, -1, -1) if self.back else range(ROUNDS):
            halves[i % 2] = (halves[i % 2] + sign * self._round(kind, i, halves[1 - i % 2], sizes)) % sizes[i % 2]
        return halves[0], halves[1]

    def number(self, kind: str, x: int, size: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        """A permutation of the valid numbers under ``size``: walks on until one is met again."""
        low = max(1, int(size**0.5))
        high = -(-size // low)
        while True:
            a, b = self.pair(kind, x // low, x % low, (high, low))
            x = a * low + b
            if x < size and valid(x):
                return x

    def string(self, kind: str, text: str, alphabets: list[str]) -> str:
        """Permutes the characters that are in their position's alphabet, each within it; others stay."""
        places = [i for i, (c, letters) in enumerate(zip(text, alphabets, strict=True)) if c in letters]
        halves = (places[: len(places) // 2], places[len(places) // 2 :])
        if not places:
            return text
        numbers, sizes = [], []
        for half in halves:
            number, size = 0, 1
            for i in half:
                number, size = number * len(alphabets[i]) + alphabets[i].index(text[i]), size * len(alphabets[i])
            numbers.append(number)
            sizes.append(size)
        if len(places) > 1:
            numbers = self.pair(f"{kind}|{len(places)}", *numbers, tuple(sizes))
        else:  # no second half that a round could depend on
            numbers[1] = self.number(f"{kind}|1", numbers[1], sizes[1])
        out = list(text)
        for half, number in zip(halves, numbers, strict=True):
            for i in reversed(half):
                number, c = divmod(number, len(alphabets[i]))
                out[i] = alphabets[i][c]
        return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    doubled = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(digits))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _shorter_cards(digits: str) -> list[bool]:
    """Which of the first 13 to 16 digits of a longer number are a card number themselves."""
    return [luhn(digits[: n - 1]) == int(digits[n - 1]) for n in range(13, min(len(digits), 17))]


def mod97(country: str, rest: str) -> int:
    """The two check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _kinds(text: str) -> list[str]:
    return [DIGITS if c.isdigit() else LOWER if c in LOWER else UPPER if c in UPPER else "" for c in text]


def _refill(shape: str, values: str) -> str:
    """The characters of ``values`` in the places of letters and digits."""
    rest = iter(values)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def calling_code(digits: str) -> int:
    """How many of an international number's digits are its country's."""
    return next((n for n in (1, 2) if digits[:n] in CALLING), 3)


def _day_class(day: date) -> tuple[bool, int]:
    """Dates of one class have months, and days, of equally many digits; and days over 12 are told apart."""
    return day.month > 9, (day.day > 9) + (day.day > 12)


@lru_cache(maxsize=1)
def _days() -> dict[tuple[bool, int], list[date]]:
    out: dict[tuple[bool, int], list[date]] = {}
    for x in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1):
        out.setdefault(_day_class(day := date.fromordinal(x)), []).append(day)
    return out


def _is_email(local: str, domain: str) -> bool:
    return ".." not in local and local[-1] != "." and all(part and part[0] != "-" != part[-1] for part in domain.split("."))


def _recased(shape: str, text: str) -> str:
    return "".join(c.upper() if s.isupper() else c for s, c in zip(shape, text, strict=True))


class Pseudonymizer:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel = Feistel(key, back)
        self.value = lru_cache(maxsize=50_000)(self._value)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value that has its kind's pattern; None if it isn't a valid one."""
        f, plain = self.feistel, "".join(c for c in text if c.isalnum())
        if kind == "email":
            local, domain = text.lower().split("@")
            if not _is_email(local, domain):
                return None
            host, _, top = domain.rpartition(".")
            new = f"{f.string('email', local, _kinds(local))}@{f.string('host', host, _kinds(host))}.{top}"
            return _recased(text, new)
        if kind == "aws":
            letters = BASE32 if all(c in BASE32 for c in text[4:]) else DIGITS + UPPER
            return text[:4] + f.string(f"aws{len(letters)}", text[4:], [letters] * 16)
        if kind == "secret":
            return f.string("hex", text, [HEX] * len(text)) if all(c in HEX for c in text) else f.string("secret", text, _kinds(text))
        if kind == "iban":
            if len(plain) < 15 or len(plain) > 34 or mod97(plain[:2], plain[4:]) != int(plain[2:4]):
                return None
            rest = f.string(f"iban{plain[:2]}", plain[4:], _kinds(plain[4:]))
            return _refill(text, f"{plain[:2]}{mod97(plain[:2], rest):02d}{rest}")
        if kind == "ip":
            octets = text.split(".")
            if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
                return None
            x = f.number("ip", int.from_bytes(bytes(map(int, octets))), 1 << 32)
            return ".".join(map(str, x.to_bytes(4)))
        if kind in ("iso", "dmy"):
            return self._date(kind, text)
        if kind == "ssn":
            def valid(x: int) -> bool:
                area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
                return 0 < area < 900 and area != 666 and group > 0 and serial > 0

            x = int(plain)
            return _refill(text, f"{f.number('ssn', x, 10**9, valid):09d}") if valid(x) else None
        if kind == "card":
            if luhn(plain[:-1]) != int(plain[-1]):
                return None
            new, shorter = plain, _shorter_cards(plain)
            while True:  # walks on until a pseudonym would be cut where the value was
                body = f.string("card", new[:-1], [DIGITS] * (len(plain) - 1))
                new = body + str(luhn(body))
                if _shorter_cards(new) == shorter:
                    return _refill(text, new)
        digits = len(plain)
        if kind != "phone" or not 7 <= digits <= 15:
            return None
        country = calling_code(plain) if text[0] == "+" else 0
        return _refill(text, plain[:country] + f.string("phone", plain[country:], [DIGITS] * (digits - country)))

    def _date(self, kind: str, text: str) -> str | None:
        parts = re.split(r"([-/.])", text)
        fields = parts[::2]
        orders = [(0, 1, 2)] if kind == "iso" else [(2, 1, 0), (2, 0, 1)]  # year, month, day; day first unless only month first is a date
        for order in orders:
            try:
                day = date(*(int(fields[i]) for i in order))
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            own = _day_class(day)
            alike = _days()[own]
            new = alike[self.feistel.number(f"date{own}", bisect_left(alike, day), len(alike))]
            for i, value in zip(order, (new.year, new.month, new.day), strict=True):
                parts[2 * i] = str(value).zfill(len(fields[i]))
            return "".join(parts)
        return None

    def _at(self, text: str, start: int, stop: int, kinds: Iterable[str] = KINDS) -> tuple[int, str] | None:
        """Where the value that starts at a place ends, and its pseudonym: the first kind and end that make a valid one."""
        for kind in kinds:
            if kind == "ip" and VERSION.search(text, max(0, start - 12), start):
                continue
            if m := WHOLE[kind].match(text, start, stop):
                for end in self._ends(kind, text, start, m.end(), stop):
                    if (new := self.value(kind, text[start:end])) is not None:
                        return end, new
        return None

    def _ends(self, kind: str, text: str, start: int, end: int, stop: int) -> list[int]:
        """Where a value may end whose pattern reaches to ``end``, the likeliest first.

        Patterns with spaces run on over a number that follows. What decides is kept by pseudonyms (signs,
        countries, which numbers are valid), so that they are cut where the values were. Where a phone
        number and the next number are written alike throughout, they can't be told apart: the longest counts.
        """
        if kind not in ("iban", "card", "phone"):
            return [end]
        ends = [e for e in range(start + 1, end) if text[e - 1].isalnum() and not text[e].isalnum() and BODY[kind].fullmatch(text, start, e) and AFTER[kind].match(text, e, stop)]
        size = {e: sum(c.isalnum() for c in text[start:e]) for e in [*ends, end]}
        longest = [end, *reversed(ends)]
        if kind == "iban":
            return sorted(longest, key=lambda e: size[e] != IBAN_CHARS.get(text[start : start + 2]))
        if kind == "card":
            groups = [len(g) for g in GROUPS.findall(text, start, end)]
            if groups[0] < 4 <= max(groups):  # a short number before a card
                return []
            return [*(e for e in ends if size[e] <= 16 and text[e - 3 : e].isdigit()), end]
        first = [e for e in longest if size[e] == 11] if text.startswith("+1", start) and not text[start + 2].isdigit() else []
        first += [e for e in reversed(ends) if size[e] >= 7 and self._at(text, e + 1, stop, ("ip", "iso", "dmy", "ssn", "card"))]
        if prefix := PREFIX.match(text, start):
            signs = {e: {c for c in text[prefix.end() : e] if not c.isdigit()} for e in ends}
            first += [e for e in ends if size[e] >= 10 and text[e] == " " and signs[e] != {" "}]
        return [*first, *longest]

    def text(self, text: str | None) -> tuple[str | None, int]:
        """A text with its values replaced, and how many were."""
        if not text:
            return text, 0
        spans: list[list[int]] = []
        for m in NEAR.finditer(text):
            a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        out, at, n = [], 0, 0
        for a, b in spans:
            look = max(a, at)
            while m := PATTERN.search(text, look, b):
                found = self._at(text, m.start(), b)
                look = m.start() + 1
                if found:
                    out += [text[at : m.start()], found[1]]
                    at, n, look = found[0], n + 1, found[0]
        return "".join([*out, text[at:]]) if n else text, n


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text, n_values for each row of ``docs`` (doc_id, text): the text with pseudonyms and their number.

    With ``back`` the pseudonyms are turned to the values again. A null text stays null with 0 values; texts
    without values, empty ones too, are unchanged. Equal values have equal pseudonyms in all rows, repeated
    ones too. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymizer(key, back)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1):
                new, n = p.text(t.as_py())
                texts.append(new)
                counts.append(n)
            yield batch_of(schema, batch.column(0), texts, counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, n_values long")


def with_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in its text column; other columns as they are, null and empty texts too."""
    ready: list[Pseudonymizer] = []

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Pseudonymizer(key))
        return pa.array([ready[0].text(t.as_py())[0] for t in texts], pa.string())

    return docs.withColumn("text", replaced(F.col("text").cast("string")))


def session_key(spark: SparkSession) -> bytes:
    """The key of this session's runs: spark.weftwork.pseudonymKey; a published one, which hides nothing, where that is unset."""
    return spark.conf.get("spark.weftwork.pseudonymKey", "a published key for examples and tests").encode()
