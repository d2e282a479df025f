"""Pseudonyms of personal numbers, dates and addresses that keep their format, by keyed permutations.

A value is read as a number of the set of all valid values of its format, the number is permuted within the set by a Feistel
network under a key, and the result is written in the format of the original. So equal values get equal pseudonyms in all documents,
different values different ones, and check digits are right again.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import small_batches

ROUNDS = 10
DAYS_FROM, DAYS_TO = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: Days after the 12th before each month, and before the end.
_LATE = [0, *accumulate(calendar.monthrange(y, m)[1] - 12 for y in range(DAYS_FROM.year, DAYS_TO.year + 1) for m in range(1, 13))]
_MONTHS = "January February March April May June July August September October November December".split()

_EMAIL = r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
_IBAN = r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
_IP = r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
_DATE = r"(?P<date>(?<![\w/.-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}|(?i:MONTH) \d{1,2},? \d{4}|\d{1,2} (?i:MONTH),? \d{4})(?!\d|[/.-]\d))".replace("MONTH", "|".join(_MONTHS))
_SSN = r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d))"
_PHONE = r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?![\d])|(?<![\d(])\(\d{3}\) ?\d{3}[.-]\d{4}(?![\d])|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d]|[.-]\d))"
_CARD = r"(?P<card>(?<![\d])\d(?:[ -]?\d){12,18}(?![\d]))"
_ALL = (_EMAIL, _IBAN, _IP, _DATE, _SSN, _PHONE, _CARD)
VALUES = re.compile("|".join(_ALL), re.ASCII)
PATTERNS = {re.match(r"\(\?P<(\w+)>", p).group(1): re.compile(p, re.ASCII) for p in _ALL}

#: Digits behind the country codes whose numbers all have so many.
NATIONAL = {"1": 10, "7": 10, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "91": 10, "351": 9, "420": 9}


def permute(number: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A permutation of 0 .. size - 1: a Feistel network over enough bits, again until the result lies in the set."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, length = (1 << half) - 1, -(-half // 8)
    keyed = hashlib.blake2b(key=key[:64], person=kind.encode()[:16], digest_size=max(16, length))
    keyed.update(size.to_bytes(-(-size.bit_length() // 8), "big"))

    def f(r: int, x: int) -> int:
        h = keyed.copy()
        h.update(bytes([r]) + x.to_bytes(length, "big"))
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = number >> half, number & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ f(r, left), left
            else:
                left, right = right, left ^ f(r, right)
        number = left << half | right
        if number < size:
            return number


def luhn(digits: str) -> int:
    """The check digit behind these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _written(new: str, old: str, moved: Callable[[str], bool] = str.isdigit) -> str:
    """The new characters in the places of the old ones that are moved."""
    fresh = iter(new)
    return "".join(next(fresh) if moved(c) else c for c in old)


def _classes(text: str, turn: Callable[[int, int], int]) -> str:
    """Letters and digits as one number of mixed base, permuted; each stays a digit, a capital or a small letter."""
    bases = [(10, "0") if c.isdigit() else (26, "A") if c.isupper() else (26, "a") for c in text if c.isascii() and c.isalnum()]
    number, size = 0, 1
    for c, (base, zero) in zip((c for c in text if c.isascii() and c.isalnum()), bases):
        number, size = number * base + ord(c) - ord(zero), size * base
    number = turn(number, size)
    out = []
    for base, zero in reversed(bases):
        number, digit = divmod(number, base)
        out.append(chr(ord(zero) + digit))
    return _written("".join(reversed(out)), text, lambda c: c.isascii() and c.isalnum())


def _card(text: str, turn) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 1)
    body = str(turn(int(digits[:-1]), size)).zfill(len(digits) - 1)
    return _written(body + str(luhn(body)), text)


def _iban(text: str, turn) -> str | None:
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _classes(plain[4:], turn)
    check = 98 - value(body + plain[:2] + "00") % 97
    return _written(f"{plain[:2]}{check:02d}{body}", text, lambda c: c != " ")


def _ip(text: str, turn) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in parts):
        return None
    number = turn(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _late_day(day: datetime.date, turn) -> datetime.date:
    """A day after the 12th of its month, permuted among such days."""
    month = (day.year - DAYS_FROM.year) * 12 + day.month - 1
    number = turn(_LATE[month] + day.day - 13, _LATE[-1])
    month = bisect_right(_LATE, number) - 1
    return datetime.date(DAYS_FROM.year + month // 12, month % 12 + 1, number - _LATE[month] + 13)


def _any_day(day: datetime.date, turn) -> datetime.date:
    return DAYS_FROM + datetime.timedelta(turn((day - DAYS_FROM).days, (DAYS_TO - DAYS_FROM).days + 1))


def _named_date(text: str, turn) -> str | None:
    a, gap, b, rest, year = re.fullmatch(r"(\w+)( )(\w+)(,? )(\d{4})", text).groups()
    name, number = (a, b) if b.isdigit() else (b, a)
    try:
        day = datetime.date(int(year), _MONTHS.index(name.title()) + 1, int(number))
    except ValueError:
        return None
    if not DAYS_FROM <= day <= DAYS_TO:
        return None
    new = _any_day(day, turn)
    month = _MONTHS[new.month - 1]
    month = month.upper() if name.isupper() else month.lower() if name.islower() else month
    own = {name: month, number: str(new.day).zfill(len(number))}
    return f"{own[a]}{gap}{own[b]}{rest}{new.year:04d}"


def _date(text: str, turn) -> str | None:
    """The order in which numbers can be read is kept: what can be read in the usual order of its form is written in it, for any day; what
    only the other order allows has a day after the 12th, and so has its pseudonym. So no two days share one."""
    if any(c.isalpha() for c in text):
        return _named_date(text, turn)
    a, sep, b, _, c = re.split(r"([-/.])", text)
    ways = [("y", "m", "d")] if len(a) == 4 else [("m", "d", "y"), ("d", "m", "y")] if sep == "/" else [("d", "m", "y"), ("m", "d", "y")]
    for usual, way in zip((True, False), ways):
        got = dict(zip(way, (a, b, c)))
        try:
            day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"]))
        except ValueError:
            continue
        if not DAYS_FROM <= day <= DAYS_TO:
            continue
        # Numbers of one digit stay so only where the new ones allow it.
        new = _any_day(day, turn) if usual else _late_day(day, turn)
        fields = {"y": f"{new.year:04d}", "m": str(new.month).zfill(len(got["m"])), "d": str(new.day).zfill(len(got["d"]))}
        return sep.join(fields[x] for x in way)
    return None


def _ssn(text: str, turn) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    number = turn((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    place, rest = divmod(number, 99 * 9999)
    area = place + 1 + (place + 1 >= 666)
    return f"{area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def _phone(text: str, turn) -> str | None:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)
    head = code.group() if code else ""
    digits = re.sub(r"\D", "", text[len(head) :])
    if not 7 <= len(digits) or len(digits) + len(head) > 16:
        return None
    return head + _written(str(turn(int(digits), 10 ** len(digits))).zfill(len(digits)), text[len(head) :])


def _email(text: str, turn) -> str | None:
    local, _, domain = text.partition("@")
    return f"{_classes(local, turn)}@{domain}"


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _phone_end(text: str) -> int:
    """Where a phone number ends by its own grouping: at its country's number of digits; else at a blank behind seven digits or more of
    which the last groups are joined by - or ., or of which the last group has six or more."""
    head = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
    if not head:
        return len(text)
    ends, digits, before = [], 0, ""
    for m in re.finditer(r"\d+", text[head.end() :]):
        digits += len(m.group())
        ends.append((head.end() + m.end(), digits, before, len(m.group())))
        before = text[head.end() + m.end() : head.end() + m.end() + 1]
    for end, n, _, _ in ends:
        if n == NATIONAL.get(head.group(1)):
            return end
    for end, n, joint, group in ends:
        if n >= 7 and text[end : end + 1] == " " and (joint in ("-", ".") or group >= 6):
            return end
    return len(text)


def _ends(text: str, m: re.Match, kind: str) -> list[int]:
    """Where the value that begins at a match may end: at the match's end or at the end of a group in it; the likeliest first."""
    start, stop = m.span()
    if kind not in ("iban", "phone", "card"):
        return [stop]
    ends = [i for i in range(start + 1, stop) if text[i] in " .-" and text[i - 1].isalnum()] + [stop]
    own = start + _phone_end(m.group()) if kind == "phone" else 0

    def order(end: int) -> tuple:
        # A month of an expiry date is no part of a number, and a number begun in one piece ends with it.
        expiry = text[end : end + 1] == "/" and text[end + 1 : end + 2].isdigit() and re.search(r"[ .-]\d\d?$", text[start:end], re.ASCII) is not None
        one = end == ends[0]
        return expiry, kind == "phone" and end != own, kind != "phone" and not one, kind == "card" and sum(map(str.isdigit, text[start:end])) != 16, -end

    return sorted(ends, key=order)


def _value(text: str, m: re.Match, kind: str, key: bytes, later: bool) -> tuple[int, str, str] | None:
    """End, kind and pseudonym of the value of a kind that begins at a match of it, None if there is none.

    later: the match begins inside one that was none.
    """
    turn = lambda kind: lambda number, size: permute(number, size, key, kind)
    start, stop = m.span()
    for end in _ends(text, m, kind):
        if end != stop and not PATTERNS[kind].fullmatch(text, start, end):
            continue
        value = text[start:end]
        if kind == "card" and (later or end != stop):
            # Rows of short numbers would often pass a check of one digit.
            groups = re.split("[ -]", value)
            if any(len(g) < 4 for g in groups[:-1]) and (later or sum(map(len, groups)) != 16):
                continue
        new = KINDS[kind](value, turn(kind))
        if new is not None:
            # What is cut off a phone number of too many digits may be a card's.
            if kind == "phone" and end != start + _phone_end(m.group()) and _card_inside(text, m, key):
                continue
            return end, kind, new
        if kind == "phone" and (new := _card(value, turn("card"))) is not None:  # a card number that looks like a phone number
            return end, "card", new
    return None


def _card_inside(text: str, m: re.Match, key: bytes) -> bool:
    """Whether a card number begins inside a match and goes on beyond what the match's value would be."""
    at = m.start() + 1
    while (card := PATTERNS["card"].search(text, at)) and card.start() < m.end():
        if _value(text, card, "card", key, True):
            return True
        at = card.start() + 1
    return False


def _first_value(text: str, m: re.Match, key: bytes, later: bool) -> tuple[int, str, str] | None:
    """The value that begins at a match: of the kind matched, else of another one."""
    kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m.group(k) is not None)
    if (found := _value(text, m, kind, key, later)) is not None:
        return found
    for other in KINDS:
        if other != kind and (also := PATTERNS[other].match(text, m.start())) and (found := _value(text, also, other, key, later)) is not None:
            return found
    return None


def pseudonymize(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and what was replaced: start, end (characters of the original), kind, pseudonym.

    Patterns take as much as may belong to a value. Where that fails its check, shorter values are tried that end with a group of it,
    then the other kinds, and then the search goes on behind the first character, so a value is found beside any other numbers.
    """
    out, spans, last, at, failed = [], [], 0, 0, 0
    while m := VALUES.search(text, at):
        found = _first_value(text, m, key, m.start() < failed)
        if found is None:
            at, failed = m.start() + 1, max(failed, m.end())
            continue
        end, kind, new = found
        out += [text[last : m.start()], new]
        spans.append({"start": m.start(), "end": end, "kind": kind, "pseudonym": new})
        last = at = end
    return "".join([*out, text[last:]]), spans


def mask(docs: DataFrame, key: bytes, text: str = "text", spans: str = "spans") -> DataFrame:
    """The documents with all their columns, pseudonyms in their texts, and a column of what was replaced: structs start, end, kind, pseudonym.

    Replaced are, if valid: payment cards (Luhn), IBANs (modulo 97), IPv4 addresses, dates from 1900 to 2099 in numbers with
    four-digit years or with English month names, US social security phone numbers, and the local parts of mail addresses, whose domain stays. Whole texts count, however long. Only texts with
    a digit or @ go through Python.

    Numbers and capitals behind a value stay. A card of 13 to 19 digits beside other numbers is found if its groups but the last have four
    digits or more, or if it has 16 digits and stands first. Where a country's phone numbers differ in length and are grouped by blanks
    alone, short numbers behind one count as its last groups.

    Null texts stay null and empty ones empty, with no spans. Rows that repeat get equal results. A column that has the name of
    ``spans`` is replaced. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = "struct<text string, spans array<struct<start int, end int, kind string, pseudonym string>>>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [pseudonymize(x, key) if x is not None else (None, None) for x in texts]
        return pd.DataFrame({"text": [x[0] for x in done], "spans": [x[1] for x in done]})

    worth = F.col(text).rlike("[0-9@]")
    rows = docs.select(F.struct("*").alias("row"), run(F.when(worth, F.col(text))).alias("made"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,pseudonym:string>>")
    row = F.col("row").withField(text, F.coalesce("made.text", F.col(f"row.{text}"))).withField(spans, F.coalesce("made.spans", none))
    return rows.select(row.alias("row")).select("row.*")
