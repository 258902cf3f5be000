"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and addresses are found by pattern and validated: card numbers by their check digit, IBANs by theirs, dates by the calendar, IPv4
addresses by their ranges, telephone numbers by their digits. Each value is permuted within its format: every digit, small
letter and capital keeps its place and kind, and check digits are made right again. The permutation is a Feistel network over
the value's own mixed-radix digits, keyed by the secret key, the kind and the shape of the value. It is one-to-one, so equal values stay equal in
all documents and different ones stay different; ``restored`` undoes it with the key.

A value beside other numbers or words is looked for at the token boundaries of the whole match: cards first in their usual groups, IBANs first at
their country's length. Where the new digits would make the surroundings read otherwise, the value is permuted once more; there alone
equal values may part.

Values that do not validate are left alone. Null texts stay null with no values. Repeated rows get equal results. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.session import ship_package

#: For tests and examples only; give your own.
KEY = b"change me"
ROUNDS = 8
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters beyond ASCII that names of mailboxes may hold.
OTHER = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
PLACE = {c: (alphabet, i) for alphabet in (DIGITS, SMALL, LARGE, OTHER) for i, c in enumerate(alphabet)}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

class MailPattern:
    """Mail addresses, read outwards from each ``@``: a long word without one costs nothing, and one before it is read once."""

    INSIDE, NAMED, WHOLE = re.compile(r"[\w.+-]"), re.compile(r"[^\W_]"), re.compile(r"[\w.+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")

    def search(self, text: str, at: int) -> re.Match | None:
        middle = text.find("@", at)
        while middle >= 0:
            start = middle
            while start > at and self.INSIDE.match(text, start - 1):
                start -= 1
            m = self.WHOLE.match(text, start) if self.NAMED.search(text, start, middle) else None
            if m:
                return m
            middle = text.find("@", middle + 1)
        return None


# The patterns, and the lengths of IBANs and card numbers.
PATTERNS = {
    "email": MailPattern(),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    "date": re.compile(r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}([./])\d{2}\1\d{4})(?![./-]?\d)"),
    "phone": re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
        r"|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\w-])"
    ),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\d])\d(?:[ -]?\d){12,18}(?!\d)"),
}
#: Card numbers as they are usually written; other groupings are tried after these.
CARDS = [
    re.compile(rf"(?<!\d){form}(?!\d)") for form in (r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{6}\1\d{4,5}", r"\d{13,19}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}")
]
#: First digits of card numbers, asked for where only a part of a run of numbers is taken, in groups of three digits or more.
ISSUERS = "23456"
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 "
        "PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Characters around a value that are read again once it has changed.
AROUND = 96
BESIDE = re.compile(r"[A-Z0-9]")
MAY_HOLD = re.compile(r"[0-9@]")


class Permutation:
    """Keyed permutations of numbers below a product of two sizes."""

    def __init__(self, key: bytes):
        self.key = key

    def _noise(self, tweak: str, i: int, half: int, size: int) -> int:
        said = hmac.new(self.key, f"{tweak}|{i}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(said, "big") % size

    def pair(self, a: int, b: int, sizes: tuple[int, int], tweak: str, back: bool = False) -> tuple[int, int]:
        """Each round adds noise made of one half to the other, within its size."""
        sign = -1 if back else 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                b = (b + sign * self._noise(tweak, i, a, sizes[1])) % sizes[1]
            else:
                a = (a + sign * self._noise(tweak, i, b, sizes[0])) % sizes[0]
        return a, b

    def number(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """A number below ``size``; steps outside are walked on until they fall inside."""
        low = 1 << (max(size - 1, 1).bit_length() + 1) // 2
        high = -(-size // low)
        while True:
            a, b = self.pair(x // low, x % low, (high, low), tweak, back)
            x = a * low + b
            if x < size:
                return x

    def text(self, value: str, tweak: str, back: bool = False) -> str:
        """Digits and letters change within their alphabets; all else stays."""
        places = [i for i, c in enumerate(value) if c in PLACE]
        if not places:
            return value
        radix = [len(PLACE[value[i]][0]) for i in places]
        if len(places) == 1:
            alphabet, at = PLACE[value[places[0]]]
            new = [self.number(at, radix[0], tweak, back)]
        else:
            cut = len(places) // 2
            halves, sizes = [], []
            for part, bases in ((places[:cut], radix[:cut]), (places[cut:], radix[cut:])):
                x, size = 0, 1
                for i, base in zip(part, bases, strict=True):
                    x, size = x * base + PLACE[value[i]][1], size * base
                halves.append(x)
                sizes.append(size)
            shape = "".join(PLACE[c][0][0] if c in PLACE else c for c in value)
            halves = list(self.pair(*halves, tuple(sizes), f"{tweak}|{shape}", back))
            new = []
            for x, bases in zip(halves, (radix[:cut], radix[cut:]), strict=True):
                digits = []
                for base in reversed(bases):
                    x, d = divmod(x, base)
                    digits.append(d)
                new += reversed(digits)
        out = list(value)
        for i, d in zip(places, new, strict=True):
            out[i] = PLACE[value[i]][0][d]
        return "".join(out)


class _Unchanged(Permutation):
    """Leaves every value as it is; for asking whether one is valid."""

    def number(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        return x

    def text(self, value: str, tweak: str, back: bool = False) -> str:
        return value


UNCHANGED = _Unchanged(b"")


def _check_digit(digits: str) -> str:
    """The digit that makes a card number valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _card_valid(value: str) -> bool:
    digits = [c for c in value if c.isdigit()]
    return _check_digit("".join(digits[:-1])) == digits[-1] and len(set(digits)) > 1


def _card(p: Permutation, value: str, back: bool) -> str | None:
    if not _card_valid(value):
        return None
    digits = [c for c in value if c.isdigit()]
    new = p.text("".join(digits[:-1]), "card", back)
    if len(set(new)) == 1 and _check_digit(new) == new[0]:  # such numbers are left alone, so none may become one
        new = p.text(new, "card", back)
    fresh = iter(new + _check_digit(new))
    return "".join(next(fresh) if c.isdigit() else c for c in value)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and _iban_rest(plain) == 1 and 2 <= int(plain[2:4]) <= 98


def _iban(p: Permutation, value: str, back: bool) -> str | None:
    if not _iban_valid(value):
        return None
    plain = value.replace(" ", "")
    body = p.text(plain[4:], "iban" + plain[:2], back)
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    fresh = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(fresh) for c in value)


def _ip(p: Permutation, value: str, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in parts):
        return None
    x = p.number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(p: Permutation, value: str, back: bool) -> str | None:
    kind = "%Y-%m-%d" if value[4] == "-" else f"%d{value[2]}%m{value[2]}%Y"
    month_first = f"%m{value[2]}%d{value[2]}%Y"
    for form in (kind, month_first) if value[2] == "/" else (kind,):
        try:
            day = datetime.datetime.strptime(value, form).date().toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = FIRST_DAY + p.number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date" + form, back)
        date = datetime.date.fromordinal(new)
        if form != kind and date.day <= 12:  # month first: days up to 12 would be read the other way
            while date.day <= 12:
                new = FIRST_DAY + p.number(new - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date" + form, back)
                date = datetime.date.fromordinal(new)
        return date.strftime(form)
    return None


def _phone_valid(value: str) -> bool:
    return 8 <= sum(c.isdigit() for c in value) <= 15


def _phone(p: Permutation, value: str, back: bool) -> str | None:
    if not _phone_valid(value):
        return None
    code = re.match(r"\+\d{1,3}(?=\D)|\+\d|", value).group()
    return code + p.text(value[len(code) :], "phone" + code, back)


def _ssn(p: Permutation, value: str, back: bool) -> str | None:
    """Area, group and serial within their valid ranges."""
    a, g, s = int(value[:3]), int(value[4:6]), int(value[7:])
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    x = p.number(x, 898 * 99 * 9999, "ssn", back)
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _email(p: Permutation, value: str, back: bool) -> str | None:
    local, _, domain = value.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{p.text(local, 'mailbox', back)}@{p.text(host, 'host', back)}.{top}"


KINDS: dict[str, Callable[[Permutation, str, bool], str | None]] = {
    "email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card,
}


VALID: dict[str, Callable[[str], bool]] = {"card": _card_valid, "iban": _iban_valid, "phone": _phone_valid}


def _shorter(kind: str, text: str, m: re.Match) -> list[tuple[int, int]]:
    """Where else than in the whole match a value may stand: at other token boundaries of it, the likeliest first."""
    tokens = [(t.start() + m.start(), t.end() + m.start()) for t in TOKEN.finditer(m.group())]
    if kind == "card":
        places = [(a, b) for i, (a, x) in enumerate(tokens) for _, b in tokens[i:] if text[a] in ISSUERS and all(y - x >= 3 for x, y in tokens if a <= x < b)]
        return sorted(places, key=lambda x: (-sum(c.isdigit() for c in text[slice(*x)]), x))
    ends = [b for _, b in reversed(tokens)]
    if kind == "iban":
        ends.sort(key=lambda b: len(text[m.start() : b].replace(" ", "")) != IBAN_LENGTHS.get(text[m.start() : m.start() + 2]))
    return [(m.start(), b) for b in ends]


def _places(text: str) -> list[tuple[int, int, str]]:
    """Where valid values stand; earlier kinds go first. A match that fails or meets another value is tried at its inner boundaries."""
    found: list[tuple[int, int, str]] = []
    cards: list[tuple[int, int]] | None = None
    for kind, pattern in PATTERNS.items():
        taken = sorted((a, b) for a, b, _ in found)

        def fits(a: int, b: int) -> bool:
            i = bisect.bisect(taken, (b, -1))
            if i and taken[i - 1][1] > a:
                return False
            if kind == "phone" and any(x < b < y and a < x for x, y in cards or ()):  # a telephone number does not end in a card number
                return False
            return VALID[kind](text[a:b]) if kind in VALID else KINDS[kind](UNCHANGED, text[a:b], False) is not None

        for usual in (*CARDS, pattern) if kind == "card" else (pattern,):
            at = 0
            while m := usual.search(text, at):
                if kind == "phone" and cards is None:
                    starts = [x.start() for x in TOKEN.finditer(text) if x[0].isdigit()]
                    cards = [x.span() for a in starts for x in (p.match(text, a) for p in CARDS) if x and _card_valid(x.group())]
                hit = m.span() if kind != "iban" and fits(*m.span()) else None
                at = m.end()
                if hit is None and kind in VALID:
                    if usual is pattern:
                        hit = next((x for x in _shorter(kind, text, m) if usual.fullmatch(text, *x) and fits(*x)), None)
                    at = hit[1] if hit else TOKEN.search(text, m.start()).end()
                if hit:
                    found.append((*hit, kind))
                    bisect.insort(taken, hit)
    return sorted(found)


def replaced(text: str, p: Permutation, back: bool = False) -> tuple[str, dict[str, int], list[tuple[str, int, int]]]:
    """The text with its values permuted, how many of each kind, and where they stood."""
    if not MAY_HOLD.search(text):
        return text, {}, []
    places, counts = _places(text), {}
    for _, _, kind in places:
        counts[kind] = counts.get(kind, 0) + 1
    chained = [x for x in places if x[2] in VALID]
    if back:
        for place in reversed(chained):
            text = _walked(text, place, p, back)
    out, at, moved, ends = [], 0, {}, 0
    for a, b, kind in places:
        new = text[a:b] if kind in VALID else KINDS[kind](p, text[a:b], back)
        moved[a, b, kind] = a + ends
        ends += len(new) - (b - a)
        out += [text[at:a], new]
        at = b
    text = "".join([*out, text[at:]])
    if not back:
        for a, b, kind in chained:
            start = moved[a, b, kind]
            text = _walked(text, (start, start + b - a, kind), p, back)
    return text, counts, [(kind, a, b) for a, b, kind in places]


def _walked(text: str, place: tuple[int, int, str], p: Permutation, back: bool) -> str:
    """One value permuted in its text; permuted again while the new digits would make its surroundings read otherwise, so that it can be undone."""
    a, b, kind = place
    before, value, after = text[max(a - AROUND, 0) : a], text[a:b], text[b : b + AROUND]
    as_read = None
    while True:
        value = KINDS[kind](p, value, back)
        if not BESIDE.search(before[-3:] + after[:3]):
            break
        as_read = as_read or _places(before + text[a:b] + after)
        if _places(before + value + after) == as_read:
            break
    return text[:a] + value + text[b:]


def pseudonymised(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """``doc_id, text, n_values`` and the number and places of each kind; ``back`` restores a pseudonymised table."""
    ship_package(docs.sparkSession)
    kinds = list(KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            texts, counts, spans = [], [], []
            for text in batch["text"].to_pylist():
                new, n, at = (None, {}, []) if text is None else replaced(text, p, back)
                texts.append(new)
                counts.append([n.get(k, 0) for k in kinds])
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in at))
            columns = [batch["doc_id"], pa.array(texts, pa.string()), pa.array([sum(c) for c in counts], pa.int64())]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(kinds))]
            names = ["doc_id", "text", "n_values", *(f"n_{k}" for k in kinds), "spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.string())], names)

    schema = "doc_id long, text string, n_values long, " + ", ".join(f"n_{k} long" for k in kinds) + ", spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def restored(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The texts before ``pseudonymised``."""
    return pseudonymised(docs, key, back=True).select("doc_id", "text")
