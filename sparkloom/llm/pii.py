"""Personal numbers, dates and addresses, replaced by keyed pseudonyms of their own format.

A value that passes its kind's check (Luhn for cards, mod 97 for IBANs, the calendar for
dates, assigned ranges for social security numbers, octets for IPv4) is read as a number
in the kind's domain, permuted there by a balanced Feistel network with keyed BLAKE2
rounds, walked on until it is a valid value again, and written back with the separators
and the case it had. The permutation hangs on the key, the kind and the format's size
alone, so equal values stay equal in all documents and different ones stay different,
and whoever has the key can take it back (``reveal``). No value is its own pseudonym:
a value's number is permuted, moved on by one and permuted back (cards, of which there are
10^11 and more, are permuted once). Phones are linked with
and without +1; dates are not linked across the order of year and day, nor local parts
across cases, which are different values here.

    card    13 to 19 digits, single spaces or hyphens between them; the first digit stays
    iban    country and two check digits, then letters and digits, each kept as such
    ssn     ddd-dd-dddd
    phone   [+1] (ddd) ddd-dddd and its usual spellings; without +1 area and exchange
            begin with 2 to 9
    date    yyyy-mm-dd, or two-digit day and month in either order with / or . or -, then yyyy
    ip      four octets
    email   letters and digits of the local part; the rest stays

A card or an IBAN may be followed by more digits or words. Where several readings of one
place pass the check, usual ones count first (cards of 4-4-4-4-3, 4-4-4-4, 4-6-5 and 4-6-4
digits or without separators; an IBAN of its country's length), then the longest that ends
at a separator; one in no usual grouping counts only where no other kind and no usual card
begins. Where a pseudonym makes a reading valid that counts before its own, which takes an
unusual grouping or three more digits behind a card, ``reveal`` takes that one.

Numbers that fail the check are left as they are. Where kinds overlap the one that begins
first counts, and of those the one first in the list.

Defined cases: null stays null, empty stays empty; texts of any length are read whole;
repeated rows and extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Callable
from hashlib import blake2b
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import fresh

ROUNDS = 10
#: For tests and demonstrations; a deployment passes its own.
DEMO_KEY = b"not a secret"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _feistel(value: int, size: int, key: bytes, tweak: str, back: bool) -> int:
    """One pass over the square that holds ``size``."""
    side = isqrt(size - 1) + 1
    left, right = divmod(value, side)

    def f(r: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{size}|{r}|{x}".encode(), key=key, digest_size=16).digest(), "big") % side

    if back:
        for r in reversed(range(ROUNDS)):
            left, right = (right - f(r, left)) % side, left
    else:
        for r in range(ROUNDS):
            left, right = right, (left + f(r, right)) % side
    return left * side + right


def permute(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
    """A keyed permutation of the valid numbers under ``size``: the Feistel network is walked until it meets one."""
    while True:
        value = _feistel(value, size, key, tweak, back)
        if value < size and valid(value):
            return value


def moved(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
    """A keyed permutation of the valid numbers under ``size`` that leaves none (of two or more) where it is."""
    value = permute(value, size, key, tweak, valid)
    while True:
        value = (value + (-1 if back else 1)) % size
        if valid(value):
            return permute(value, size, key, tweak, valid, True)


def luhn(digits: str) -> int:
    """The check digit that these digits need."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 * (n > 9)
    return -total % 10


def _filled(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in pattern)


def _only(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _by_class(text: str, key: bytes, tweak: str, back: bool) -> str:
    """ASCII letters and digits permuted together, each within its class."""
    sets = [s for c in text for s in (_DIGITS, _LOWER, _UPPER) if c in s]
    size, value = 1, 0
    for c in text:
        for s in (_DIGITS, _LOWER, _UPPER):
            if c in s:
                value, size = value * len(s) + s.index(c), size * len(s)
    if size < 2:
        return text
    shape = "".join("dlu"[(_DIGITS, _LOWER, _UPPER).index(s)] for s in sets)
    value = moved(value, size, key, f"{tweak}|{shape}", back=back)
    out = []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    it = reversed(out)
    return "".join(next(it) if any(c in s for s in (_DIGITS, _LOWER, _UPPER)) else c for c in text)


def _card(t: str, key: bytes, back: bool) -> str | None:
    d = _only(t)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None

    def valid(v: int) -> bool:
        body = d[0] + f"{v:0{n}d}"
        return len(set(body + str(luhn(body)))) > 1

    n = len(d) - 2
    body = d[0] + f"{permute(int(d[1:-1]), 10**n, key, f'card|{d[0]}', valid, back):0{n}d}"
    return _filled(t, body + str(luhn(body)))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def _iban(t: str, key: bytes, back: bool) -> str | None:
    d = t.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_check(d[:2], d[4:]) != d[2:4]:
        return None
    body = _by_class(d[4:], key, f"iban|{d[:2]}", back)
    it = iter(d[:2] + _iban_check(d[:2], body) + body)
    return "".join(c if c == " " else next(it) for c in t)


def _ssn_valid(v: int) -> bool:
    area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(t: str, key: bytes, back: bool) -> str | None:
    if not _ssn_valid(v := int(_only(t))):
        return None
    area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
    # The valid numbers in a row, without gaps: 898 areas, 99 groups, 9999 serials.
    v = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    area, v = divmod(moved(v, 898 * 99 * 9999, key, "ssn", back=back), 99 * 9999)
    return _filled(t, f"{area + 1 + (area >= 665):03d}{v // 9999 + 1:02d}{v % 9999 + 1:04d}")


def _phone(t: str, key: bytes, back: bool) -> str | None:
    lead = "1" if t.startswith("+1") else ""
    d = _only(t)[len(lead) :]

    def valid(v: int) -> bool:
        s = f"{v:010d}"
        return s[0] >= "2" and s[3] >= "2"

    if valid(int(d)):  # in a row, without gaps
        v = ((int(d[0]) - 2) * 100 + int(d[1:3])) * 8 * 10**6 + (int(d[3]) - 2) * 10**6 + int(d[4:])
        area, v = divmod(moved(v, 64 * 10**8, key, "phone", back=back), 8 * 10**6)
        return _filled(t, lead + f"{area + 200:03d}{v + 2 * 10**6:07d}")
    return _filled(t, lead + f"{permute(int(d), 10**10, key, 'phone|1', lambda v: not valid(v), back):010d}") if lead else None


def _day(year: int, month: int, day: int) -> bool:
    return 1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]


def _date(t: str, key: bytes, back: bool) -> str | None:
    if t[4] in "-/.":  # year first
        year, a, b = int(t[:4]), int(t[5:7]), int(t[8:])

        def valid(v: int) -> bool:
            return _day(1900 + v // 1024, v // 32 % 32, v % 32)

        write = lambda y, a, b: f"{y:04d}{t[4]}{a:02d}{t[7]}{b:02d}"
    else:
        a, b, year = int(t[:2]), int(t[3:5]), int(t[6:])

        def valid(v: int) -> bool:
            y, a, b = 1900 + v // 1024, v // 32 % 32, v % 32
            return _day(y, a, b) or _day(y, b, a)

        write = lambda y, a, b: f"{a:02d}{t[2]}{b:02d}{t[5]}{y:04d}"
    v = (year - 1900) * 1024 + a * 32 + b
    if not 0 <= v < 200 * 1024 or a > 31 or b > 31 or not valid(v):
        return None
    v = moved(v, 200 * 1024, key, f"date|{t[4] in '-/.'}", valid, back)
    return write(1900 + v // 1024, v // 32 % 32, v % 32)


def _ip(t: str, key: bytes, back: bool) -> str | None:
    parts = t.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = 0
    for p in parts:
        v = v * 256 + int(p)
    return ".".join(map(str, moved(v, 1 << 32, key, "ip", back=back).to_bytes(4, "big")))


def _email(t: str, key: bytes, back: bool) -> str | None:
    local, _, host = t.partition("@")
    return f"{_by_class(local, key, 'email', back)}@{host}"


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "date": _date, "ip": _ip, "email": _email}

_NUMBERS = re.compile(
    r"""(?<![\w.])(?<![0-9][+-])(?=[+(0-9])(?:
    (?P<card>[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<date>[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}(?!\w|[-/.][0-9])|[0-9]{2}(?P<s2>[-/.])[0-9]{2}(?P=s2)[0-9]{4}(?!\w|[-/.][0-9]))
    |(?P<phone>(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w|-[0-9]))
    |(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
    )""",
    re.VERBOSE,
)
_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?!\w)")
#: Characters of an IBAN by country.
_IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 "
        "NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_IBAN_START = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}[ A-Z0-9]")
#: What stands at a card's place if it is none, and cards in their usual groupings.
_OTHERS = re.compile(re.sub(r"\(\?P<card>.*\n\s*\|", "", _NUMBERS.pattern), re.VERBOSE)
_USUAL = (
    re.compile(r"[0-9]{4}([ -])(?:[0-9]{4}\1){3}[0-9]{3}(?!\w)"),
    re.compile(r"[0-9]{4}([ -])(?:[0-9]{4}\1){2}[0-9]{4}(?![0-9])"),
    re.compile(r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    re.compile(r"[0-9]{13,19}(?![0-9])"),
)
_DIGIT_RUN = re.compile(r"[0-9]{2}|[0-9]\.[0-9]")


def _usual_card(text: str, at: int, key: bytes, back: bool) -> tuple[str, int, str] | None:
    for usual in _USUAL:
        if (m := usual.match(text, at)) and (new := _card(m.group(), key, back)) is not None:
            return "card", m.end(), new
    return None


def _number(text: str, m: re.Match, key: bytes, back: bool) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value that begins where ``m`` does: of all its readings the first that passes its check."""
    if m.group("card"):
        if found := _usual_card(text, m.start(), key, back):
            return found
        if (new := _card(m.group(), key, back)) is not None:
            return "card", m.end(), new
        other = _OTHERS.match(text, m.start())
    else:
        other = m
    if other:
        kind = next(k for k in ("ssn", "date", "phone", "ip") if other.group(k))
        if (new := KINDS[kind](other.group(), key, back)) is not None:
            return kind, other.end(), new
    if m.group("card"):
        cuts = [i for i in range(m.start(), m.end()) if text[i] in " -"]
        for end in reversed(cuts):
            if (new := _card(text[m.start() : end], key, back)) is not None:
                if any(_begins(text, i + 1, key, back) for i in cuts if i < end):
                    return None
                return "card", end, new
    return None


def _begins(text: str, at: int, key: bytes, back: bool) -> bool:
    """Whether a card in a usual grouping or a value of another kind begins here, where a search would find it."""
    if not (m := _NUMBERS.match(text, at)):
        return False
    if m.group("card") and _usual_card(text, at, key, back):
        return True
    other = _OTHERS.match(text, at)
    return other is not None and any(other.group(k) and KINDS[k](other.group(), key, back) is not None for k in ("ssn", "date", "phone", "ip"))


def _ibans(text: str, key: bytes, back: bool) -> list[tuple[str, int, int, str]]:
    out, at = [], 0
    while m := _IBAN.search(text, at):
        ends = [i for i in range(m.start() + 15, m.end()) if text[i] == " "] + [m.end()]
        length = _IBAN_LENGTH.get(m.group()[:2])
        ends.sort(key=lambda e: (e - m.start() - text.count(" ", m.start(), e) != length, -e))
        at = m.start() + 4
        for end in ends:
            if (new := _iban(text[m.start() : end], key, back)) is not None:
                out.append(("iban", m.start(), end, new))
                at = end
                break
    return out


def found_in(text: str, key: bytes = DEMO_KEY, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of each value that passes its check, in order."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end(), _email(m.group(), key, back)) for m in _EMAIL.finditer(text)]
    if _DIGIT_RUN.search(text):
        at = 0
        while m := _NUMBERS.search(text, at):
            if found := _number(text, m, key, back):
                kind, at, new = found
                out.append((kind, m.start(), at, new))
            else:
                at = _after(text, m)
        if _IBAN_START.search(text):
            out += _ibans(text, key, back)
    order = list(KINDS)
    kept: list[tuple[str, int, int, str]] = []
    for f in sorted(out, key=lambda f: (f[1], order.index(f[0]))):
        if not kept or f[1] >= kept[-1][2]:
            kept.append(f)
    return kept


def _after(text: str, m: re.Match) -> int:
    """Where to go on behind a number that failed its check: its first separator."""
    i = m.start() + 1
    while i < m.end() and text[i] in _DIGITS:
        i += 1
    return i


def rewritten(text: str, found: list[tuple[str, int, int, str]]) -> str:
    parts, at = [], 0
    for _, a, b, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def reveal(text: str, key: bytes = DEMO_KEY) -> str:
    """The text that was pseudonymised under the key."""
    return rewritten(text, found_in(text, key, back=True))


def pseudonymised(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and ``pii`` added: kind:start:end of each value in the original text, comma-joined; code points, end exclusive. A column of that name is replaced."""

    @F.pandas_udf("struct<text: string, pii: string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if t:
                found = found_in(t, key)
                out.append((rewritten(t, found) if found else t, ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)))
            else:
                out.append((t, ""))
        return pd.DataFrame(out, columns=["text", "pii"])

    (found,) = fresh(docs.columns, "_pii")
    own = [F.col(f"{found}.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "pii"]
    return docs.withColumn(found, of(F.col(text))).select(*own, f"{found}.pii")
