"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Card numbers (Luhn), IBANs (mod 97), phone and social security numbers, IPv4 addresses, calendar dates and e-mail
addresses are found and validated; each valid value is brought into a canonical form (a number's digits, a phone's country
code and subscriber digits, a day, an address in lower case), which a Feistel network whose round function is keyed
BLAKE2b permutes, and is written as the value found was. So one value stays one value in whatever spelling, distinct ones
stay distinct in all documents; a card and an IBAN get fitting check digits, a date stays a date. Walking on (permuting
again) until the format's own rule holds keeps it a bijection of the valid values. The rest of the text stays as it is.

Slashed dates are read day first unless the second number is above 12; so that they are read alike again, days up to 12
stay among themselves in every spelling. A phone without a country code links with a North American one (+1) only.

A match that does not hold as a whole is tried at its earlier ends, and scanning goes on behind what was accepted or,
where nothing was, inside the match. The choice of the end looks at the value alone, so that equal values stay equal;
going back can therefore take another end where a card's new digits fit together with the digits that follow it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email")
ROUNDS = 10
#: Fixed patterns, tried in this order where several could start at one place.
NUMBERS = re.compile(
    r"(?<![\w.@])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![\w])"
    r"|(?P<iso>\d{4}-\d{2}-\d{2})(?![\w]|-\d)"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?P<day>\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w]|[./]\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w]|-\d)"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+\d{8,15}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|-\d)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|-\d)"
    r")"
)
EMAIL = re.compile(r"(?<![\w.+%-])(?P<local>[A-Za-z0-9._%+-]++)@(?P<host>[A-Za-z0-9-]+)(?P<rest>(?:\.[A-Za-z0-9-]+)+)")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[A-Z0-9](?=[ -])", re.IGNORECASE)
#: An IBAN's length by country.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
#: Country calling codes: these of two digits, 1 and 7, all others of three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of mixed-radix numbers: two halves, to which rounds add a hash of the other in turn."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _hash(self, tag: str, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tag}|{i}|{x}".encode(), key=self.key, digest_size=32).digest(), "big")

    def pair(self, tag: str, a: int, b: int, size_a: int, size_b: int, back: bool = False) -> tuple[int, int]:
        for i in range(self.rounds)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._hash(tag, i, a)) % size_b
            else:
                a = (a + sign * self._hash(tag, i, b)) % size_a
        return a, b

    def symbols(self, tag: str, values: list[int], radices: list[int], back: bool = False) -> list[int]:
        half = len(values) // 2

        def number(v: list[int], r: list[int]) -> tuple[int, int]:
            n, size = 0, 1
            for x, m in zip(v, r):
                n, size = n * m + x, size * m
            return n, size

        def split(n: int, r: list[int]) -> list[int]:
            out = []
            for m in r[::-1]:
                n, x = divmod(n, m)
                out.append(x)
            return out[::-1]

        tag = f"{tag}|{','.join(map(str, radices))}"
        (a, size_a), (b, size_b) = number(values[:half], radices[:half]), number(values[half:], radices[half:])
        a, b = self.pair(tag, a, b, size_a, size_b, back)
        return split(a, radices[:half]) + split(b, radices[half:])

    def digits(self, tag: str, s: str, valid: Callable[[str], bool] = lambda _: True, back: bool = False) -> str:
        while True:
            s = "".join(map(str, self.symbols(tag, [int(c) for c in s], [10] * len(s), back)))
            if valid(s):
                return s

    def below(self, tag: str, x: int, size: int, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        root = int(size**0.5) + 1
        while True:
            a, b = self.pair(tag, *divmod(x, root), root, root, back)
            x = a * root + b
            if x < size and valid(x):
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_number(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check))


def _refit(pattern: str, symbols: str) -> str:
    """pattern with its digits and letters replaced by symbols, in turn."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def _classes(s: str) -> tuple[list[int], list[int], str]:
    values, radices, first = [], [], []
    for c in s:
        base, radix = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
        values.append(ord(c) - ord(base))
        radices.append(radix)
        first.append(base)
    return values, radices, "".join(first)


def _alnum(f: Feistel, tag: str, s: str, back: bool = False) -> str:
    values, radices, first = _classes(s)
    return "".join(chr(ord(b) + v) for b, v in zip(first, f.symbols(f"{tag}|{first}", values, radices, back)))


def _nanp(d: str) -> bool:
    return d[0] > "1" and d[3] > "1"


def _routable(x: int) -> bool:
    return 0 < x >> 24 < 224


def _real_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def card(f: Feistel, s: str, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    new = f.digits("card", d[:-1], lambda x: len({*x, luhn_digit(x)}) > 1, back)
    return _refit(s, new + luhn_digit(new))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - _iban_number(country, '00', body) % 97:02d}"


def iban(f: Feistel, s: str, back: bool = False) -> str | None:
    """Only canonical check digits (02 to 98) are valid: 00, 01 and 99 would be second names of other numbers."""
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_check(d[:2], d[4:]) != d[2:4]:
        return None
    body = _alnum(f, f"iban{d[:2]}", d[4:], back)
    return _refit(s, f"{d[:2]}{_iban_check(d[:2], body)}{body}")


def phone(f: Feistel, s: str, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 7 <= len(d) <= 15:
        return None
    code = "" if s[0] != "+" else d[0] if d[0] in "17" else d[:2] if d[:2] in TWO_DIGIT_CODES else d[:3]
    own = d[len(code) :]
    if len(own) == 10 and code in ("", "1"):  # one numbering plan, with and without its code
        american = _nanp(own)
        return _refit(s, code + f.digits("phone", own, lambda x: _nanp(x) == american, back))
    return _refit(s, code + f.digits(f"phone{code}", own, back=back)) if own else None


def ssn(f: Feistel, s: str, back: bool = False) -> str | None:
    d = s.replace("-", "")
    return _refit(s, f.digits("ssn", d, _real_ssn, back)) if _real_ssn(d) else None


def ip(f: Feistel, s: str, back: bool = False) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
        return None
    x = int.from_bytes(bytes(map(int, octets)), "big")
    if not _routable(x):
        return None
    return ".".join(map(str, f.below("ip", x, 1 << 32, _routable, back).to_bytes(4, "big")))


def date(f: Feistel, s: str, back: bool = False) -> str | None:
    sep = re.sub(r"\d", "", s)[:1]
    parts = s.split(sep)
    if len(parts) != 3:
        return None
    order = "ymd" if sep == "-" else "mdy" if sep == "/" and int(parts[1]) > 12 else "dmy"
    y, m, d = (int(parts[order.index(c)]) for c in "ymd")
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    late = d > 12
    new = datetime.date.fromordinal(_FIRST + f.below("date", day - _FIRST, _LAST - _FIRST + 1, lambda x: (datetime.date.fromordinal(_FIRST + x).day > 12) == late, back))
    value = {"y": new.year, "m": new.month, "d": new.day}
    return sep.join(f"{value[c]:0{min(len(p), 4)}d}" for c, p in zip(order, parts))


def email(f: Feistel, local: str, host: str, rest: str, back: bool = False) -> str | None:
    both = local + "@" + host
    symbols = "".join(c for c in both if c.isalnum())
    new = _alnum(f, f"email|{re.sub('[A-Za-z0-9]', 'x', both)}|{rest.lower()}", symbols.lower(), back)
    return _refit(both, "".join(n.upper() if c.isupper() else n for c, n in zip(symbols, new))) + rest if symbols else None


_NUMBER_KINDS = {"card": card, "iban": iban, "phone": phone, "ssn": ssn, "ip": ip, "iso": date, "day": date}


def _ends(m: re.Match) -> list[int]:
    """Where a value that m starts with may end, best first: an IBAN's country's length, the whole match, then the
    places before its separators from the last on (an expiry, amount or upper-case word may follow a value)."""
    s = m[0]
    if m.lastgroup not in ("card", "iban", "phone"):
        return [len(s)]
    ends = [len(s), *(x.end() for x in reversed([*_END.finditer(s)]))]
    if m.lastgroup == "iban":
        length = IBAN_LENGTHS.get(s[:2])
        ends.sort(key=lambda e: sum(c != " " for c in s[:e]) != length)
    return ends


def _number(f: Feistel, name: str, s: str, part: bool, back: bool) -> tuple[str, str | None]:
    """(kind, pseudonym or None). part: s is cut out of a longer match, so a card must be grouped as cards are (rows of
    short numbers have too many parts with a fitting check digit)."""
    digits = sum(c.isdigit() for c in s)
    fits = 13 <= digits <= 19 and not (part and any(len(g) < 3 for g in re.split("[ -]", s)[:-1]))
    if name == "card":
        return name, card(f, s, back) if fits else None
    new = None if part and not NUMBERS.fullmatch(s) else _NUMBER_KINDS[name](f, s, back)
    if new is None and name in ("phone", "iban") and digits >= 13 and not s[0].isalpha() and (fits or not part):
        return "card", card(f, s, back)
    return name, new


def pseudonymise(f: Feistel, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)

    def address(m: re.Match) -> str:
        new = email(f, m["local"], m["host"], m["rest"], back)
        counts["email"] += new is not None
        return new or m[0]

    if _DIGIT.search(text):
        parts, done, at, tried = [], 0, 0, 0
        while m := NUMBERS.search(text, at):
            for end in _ends(m):
                s = m[0][:end]
                name, new = _number(f, m.lastgroup, s, end < len(m[0]) or m.start() < tried, back)
                if new is not None:
                    counts["date" if name in ("iso", "day") else name] += 1
                    parts += [text[done : m.start()], new]
                    done = at = m.start() + end
                    break
            else:  # what did not hold may have a value further on
                at, tried = m.start() + 1, max(tried, m.end())
        text = "".join(parts) + text[done:]
    return (EMAIL.sub(address, text) if "@" in text else text), counts


def pseudonyms(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, text with its personal values replaced, n_values and one count a kind.

    Null text stays null with counts of 0, empty text stays empty. Repeated rows give repeated results, an empty table
    an empty one; other columns are not read. The key is a secret of the caller; the same key gives the same pseudonyms.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key.encode())
        for b in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for t in b.column(1).to_pylist():
                t, c = pseudonymise(f, t) if t else (t, dict.fromkeys(KINDS, 0))
                texts.append(t)
                for k in KINDS:
                    counts[k].append(c[k])
            arrays = [b.column(0), pa.array(texts, pa.string()), pa.array(map(sum, zip(*counts.values())), pa.int64()), *[pa.array(counts[k], pa.int64()) for k in KINDS]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text", "n_values", *[f"n_{k}" for k in KINDS]])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind}, text string, n_values bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
