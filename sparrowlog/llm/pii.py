"""Format-preserving pseudonyms for personal data: keyed Feistel permutations.

A value that is found and validated is permuted within its own format: digits
stay digits, letters letters, check digits valid, dates real dates.  The same
key sends equal values to equal pseudonyms in every document, different
values of a kind to different ones, and ``restore`` takes them back.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
from collections.abc import Callable
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

ROUNDS, BLOCK = 10, 64
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


class Feistel:
    """Keyed permutations of strings over an alphabet and of numbers below a bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, shape: tuple, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{shape}|{half}".encode(), key=self.key, digest_size=32).digest(), "big")

    def digits(self, value: list[int], radix: int, tweak: str, back: bool = False) -> list[int]:
        """A permutation of the number lists of this length and radix; of each BLOCK of a long one, for a round's hash has 256 bits."""
        n = len(value)
        if n > BLOCK:
            return [x for at in range(0, n, BLOCK) for x in self.digits(value[at : at + BLOCK], radix, f"{tweak}@{at}", back)]
        if n < 2:  # one digit alone is turned by an amount the tweak fixes
            turn = self._round(tweak, 0, (n, radix), 0)
            return [(x + (-turn if back else turn)) % radix for x in value]
        sizes = (n // 2, n - n // 2)

        def number(part: list[int]) -> int:
            out = 0
            for x in part:
                out = out * radix + x
            return out

        a, b = number(value[: sizes[0]]), number(value[sizes[0] :])
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            bound = radix ** sizes[i % 2]
            if back:
                a, b = (b - self._round(tweak, i, (n, radix), a)) % bound, a
            else:
                a, b = b, (a + self._round(tweak, i, (n, radix), b)) % bound
        out = []
        for x, size in ((b, sizes[1]), (a, sizes[0])):
            for _ in range(size):
                x, d = divmod(x, radix)
                out.append(d)
        return out[::-1]

    def below(self, value: int, bound: int, tweak: str, back: bool = False) -> int:
        """A permutation of the numbers below a bound: bits are permuted until the bound holds."""
        bits = max(2, (bound - 1).bit_length())
        while True:
            turned = self.digits([value >> i & 1 for i in reversed(range(bits))], 2, f"{tweak}<{bound}", back)
            value = int("".join(map(str, turned)), 2)
            if value < bound:
                return value

    def text(self, value: str, tweak: str, back: bool = False) -> str:
        """Digits, and small and capital ASCII letters, each permuted among themselves; other characters stay."""
        out = list(value)
        for name, alphabet in (("d", DIGITS), ("l", LOWER), ("u", LOWER.upper())):
            at = [i for i, c in enumerate(value) if c in alphabet]
            for i, x in zip(at, self.digits([alphabet.index(value[i]) for i in at], len(alphabet), f"{tweak}.{name}", back)):
                out[i] = alphabet[x]
        return "".join(out)


def luhn(digits: str) -> int:
    """The check sum; 0 for valid numbers."""
    return sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits))) % 10


def _refill(shape: str, new: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    fresh = iter(new)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


def _card(f: Feistel, value: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn(digits):
        return None
    body = "".join(map(str, f.digits([int(d) for d in digits[:-1]], 10, "card", back)))
    return _refill(value, body + str(-luhn(body + "0") % 10))


def _iban(f: Feistel, value: str, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = f.text(plain[4:], f"iban{plain[:2]}", back)
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{plain[:2]}00")) % 97
    return _refill(value, f"{plain[:2]}{check:02d}{body}")


def _address(f: Feistel, value: str, back: bool) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    n = f.below(sum(p << 8 * i for i, p in enumerate(reversed(parts))), 1 << 32, "ip", back)
    return ".".join(str(n >> 8 * i & 255) for i in reversed(range(4)))


def _ssn(f: Feistel, value: str, back: bool) -> str | None:
    a, b, c = (int(x) for x in value.split("-"))
    if not (0 < a < 900 and a != 666 and b and c):
        return None
    areas = [x for x in range(1, 900) if x != 666]
    n = f.below((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, "ssn", back)
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def _walked(value: str, turn: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """``turn`` until the value is valid again: a permutation of the valid ones."""
    while not valid(value := turn(value)):
        pass
    return value


def _phone(f: Feistel, value: str, back: bool) -> str | None:
    lead = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    start = lead.end() if lead else 0
    n = sum(map(str.isdigit, value[start:]))
    return value[:start] + f.text(value[start:], "phone", back) if 7 <= n <= 12 else None


def _compact_phone(f: Feistel, value: str, back: bool) -> str | None:
    """+ and 8 to 15 digits; a country code of one digit (1 or 7), else the first two, stays."""
    start = 2 if value[1] in "17" else 3
    return value[:start] + f.text(value[start:], f"phone{value[:start]}", back)


def _area_phone(f: Feistel, value: str, back: bool) -> str | None:
    """Area, exchange and number: the first two begin with 2 to 9."""
    def valid(x: str) -> bool:
        return x[0] in "23456789" and x[4] in "23456789"

    return _walked(value, lambda x: f.text(x, "area", back), valid) if valid(value) and value[3] == value[7] else None


def _email(f: Feistel, value: str, back: bool) -> str | None:
    """The local part; letters differ by case only if the address does, so one person's spellings stay linked."""
    local, _, domain = value.rpartition("@")
    if not any(c.isalnum() for c in local):
        return None
    turned = f.text(local.lower(), f"email{len(local)}", back)
    return "".join(t.upper() if c.isupper() else t for c, t in zip(local, turned)) + f"@{domain}"


def _hex(f: Feistel, value: str, tweak: str, back: bool) -> str:
    """Hexadecimal digits of one case among themselves; of both, letters and digits each among themselves."""
    low, high = value == value.lower(), value == value.upper()
    if not low and not high:
        out = list(value)
        for name, alphabet in (("d", DIGITS), ("l", HEX[10:]), ("u", HEX[10:].upper())):
            at = [i for i, c in enumerate(value) if c in alphabet]
            for i, x in zip(at, f.digits([alphabet.index(value[i]) for i in at], len(alphabet), f"{tweak}.{name}", back)):
                out[i] = alphabet[x]
        return "".join(out)

    def turn(x: str) -> str:
        return "".join(HEX[d] for d in f.digits([HEX.index(c) for c in x], 16, tweak, back))

    if low:
        return turn(value)
    return _walked(value.lower(), turn, lambda x: not x.isdigit()).upper()  # digits alone would read as small letters


_IS_HEX = re.compile("[0-9A-Fa-f]+").fullmatch


def _secret(f: Feistel, value: str, back: bool) -> str | None:
    return _hex(f, value, "secret", back) if _IS_HEX(value) else _walked(value, lambda x: f.text(x, "secret", back), lambda x: not _IS_HEX(x))


def _key(f: Feistel, value: str, back: bool) -> str | None:
    """A key with a public prefix, which stays."""
    start = re.match(r"AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|AIza|[sr]k_(?:live|test)_", value).end()
    return value[:start] + f.text(value[start:], "key", back)


def _web_token(f: Feistel, value: str, back: bool) -> str | None:
    return "eyJ" + f.text(value[3:], "token", back)


def _address6(f: Feistel, value: str, back: bool) -> str | None:
    """The digits of the groups as they are spelled; a zero group left out stays left out."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    groups = [g for g in value.split(":") if g]
    if len(groups) < 8 and (len(groups) < 3 and not re.match("(?i)fe80:|f[cd]|2", value) or not any(map(str.isdigit, value))):
        return None  # "::" between two names is no address
    return _refill(value, _hex(f, value.replace(":", ""), f"ip6{len(groups)}", back))


def _days(d: date) -> tuple[date, date]:
    """The span a date is permuted in: 1900 to 2099, or its own hundred years."""
    if FIRST_DAY <= d <= LAST_DAY:
        return FIRST_DAY, LAST_DAY
    first = max(1, d.year // 100 * 100)
    return date(first, 1, 1), date(d.year // 100 * 100 + 99, 12, 31)


def _day(f: Feistel, year: str, month: str, day: str, back: bool, late: bool = False) -> date | None:
    """The date's pseudonym; ``late``: among the dates with a day over 12."""
    try:
        d = date(int(year), int(month), int(day))
    except ValueError:
        return None
    first, last = _days(d)
    count = (last - first).days + 1
    while True:
        d = first + timedelta(f.below((d - first).days, count, "late" if late else "date", back))
        if not late or d.day > 12:
            return d


def _iso_date(f: Feistel, value: str, back: bool) -> str | None:
    s = value[4]
    d = _day(f, value[:4], value[5:7], value[8:], back) if value[7] == s and (s != "." or value[:2] in ("19", "20")) else None
    return d and f"{d.year:04d}{s}{d.month:02d}{s}{d.day:02d}"


def _day_first(f: Feistel, value: str, back: bool) -> str | None:
    """Day, month and year; if that is no date, month, day and year."""
    s = value[2]
    if value[5] != s or s == "." and value[6:8] not in ("19", "20"):
        return None
    if d := _day(f, value[6:], value[3:5], value[:2], back):
        return f"{d.day:02d}{s}{d.month:02d}{s}{d.year:04d}"
    d = _day(f, value[6:], value[:2], value[3:5], back, late=True) if int(value[3:5]) > 12 else None
    return d and f"{d.month:02d}{s}{d.day:02d}{s}{d.year:04d}"


#: Words after which a quoted value, or a long unquoted one, is a secret.
_NAMED = r"(?:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|password|passwd)"
#: Kinds in order of precedence: name, pattern, permutation (None: not valid, left alone).  The value is group v or else all.
#: Each pattern begins where its run of characters does or reaches a bounded way, so a search is linear in the text.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+", _email),
    ("secret", rf"(?i:(?<![a-z]){_NAMED}[\"']? ?[=:] ?)(?:\"(?P<v>[^\s\"']{{8,}}+)\"|'(?P<v>[^\s\"']{{8,}}+)'|(?P<v>[0-9A-Fa-f]{{16,}}+)(?![A-Za-z0-9]))", _secret),
    ("key", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])", _key),
    ("token", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", _web_token),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\d/.-])\d{4}[-/.]\d\d[-/.]\d\d(?![\d/-]|\.\d)", _iso_date),
    ("date", r"(?<![\d/.-])\d\d[-/.]\d\d[-/.]\d{4}(?![\d/-]|\.\d)", _day_first),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _address),
    ("ip", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,39}+(?![0-9A-Za-z:])", _address6),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("phone", r"(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]|\.\d)", _area_phone),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)", _card),
    ("card", r"(?<![\d.-])\d{13,19}(?![\d-]|\.\d)", _card),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)", _phone),
    ("phone", r"(?<![\d+A-Za-z/=])\+[1-9]\d{7,14}(?![\dA-Za-z/=+])", _compact_phone),
)


def _numbered(pattern: str, i: int) -> str:
    """``pattern`` with group v as groups of its own names: v<i>x0, v<i>x1, ..."""
    count = itertools.count()
    return re.sub(r"\?P<v>", lambda _: f"?P<v{i}x{next(count)}>", pattern)


_PATTERNS = [re.compile(_numbered(p, i)) for i, (_, p, _) in enumerate(KINDS)]
_ANY = re.compile("|".join(f"(?P<k{i}>{_numbered(p, i)})" for i, (_, p, _) in enumerate(KINDS)))
_VALUES = [[g for g in p.groupindex if g.startswith("v")] for p in _PATTERNS]
_MAY = re.compile(r"[0-9@]|[tT][oO][kK][eE][nN]|[sS][eE][cC][rR]|[pP][aA][sS][sS]|[kK][eE][yY]")


def _kind_of(m: re.Match) -> int:
    return next(i for i in range(len(KINDS)) if m.start(f"k{i}") >= 0)


def pseudonymise(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with its personal values permuted, and (kind, start, end) of each in the text given."""
    if not text or not _MAY.search(text):
        return text, []
    out, spans, at, seek = [], [], 0, 0
    while m := _ANY.search(text, seek):
        new, first = None, _kind_of(m)
        for i in range(first, len(KINDS)):  # a match that isn't valid for one kind may be for a later one
            kind, _, permute = KINDS[i]
            own = m if i == first else _PATTERNS[i].match(text, m.start())
            if not own:
                continue
            a, z = next((own.span(g) for g in _VALUES[i] if own.start(g) >= 0), own.span(f"k{i}") if own is m else own.span())
            if (new := permute(feistel, text[a:z], back)) is not None:
                out += [text[at:a], new]
                spans.append((kind, a, z))
                at = seek = z
                break
        if new is None:
            seek = m.start() + 1
    return "".join([*out, text[at:]]), spans


def restore(text: str | None, feistel: Feistel) -> str | None:
    """Takes ``pseudonymise`` back."""
    return pseudonymise(text, feistel, back=True)[0]


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_replaced, spans.

    spans: array of (kind, start, end), code points of the text given.  Null
    texts stay null with no spans; an empty table gives an empty table;
    repeated rows come out repeated, alike; other columns are not read.  E-mail
    addresses that differ by case only get pseudonyms that do; other values are
    equal if they are spelled alike.
    """
    feistel = Feistel(key)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [pseudonymise(t, feistel) for t in batch.column(1).to_pylist()]
        spans = [[{"kind": k, "start": a, "end": z} for k, a, z in s] for _, s in done]
        return pa.record_batch([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(map(len, spans), pa.int64()), pa.array(spans, span)], names=["doc_id", "text", "n_replaced", "spans"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), f, "doc_id long, text string, n_replaced long, spans array<struct<kind:string,start:int,end:int>>")
