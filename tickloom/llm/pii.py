"""Operator 6, PII: format-preserving Feistel pseudonyms.

What is found (payment cards by Luhn, IBANs by mod 97, IPv4 addresses by octet range, phone
numbers by form, US social security numbers, calendar dates, e-mail addresses, secrets that
follow a key word) is read as a number in its format's range, permuted by a keyed Feistel
network over exactly that range, and written in the same format: separators, length, check
digits and validity stay. The permutation depends on key and format alone, so equal values get
equal pseudonyms in all documents, different values different ones.

Numbers that fail their check stay as they are, and so does all other text.

Edge cases: null texts stay null, empty ones empty; a value of a one-element range keeps its
value; repeated rows get equal rows; an empty table gives an empty result; all columns of the
input pass through unchanged but ``text`` (and ``n_chars``, where it exists, in the stage).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import map_batches

#: The default key; pass your own.
KEY = b"tickloom pseudonyms"
ROUNDS = 8
KINDS = ("email", "secret", "iban", "card", "ip", "ssn", "phone", "date")
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099

_FORMS = {
    "email": r"""(?<![\w.+%-])\w[\w.%+-]*@(?:[\w-]+\.)+(?:xn--[\w-]+|[^\W\d_]{2,})""",
    "secret": r"""(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)["']?[ \t]*[=:][ \t]*["']?[A-Za-z0-9][A-Za-z0-9_+/=-]{7,}""",
    "iban": r"""(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])""",
    "ip": r"""(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)""",
    "ssn": r"""(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])""",
    "date": r"""(?<![\d./-])(?:\d{4}(?P<y>[-/.])\d{1,2}(?P=y)\d{1,2}|\d{1,2}(?P<d>[-/.])\d{1,2}(?P=d)\d{4})(?![\d/-]|\.\d)""",
    "card": r"""(?<!\d)(?:\d{13,19}|\d{4}(?P<c>[ -])\d{4}(?P=c)\d{4}(?P=c)\d{1,7}|\d{4}(?P<a>[ -])\d{6}(?P=a)\d{4,5})(?!\d)""",
    "phone": r"""(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)""",
}
_ORDER = tuple(_FORMS)
_ALONE = {k: re.compile(f) for k, f in _FORMS.items()}
_PATTERN, _NO_SECRET = (re.compile("|".join(f"(?P<{k}>{f})" for k, f in _FORMS.items() if k != skip)) for skip in ("", "secret"))
#: Kinds of plain digits with a check; how an address goes on that begins before some place.
_NUMBERS, _ADDRESS_REST = ("ip", "ssn", "date", "card"), re.compile(r"[\w.%+-]*@[\w.-]*")
_FOREIGN_DIGIT = re.compile(r"(?![0-9])\d")
#: IBAN lengths by country, as registered.
_IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
_KEYWORD = re.compile(r"(?i)passw|pwd|secret|token|[_-]?key")
_DIGIT = re.compile(r"[0-9@]")


def permute(x: int, n: int, tweak: bytes, key: bytes) -> int:
    """A keyed bijection of range(n): an unbalanced Feistel network on a * b >= n, walked until it falls inside."""
    if n < 2:
        return x
    a = int(n**0.5) if n < 1 << 50 else 1 << ((n.bit_length() + 1) // 2)
    while a * a < n:
        a += 1
    b = -(-n // a)
    size = (max(a, b).bit_length() + 7) // 8 + 8
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + _round(left, r, tweak, key, size)) % b
            else:
                left = (left + _round(right, r, tweak, key, size)) % a
        x = left * b + right
        if x < n:
            return x


def _round(half: int, r: int, tweak: bytes, key: bytes, size: int) -> int:
    data = half.to_bytes((half.bit_length() + 8) // 8, "big")
    out = b""
    while len(out) < size:
        out += hashlib.blake2b(bytes([r, len(out) % 256]) + tweak + b"\0" + data, key=key[:64], digest_size=min(64, size)).digest()
    return int.from_bytes(out[:size], "big")


def luhn_ok(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def luhn_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn_ok(body + d))


def _digits_in(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(10_000)
def _alphabet(ch: str) -> tuple[str, str]:
    """Name and members of the class of a letter beyond ASCII: the letters of its case among the 128 code points around it, lone ones with all cases."""
    block = [chr(c) for c in range(ord(ch) & ~127, (ord(ch) | 127) + 1)]
    same = [c for c in block if c.isalpha() and unicodedata.category(c) == unicodedata.category(ch)]
    return f"{ord(ch) >> 7}{unicodedata.category(ch)}", "".join(same)


def by_class(value: str, tweak: bytes, key: bytes, classes: tuple[str, ...] = _CLASSES) -> str:
    """Every letter and digit stays in its class (beyond ASCII: letters of its script and case); the value as a whole is one number in mixed radix."""
    place, shape = [], []
    for ch in value:
        name, c = next(((str(i), c) for i, c in enumerate(classes) if ch in c), ("", None))
        if c is None and not ch.isascii() and ch.isalpha():
            name, c = _alphabet(ch)
        place.append(c)
        shape.append(name)
    x, n = 0, 1
    for ch, c in zip(value, place, strict=True):
        if c:
            x, n = x * len(c) + c.index(ch), n * len(c)
    y = permute(x, n, tweak + ",".join(shape).encode(), key)
    out = []
    for ch, c in zip(reversed(value), reversed(place), strict=True):
        if c:
            y, k = divmod(y, len(c))
            out.append(c[k])
        else:
            out.append(ch)
    return "".join(reversed(out))


def card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not luhn_ok(digits) or len(set(digits)) == 1:
        return None
    body = digits[:1] + str(permute(int(digits[1:-1]), 10 ** (len(digits) - 2), b"card" + digits[:1].encode(), key)).zfill(len(digits) - 2)
    return _digits_in(value, body + luhn_digit(body))


def _mod97(country: str, bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = by_class(plain[4:], b"iban" + plain[:2].encode(), key)
    new = plain[:2] + f"{98 - _mod97(plain[:2], body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in value)


def iban_ends(value: str) -> list[int]:
    """Where an IBAN may end in a candidate: at its country's length, or (any other country) before any blank; else at the candidate's end."""
    blanks = [i for i, c in enumerate(value) if c == " "]
    length = _IBAN_LENGTH.get(value[:2])
    if length is None:
        return [len(value), *reversed(blanks)]
    return [e for e in [*blanks, len(value)] if len(value[:e].replace(" ", "")) == length] or [len(value)]


def ip(value: str, key: bytes) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permute(x, 1 << 32, b"ip", key).to_bytes(4, "big")))


def ssn(value: str, key: bytes) -> str | None:
    def index(area: int, group: int, serial: int) -> int:
        return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1

    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    y, s = divmod(permute(index(area, group, serial), 898 * 99 * 9999, b"ssn", key), 9999)
    a, g = divmod(y, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def phone(value: str, key: bytes) -> str | None:
    """All digits but the country's move; the area code keeps a first digit from 2 to 9 where it has one."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    head = m[0] if m else ""
    form = value[len(head) :]
    digits = re.sub(r"\D", "", form)
    if not 7 <= len(digits) <= 15:
        return None
    first = digits[0]
    low, n = ("23456789", 8) if first in "23456789" else ("01", 2)
    rest = len(digits) - 1
    x = low.index(first) * 10**rest + int(digits[1:])
    y = permute(x, n * 10**rest, b"phone" + head.encode() + bytes([n, len(digits)]), key)
    a, b = divmod(y, 10**rest)
    return head + _digits_in(form, low[a] + str(b).zfill(rest))


def date(value: str, key: bytes) -> str | None:
    """A day of 1900 to 2099 in the value's own order of parts.

    With slashes month first where that is a day, else day first; a day-first value stays one that is no day month first, so the two
    never meet. Unpadded parts stay of one digit: the permutation of days is walked until the form fits.
    """
    mark = re.search(r"\D", value)[0]
    a, b, c = value.split(mark)
    orders = [("ymd", (a, b, c))] if len(a) == 4 else [("mdy", (c, a, b)), ("dmy", (c, b, a))] if mark == "/" else [("dmy", (c, b, a))]
    for order, (y, m, d) in orders:
        try:
            at = dt.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= at < _DAYS:
            return None
        only = mark == "/" and order == "dmy"
        new = None
        while new is None or (len(m) == 1 and new.month > 9) or (len(d) == 1 and new.day > 9) or (only and new.day < 13):
            at = permute(at, _DAYS, b"date", key)
            new = dt.date.fromordinal(at + _FIRST_DAY)
        part = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(m)}d}", "d": f"{new.day:0{len(d)}d}"}
        return mark.join(part[o] for o in order)
    return None


def email(value: str, key: bytes) -> str | None:
    local, domain = value.split("@")
    return by_class(local, b"email" + domain.lower().encode(), key) + "@" + domain


_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/=-]*\Z")


def secret(value: str, key: bytes) -> str | None:
    """The value after the key word, if it looks made (a digit among its characters, or hexadecimal)."""
    word = _VALUE.search(re.sub(r"^.*?[=:]", lambda m: " " * len(m[0]), value))
    if word is None or not any(c.isdigit() for c in word[0]):
        return None
    v = word[0]
    classes = ("0123456789abcdef",) if re.fullmatch(r"[0-9a-f]+", v) else ("0123456789ABCDEF",) if re.fullmatch(r"[0-9A-F]+", v) else _CLASSES
    return value[: word.start()] + by_class(v, b"secret", key, classes)


RULES: dict[str, Callable[[str, bytes], str | None]] = {"email": email, "secret": secret, "iban": iban, "card": card, "ip": ip, "ssn": ssn, "phone": phone, "date": date}


def _in_script(new: str, old: str) -> str:
    """``new`` with its digits in the scripts of ``old``'s: place by place, or (other length) as its first digit."""
    zeros = [ord(c) - unicodedata.decimal(c) if c.isdecimal() else 48 for c in old]
    if len(new) != len(old):
        zeros = [next(z for c, z in zip(old, zeros, strict=True) if c.isdecimal())] * len(new)
    return "".join(chr(z + int(c)) if "0" <= c <= "9" else c for c, z in zip(new, zeros, strict=True))


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind.

    Digits of all scripts count as digits. Where a candidate fails its check, the other kinds are
    tried at its place and the search goes on at the next character, so that a failed candidate
    hides no value; but a piece of a number that failed its check is no phone number.
    """
    found: dict[str, int] = {}
    folded = text if text.isascii() else _FOREIGN_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
    if not _DIGIT.search(folded) and not _KEYWORD.search(folded):
        return text, found
    out: list[str] = []
    done = pos = failed_number = failed_secret = 0

    def value_at(m: re.Match) -> tuple[str, int, str] | None:
        nonlocal failed_number, failed_secret
        for kind in _ORDER[_ORDER.index(m.lastgroup) :]:
            if kind == "secret" and m.start() < failed_secret:
                continue
            c = m if kind == m.lastgroup else _ALONE[kind].match(folded, m.start())
            if c is None or (kind == "phone" and c.end() <= failed_number):
                continue
            for end in iban_ends(c[0]) if kind == "iban" else (len(c[0]),):
                new = RULES[kind](c[0][:end], key)
                if new is not None:
                    return kind, c.start() + end, new
            if kind in _NUMBERS:
                failed_number = max(failed_number, c.end())
            if kind == "iban" and c[0][:2] in _IBAN_LENGTH:
                failed_number = max(failed_number, c.start() + end)
            if kind == "secret":
                failed_secret = c.end()
        return None

    while True:
        if pos < failed_secret:  # a key's value without digits hides no other key's and no number, only an address
            rest = _ADDRESS_REST.match(folded, failed_secret)
            m = _NO_SECRET.search(folded, pos, rest.end()) if rest else None
            if m is None or m.start() >= failed_secret:
                pos = failed_secret
                continue
        else:
            m = _PATTERN.search(folded, pos)
            if m is None:
                break
        got = value_at(m)
        if got is None:
            pos = m.start() + 1
            continue
        kind, end, new = got
        old = text[m.start() : end]
        out += [text[done : m.start()], new if old.isascii() else _in_script(new, old)]
        found[kind] = found.get(kind, 0) + 1
        done = pos = end
    return "".join([*out, text[done:]]), found


def pseudonymise_documents(docs: DataFrame, key: bytes = KEY, counts: bool = True) -> DataFrame:
    """All columns with ``text`` pseudonymised; with ``counts`` also n_<kind> for each kind (in place of a column of that name)."""
    extra = [f"n_{k}" for k in KINDS] if counts else []
    fields = [f for f in docs.schema.fields if f.name not in extra]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in extra])
    at = next(i for i, f in enumerate(fields) if f.name == "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, sums = [], []
            for t in batch.column(at).to_pylist():
                new, found = (t, {}) if t is None else pseudonymise(t, key)
                texts.append(new)
                sums.append(found)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            cols += [pa.array([s.get(k, 0) for s in sums], pa.int64()) for k in KINDS if counts]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        return step

    return map_batches(docs.select(*[F.col(f"`{f.name}`") for f in fields]), make, schema)


def op6_pii_pseudonyms(docs: DataFrame) -> DataFrame:
    """The thin query: doc_id, the pseudonymised text and the counts of every document."""
    out = pseudonymise_documents(docs.select("doc_id", "text"))
    return out.withColumn("n_found", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, pseudonymised."""
    out = pseudonymise_documents(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
