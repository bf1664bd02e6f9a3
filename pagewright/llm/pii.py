"""Format-preserving pseudonyms for personal data.

Validated values (payment cards by Luhn, IBANs by their check digits, social security numbers, North American and
international phone numbers, IPv4 addresses, calendar dates, mail addresses, cloud access keys) are replaced by another
value of the same format: the value is numbered within the set of valid values of its format, and a keyed Feistel
network with cycle walking permutes that set. So equal values get equal pseudonyms in every document, different ones
different ones, card and IBAN checks still hold, dates are dates, and separators stay where they were. A mail address
is the same in capitals. The key comes from the session's setting `spark.pagewright.pseudonym.key`; where that is unset,
a key is drawn for the run, so nobody can undo its pseudonyms, nor link them with those of another run.

Defined results: a mail name is looked at for 64 characters at most; null text stays null with nothing found; numbers that fail their check stay as they are; very long
texts are searched whole; repeated rows get equal results; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import each_batch, table

KEY_SETTING = "spark.pagewright.pseudonym.key"
ROUNDS = 8
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: In order of precedence where two would start at one place.
PATTERNS = {
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "intl_phone": r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9])",
}


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """Where a keyed permutation of range(size) takes x: a Feistel network, walked until it is in the range again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for k in range(ROUNDS):
            drawn = hashlib.blake2b(f"{tweak}:{size}:{k}:".encode() + right.to_bytes(width, "big"), key=key, digest_size=width + 8).digest()
            left, right = right, left ^ (int.from_bytes(drawn, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def spelled(value: str, key: bytes, tweak: str) -> str:
    """The value with letters and digits permuted as a whole, each within its own kind; other characters stay."""
    kinds = [next((s for s in (LOWER, UPPER, DIGITS) if c in s), "") for c in value]
    number, size = 0, 1
    for c, kind in zip(value, kinds, strict=True):
        if kind:
            number, size = number * len(kind) + kind.index(c), size * len(kind)
    number = permuted(number, size, key, tweak) if size > 1 else 0
    out = []
    for c, kind in zip(reversed(value), reversed(kinds), strict=True):
        out.append(kind[number % len(kind)] if kind else c)
        number //= len(kind) or 1
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The digit that completes these to a valid number."""
    doubled = [int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return str(-sum(doubled) % 10)


def iban_digits(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def refilled(shape: str, characters: str) -> str:
    """The shape with its letters and digits replaced in turn."""
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def plausible_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _walk(digits: str, key: bytes, tweak: str, valid) -> str:
    """Permuted among the digit strings of this length that are valid."""
    size = 10 ** len(digits)
    x = permuted(int(digits), size, key, tweak)
    while not valid(f"{x:0{len(digits)}d}"):
        x = permuted(x, size, key, tweak)
    return f"{x:0{len(digits)}d}"


# The country codes of one digit and of two; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98").split()


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return digits[:1] if digits[:1] in ONE_DIGIT else digits[:2] if digits[:2] in TWO_DIGITS else digits[:3]


def _other_number(value: str, digits: str, key: bytes) -> str | None:
    """A phone number of the same country, in the same spelling. A subscriber is numbered alike in all spellings; a
    number without a country code is a North American one."""
    code = country_code(digits) if value.startswith("+") else ""
    own = digits[len(code) :]
    if code in ("", "1") and len(own) == 10:
        american = lambda d: d[0] in "23456789" and d[3] in "23456789"
        new = _walk(own, key, "phone", american if american(own) else lambda d: not american(d))
    elif 6 <= len(own) <= 14:
        new = _walk(own, key, f"intl_phone {code}", lambda d: True)
    else:
        return None
    return refilled(value, code + new)


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """What replaces the value, or None if it is not a valid one of its kind."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "access_key":
        return value[:4] + spelled(value[4:], key, kind)
    if kind == "email":
        name, _, host = value.rpartition("@")
        new = spelled(name.lower(), key, "email " + host.lower())
        return "".join(n.upper() if c.isupper() else n for c, n in zip(name, new, strict=True)) + "@" + host
    if kind == "iban":
        whole = value.replace(" ", "")
        if not 15 <= len(whole) <= 34 or iban_digits(whole[:2], whole[4:]) != whole[2:4]:
            return None
        account = spelled(whole[4:], key, kind + whole[:2])
        return refilled(value, whole[:2] + iban_digits(whole[:2], account) + account)
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = _walk(digits[:-1], key, kind, lambda d: len(set(d + luhn_digit(d))) > 1)
        return refilled(value, body + luhn_digit(body))
    if kind == "ssn":
        return refilled(value, _walk(digits, key, kind, plausible_ssn)) if plausible_ssn(digits) else None
    if kind in ("phone", "intl_phone"):
        return _other_number(value, digits, key)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        return ".".join(map(str, permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, kind).to_bytes(4, "big")))
    return _moved_date(value, key)


def _moved_date(value: str, key: bytes) -> str | None:
    try:
        if "-" in value:
            day, show = date.fromisoformat(value), lambda d: d.isoformat()
        else:
            mark = "." if "." in value else "/"
            a, b, year = map(int, value.split(mark))
            swapped = mark == "/" and b > 12
            day = date(year, *((a, b) if swapped else (b, a)))
            show = lambda d: mark.join([*(f"{x:02d}" for x in ((d.month, d.day) if swapped else (d.day, d.month))), f"{d.year:04d}"])
    except ValueError:
        return None
    first, last = (FIRST_DAY, LAST_DAY) if FIRST_DAY <= day <= LAST_DAY else (date.min, date.max)
    return show(first + timedelta(permuted((day - first).days, (last - first).days + 1, key, f"date {first}")))


_finders = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_last_group = re.compile(r"[ .-][^ .-]*$")
_needs = {"access_key": re.compile("A[KS]IA").search, "email": lambda t: "@" in t}


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and kind, start, end (in the text given) and pseudonym of each."""
    digit = re.search("[0-9]", text)
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))  # 1 where a value was found
    for kind, finder in _finders.items():
        if not _needs.get(kind, lambda t: digit)(text):
            continue
        at = 0
        while m := finder.search(text, at):
            value = m[0]
            while (new := pseudonym(kind, value, key)) is None and kind in ("iban", "intl_phone") and _last_group.search(value):
                value = _last_group.sub("", value)  # what follows may be no part of it
            start, end = m.start(), m.start() + len(value)
            at = end if new else start + 1
            if new and taken.find(1, start, end) < 0:
                found.append((start, end, kind, new))
                taken[start:end] = b"\1" * (end - start)
    found.sort()
    out, last = [], 0
    for a, b, _, new in found:
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), [(kind, a, b, new) for a, b, kind, new in found]


def session_key(spark) -> bytes:
    """The key that the session is set to use, or one drawn for this run."""
    key = spark.conf.get(KEY_SETTING, None)
    return hashlib.sha256(key.encode()).digest() if key else secrets.token_bytes(32)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in the text, and found: kind, start, end and pseudonym of each value that was replaced."""
    kept = [f for f in docs.schema.fields if f.name != "found"]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 1000):
            pairs = [(None, []) if t is None else replaced(t, key) for t in batch.column("text").to_pylist()]
            found = pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), x, strict=True)) for x in f] for _, f in pairs], struct)
            columns = [pa.array([t for t, _ in pairs], pa.string()) if f.name == "text" else batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, found], [*(f.name for f in kept), "found"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "found array<struct<kind: string, start: long, end: long, pseudonym: string>>"])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and what was found, of every document."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
