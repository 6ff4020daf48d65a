"""Personal data under format-preserving pseudonyms.

Emails, IBANs, card numbers, phone numbers, social security numbers, IPv4 and IPv6 addresses, dates and secret tokens are
found by pattern and validated (lengths by country or card network, checksums, ranges, the calendar). Each value is
permuted within its format by a keyed Feistel network: digits stay digits and letters letters, check digits are made
anew, cards stay in their network, dates stay dates and addresses addresses. The permutation is a bijection that depends
on the key and the format alone, so equal values get equal pseudonyms in all documents, different ones stay different,
and the holder of the key can undo it (``restore``). Cards and IBANs end where their number does, so words and numbers
behind them change nothing; what follows is searched again.

The key is the caller's. The registered query takes it from ``spark.quern.pii.key``, and a demonstration key where that is
not set.

Edge cases: a null text stays null and an empty one empty; values that fail validation are left alone; a value that
overlaps one found before it (left to right, by the order of kinds) is part of that one; a null doc_id stays null;
repeated rows are treated alike; very long texts are searched whole; extra columns pass through ``pseudonymise``, but
the counts take the place of columns of their names; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, documents

DEMONSTRATION_KEY = "quern demonstration key"
ROUNDS = 10
KINDS = ("email", "iban", "token", "ipv6", "card", "phone", "ssn", "ip", "date", "secret")
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Letters beyond ASCII that are permuted too.
LOWER_1, UPPER_1 = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]))"
    r"|(?P<token>(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,90}|glpat-[A-Za-z0-9_-]{20}|sk-[A-Za-z0-9_-]{20,200}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,100}|xox[abprs]-[A-Za-z0-9-]{10,200}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000})(?![\w-]))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{1,4}:|:)(?:[0-9A-Fa-f]{1,4}:){0,6}(?::(?:[0-9A-Fa-f]{1,4}:){0,6})?[0-9A-Fa-f]{0,4}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:]|\.[0-9]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,40}(?![\w]))"
    r"|(?P<phone>(?<!\w)(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<!\w)\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w.-])[2-9][0-9]{2}(?: ?[0-9]{3} ?)[0-9]{4}(?![\w-]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}(?P<gap>[ -])[0-9]{2}(?P=gap)[0-9]{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<secret>(?<![\w])(?:(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}|(?=[0-9A-F]*[0-9])[0-9A-F]{32,64})(?!\w))"
)
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Card networks by their first digits (which pseudonyms keep) and lengths.
NETWORKS = tuple(
    (re.compile(prefix), lengths)
    for prefix, lengths in (
        ("4", (13, 16, 19)),
        ("5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720", (16,)),
        ("3[47]", (15,)),
        ("30[0-5]|3[689]", (14, 16, 19)),
        ("35(?:2[89]|[3-8][0-9])", (16, 17, 18, 19)),
        ("6011|64[4-9]|65|62", (16, 17, 18, 19)),
        ("50|5[6-8]|6[0137]", (13, 14, 15, 16, 17, 18, 19)),
    )
)
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _round(key: bytes, tweak: str, i: int, half: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=key[:64], digest_size=16).digest(), "big") % size


def permute(value: int, left: int, right: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed bijection of range(left * right): alternating rounds add to one part a function of the other."""
    a, b = divmod(value, right)
    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        sign = -1 if undo else 1
        if i % 2 == 0:
            a = (a + sign * _round(key, tweak, i, b, left)) % left
        else:
            b = (b + sign * _round(key, tweak, i, a, right)) % right
    return a * right + b


def permute_below(value: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed bijection of range(size), walking on while outside."""
    side = 1
    while side * side < size:
        side += 1
    while True:
        value = permute(value, side, side, key, tweak, undo)
        if value < size:
            return value


def permute_string(s: str, alphabet: str, key: bytes, tweak: str, undo: bool = False) -> str:
    n, r = len(s), len(alphabet)
    if not n:
        return s
    value = 0
    for c in s:
        value = value * r + alphabet.index(c)
    size = r**n
    value = permute_below(value, size, key, f"{tweak}{n}", undo) if n == 1 else permute(value, r ** (n // 2), r ** (n - n // 2), key, f"{tweak}{n}", undo)
    out = []
    for _ in range(n):
        value, c = divmod(value, r)
        out.append(alphabet[c])
    return "".join(reversed(out))


def permute_letters(s: str, key: bytes, tweak: str, undo: bool = False) -> str:
    """Each class of characters (digits, lower and upper case, ASCII or Latin-1) permuted as one string; others stay."""
    for alphabet in (DIGITS, LOWER, UPPER) if s.isascii() else (DIGITS, LOWER, UPPER, LOWER_1, UPPER_1):
        at = [i for i, c in enumerate(s) if c in alphabet]
        new = permute_string("".join(s[i] for i in at), alphabet, key, tweak + alphabet[0], undo)
        chars = list(s)
        for i, c in zip(at, new, strict=True):
            chars[i] = c
        s = "".join(chars)
    return s


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def network(digits: str) -> int | None:
    """How many first digits name the card's network; None if its length fits no network."""
    for prefix, lengths in NETWORKS:
        if len(digits) in lengths and (m := prefix.match(digits)):
            return m.end()
    return None


def _card(value: str) -> str | None:
    """The card number that a run of digit groups begins with."""
    borders = [i for i in range(1, len(value) + 1) if value[i - 1] in DIGITS and (i == len(value) or value[i] not in DIGITS)]
    found = []
    for end in borders:
        digits = "".join(c for c in value[:end] if c in DIGITS)
        if 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits[:-1]) == int(digits[-1]):
            sizes = [len(g) for g in re.split("[ -]", value[:end])]
            even = set(sizes[:-1]) <= {4} and sizes[-1] <= 4 or len(sizes) == 1
            if network(digits) is not None or even:
                found.append((network(digits) is None, len(digits) != 16, -len(digits), value[:end]))
    return min(found)[3] if found else None


def _iban(text: str, at: int) -> str | None:
    """The IBAN that begins there, of its country's length, in groups of any size."""
    left, end = IBAN_LENGTHS.get(text[at : at + 2], 0), at
    if not left:
        return None
    while left:
        c = text[end : end + 1]
        if c == " " and text[end + 1 : end + 2].isalnum():
            end += 1
        elif c and c in DIGITS + UPPER:
            end, left = end + 1, left - 1
        else:
            return None
    behind = text[end : end + 1]
    value = text[at:end]
    return value if not (behind.isalnum() or behind == "_") and valid("iban", value) else None


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def _iban_check(country: str, rest: str) -> str:
    n = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{98 - n % 97:02d}"


def valid(kind: str, value: str) -> bool:
    digits = "".join(c for c in value if c in DIGITS)
    if kind == "card":
        return _card(value) == value
    if kind == "iban":
        s = value.replace(" ", "")
        return len(s) == IBAN_LENGTHS.get(s[:2]) and _iban_check(s[:2], s[4:]) == s[2:4]
    if kind == "ipv6":
        try:
            return value.count(":") > 2 and bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "ip":
        return all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in value.split("."))
    if kind == "date":
        return _date(value) is not None
    return True


def _date(value: str) -> tuple[datetime.date, str] | None:
    sep = next(c for c in value if c not in DIGITS)
    a, b, c = value.split(sep)
    order = "ymd" if len(a) == 4 else "dmy"
    y, m, d = (a, b, c) if order == "ymd" else (c, b, a)
    if order == "dmy" and int(m) > 12:
        order, m, d = "mdy", d, m
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return (day, order + sep) if 0 <= day.toordinal() - FIRST_DAY < DAYS else None


def pseudonym(kind: str, value: str, key: bytes, undo: bool = False) -> str:
    """The value's pseudonym; with undo, the value of the pseudonym, an IPv6 address in its shortest spelling."""
    digits = "".join(c for c in value if c in DIGITS)
    if kind == "card":
        kept = network(digits)
        body = digits[:-1]
        while True:  # others than the networks' stay so
            body = body[: kept or 0] + permute_string(body[kept or 0 :], DIGITS, key, f"card{body[: kept or 0]}", undo)
            whole = body + str(luhn(body))
            if (kept is not None or network(whole) is None) and len(set(whole)) > 1:
                return _refill(value, whole)
    if kind == "token":
        head = re.match("AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_(?:live|test)_|xox[abprs]-|AIza|eyJ", value).group()
        return head + permute_letters(value[len(head) :], key, head, undo)
    if kind == "ipv6":
        n = permute(int(ipaddress.IPv6Address(value)), 1 << 64, 1 << 64, key, "ipv6", undo)
        return str(ipaddress.IPv6Address(n))
    if kind == "phone" and len(digits) == 10 and digits[0] >= "2" and "+" not in value:  # alike in all spellings
        return _refill(value, str(permute_below(int(digits) - 2 * 10**9, 8 * 10**9, key, "phone", undo) + 2 * 10**9))
    if kind == "phone":
        code = len(value[1:]) - len(value[1:].lstrip(DIGITS)) if value.startswith("+") else 0
        return _refill(value, digits[:code] + permute_string(digits[code:], DIGITS, key, f"phone{code}", undo))
    if kind == "ssn":  # the valid numbers, in order
        areas = [a for a in range(1, 900) if a != 666]
        n = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        n = permute_below(n, len(areas) * 99 * 9999, key, "ssn", undo)
        n, last = divmod(n, 9999)
        area, group = divmod(n, 99)
        return _refill(value, f"{areas[area]:03d}{group + 1:02d}{last + 1:04d}")
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, permute(n, 1 << 16, 1 << 16, key, "ip", undo).to_bytes(4, "big")))
    if kind == "date":
        day, order = _date(value)
        # dates that only one reading fits stay among those, so that the order can be read off again
        keep = (lambda d: d.day > 12) if order[0] == "m" else (lambda d: True)
        n = day.toordinal() - FIRST_DAY
        while True:
            n = permute_below(n, DAYS, key, f"date{order[0] == 'm'}", undo)
            day = datetime.date.fromordinal(FIRST_DAY + n)
            if keep(day):
                break
        part = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
        return order[3].join(part[c] for c in order[:3])
    if kind == "iban":
        s = value.replace(" ", "")
        rest = permute_letters(s[4:], key, "iban" + s[:2], undo)
        it = iter(s[:2] + _iban_check(s[:2], rest) + rest)
        return "".join(" " if c == " " else next(it) for c in value)
    if kind == "secret":
        return permute_string(value, HEX if value.islower() else HEX.upper(), key, "secret", undo)
    user, _, host = value.partition("@")
    names, _, top = host.rpartition(".")
    return f"{permute_letters(user, key, 'user', undo)}@{permute_letters(names, key, 'host', undo)}.{top}"


_cached = lru_cache(maxsize=100_000)(pseudonym)


def _at(kind: str, text: str, start: int, end: int) -> int | None:
    """The end of the valid value of a kind that begins at start, where the kind's pattern matched to end."""
    if kind == "iban":
        found = _iban(text, start)
    elif kind == "card":
        found = _card(text[start:end])
    else:
        found = text[start:end] if valid(kind, text[start:end]) else None
    return None if found is None else start + len(found)


def find(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end of each valid value, left to right."""
    if "@" not in text and "::" not in text and not any(d in text for d in DIGITS):
        return []
    out, at = [], 0
    while m := PATTERN.search(text, at):
        start, kind = m.start(), m.lastgroup if m.lastgroup != "gap" else "ssn"
        end = _at(kind, text, start, m.end())
        if end is None:  # another kind may fit at the same place
            for kind in KINDS[KINDS.index(kind) + 1 :]:
                if (o := _ALONE[kind].match(text, start)) and (end := _at(kind, text, start, o.end())) is not None:
                    break
        if end is not None:
            out.append((kind, start, end))
            at = end
            continue
        # go on behind the first run of characters
        at = start + 1
        while at < m.end() and text[at].isalnum():
            at += 1
    return out


_ALONE = {k: re.compile(p) for k, p in zip(KINDS, re.split(r"\|(?=\(\?P<)", PATTERN.pattern), strict=True)}


def replace(text: str, key: bytes, undo: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, or with undo the values back in their place, and how many of each kind."""
    found = find(text)
    if not found:
        return text, {}
    parts, counts, last = [], {}, 0
    for kind, start, end in found:
        parts += [text[last:start], _cached(kind, text[start:end], key, undo)]
        counts[kind] = counts.get(kind, 0) + 1
        last = end
    return "".join([*parts, text[last:]]), counts


def _changed(docs: DataFrame, key: bytes, undo: bool) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [(None, {}) if t is None else replace(t, key, undo) for t in batch.column("text").to_pylist()]
        names = batch.schema.names
        columns = [pa.array([d[0] for d in done], pa.string()) if c == "text" else batch.column(c) for c in names]
        counts = [pa.array([d[1].get(k, 0) for d in done], pa.int64()) for k in KINDS]
        return pa.RecordBatch.from_arrays([*columns, *counts], [*names, *(f"n_{k}" for k in KINDS)])

    kept = docs.select([c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}])
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return arrow_map(kept, one, f"{fields}, " + ", ".join(f"n_{k} long" for k in KINDS))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns with pseudonyms in text, and the number of values of each kind."""
    return _changed(docs, key, False)


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``pseudonymise`` with their values back in text."""
    return _changed(docs, key, True)


def op1(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quern.pii.key", DEMONSTRATION_KEY)
    x = pseudonymise(documents(spark, sf_dir), key.encode())
    return x.withColumn("n_values", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col("n_email")))
