"""PII: format-preserving Feistel pseudonyms.

Personal numbers, dates and addresses are found by pattern, checked (Luhn, IBAN
check digits, number ranges, calendar), and replaced by a keyed permutation of
the values of the same format.  Equal values get equal pseudonyms in all
documents, different values of a format get different ones, and whoever has the
key can invert them.  What is permuted, by kind:

* ``email``: the local part, each letter and digit within its class.  Case and
  separators stay.  The domain stays.
* ``phone``: the digits after a leading ``+`` country code of one digit (of
  other forms all digits); layout stays, and so does a leading 0 or the form of
  a North American number.
* ``card``: the digits but the last, which is made a Luhn check digit again.
* ``iban``: the digits of the account part; the check digits are made anew.
* ``ssn``: the nine digits.
* ``ipv4``: among all dotted quads.
* ``date``: among the days of the years 1900 to 2099; layout stays.

The permutation is a Feistel network of ``ROUNDS`` rounds on two numbers of
about equal range, with keyed BLAKE2 as round function; values that fall out of
a format are sent round again (cycle walking), so results are in it.  A value
that maps to itself is sent round once more: no personal value survives, at the
price that two values of a format could meet with the chance of a fixed point.

Kinds are tried in the order above at each place; the longest kind first where
two begin together.  Work is per row, in Arrow batches, whatever the cluster.

Cases: a null text stays null, an empty one empty, both with no spans; rows
that repeat and null ids are kept; an empty table gives no rows; further
columns are ignored by ``pseudonymise`` and kept by ``with_pseudonyms``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
KEY = "demonstration key: pass your own"
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# with a plus: groups of 1 to 8 digits; of 1 to 8 after a 0; of 2 to 4; a plus and digits; a North American number
PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,8}(?:[ .-]\d{1,8}){1,6}(?!\d)"
                   r"|(?<![\w+.-])0\d{1,7}(?:[ .-]\d{1,8}){1,5}(?![\w-]|\.\d)|(?<![\w+.-])1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d)"
                   r"|(?<![\w+.-])1?[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)|(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\d.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{2}-\d{2}-\d{4})(?!\d|[-/.]\d)"
    rf"|(?<!\w)(?:\d{{1,2}} (?:{MONTHS}) \d{{4}}|(?:{MONTHS}) \d{{1,2}}, \d{{4}})(?!\w))"
    r"|(?P<ipv4>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d))"
    r"|(?P<card>(?<![\dA-Za-z+])\d(?:[ -]?\d){12,18}(?![\dA-Za-z]))"
    rf"|(?P<phone>{PHONE.pattern})")
_HINT = re.compile(r"[0-9@]")  # every kind has one


@lru_cache(maxsize=1 << 16)
def _round(key: bytes, tweak: bytes, i: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d:%d:" % (i, value) + tweak, key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel on (a, b) with a * b >= size."""
    if size < 2:
        return value
    b = int(size ** 0.5)
    while b * b < size:
        b += 1
    a = -(-size // b)
    mark = f"{tweak}:{size}".encode()
    while True:
        left, right = divmod(value, b)
        for i in range(0, ROUNDS, 2):
            left = (left + _round(key, mark, i, right)) % a
            right = (right + _round(key, mark, i + 1, left)) % b
        value = left * b + right
        if value < size:
            return value


def unpermute(value: int, size: int, key: bytes, tweak: str) -> int:
    """The inverse of ``permute``."""
    if size < 2:
        return value
    b = int(size ** 0.5)
    while b * b < size:
        b += 1
    a = -(-size // b)
    mark = f"{tweak}:{size}".encode()
    while True:
        left, right = divmod(value, b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - _round(key, mark, i + 1, left)) % b
            left = (left - _round(key, mark, i, right)) % a
        value = left * b + right
        if value < size:
            return value


def _moved(value: int, size: int, key: bytes, tweak: str, step: int = 1) -> int:
    """A keyed permutation of range(size) without fixed points (for two values or
    more): one step along the cycle that ``permute`` lays out.  Its inverse has step -1."""
    return unpermute((permute(value, size, key, tweak) + step) % size, size, key, tweak) if size > 1 else value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _digits(digits: str, key: bytes, tweak: str) -> str:
    return str(_moved(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits)) if digits else ""


def _day(text: str) -> tuple[dt.date, str] | None:
    for layout in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y", "%m-%d-%Y", "%d %B %Y", "%B %d, %Y"):
        try:
            day = dt.datetime.strptime(text, layout).date()
        except ValueError:
            continue
        if 0 <= day.toordinal() - FIRST_DAY < DAYS:
            return day, layout
    return None


def valid(kind: str, text: str) -> bool:
    """Whether a match is a value of its kind."""
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ipv4":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "date":
        return _day(text) is not None
    if kind == "ssn":
        return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"
    if kind == "iban":
        return iban_rest(text.replace(" ", "")) == 1
    if kind == "phone":
        return 7 <= len(digits) <= 15 and (text[0] == "+" or "(" in text or len(digits) >= 10 or bool(re.fullmatch(r"\d{3}[ .-]\d{4}", text)))
    return True


def _shorter(kind: str, text: str) -> str:
    """``text``, or what is valid of it without its last groups: a run of groups
    can go on behind an IBAN or a number with a plus."""
    own = text
    while (kind == "iban" or kind == "phone" and text[0] == "+") and not valid(kind, own):
        cut = max(own.rfind(c) for c in " .-")
        if cut < 1 or kind == "iban" and len(own[:cut].replace(" ", "")) < 15:  # the shortest IBANs have 15
            return text
        own = own[:cut]
    return own


def _form(digits: str) -> int:
    """What a phone number without a plus keeps, besides its layout."""
    return 1 if digits[0] == "0" else len(digits) if re.fullmatch(r"1?[2-9]\d{2}[2-9]\d{6}", digits) else 0


def _letters(text: str, key: bytes, tweak: str) -> str:
    """All letters and digits of ``text`` permuted together, each in its class."""
    classes = [next((x for x in (LOWER, UPPER, "0123456789") if c in x), "") for c in text]
    value, size = 0, 1
    for c, x in zip(text, classes, strict=True):
        if x:
            value, size = value * len(x) + x.index(c), size * len(x)
    value = _moved(value, size, key, tweak + "".join(x[:1] or c for c, x in zip(text, classes, strict=True)))
    out = []
    for c, x in zip(reversed(text), reversed(classes), strict=True):
        if x:
            value, i = divmod(value, len(x))
            c = x[i]
        out.append(c)
    return "".join(reversed(out))


def pseudonym(kind: str, text: str, key: bytes) -> str:
    """The value of the same format that stands for ``text``."""
    digits = re.sub(r"\D", "", text)
    if kind == "email":
        local, _, domain = text.rpartition("@")
        return f"{_letters(local, key, f'email:{domain.lower()}:')}@{domain}"
    if kind == "card":
        new = _digits(digits[:-1], key, "card")
        return _refill(text, new + next(c for c in "0123456789" if luhn(new + c)))
    if kind == "ipv4":
        n = 0
        for x in text.split("."):
            n = n * 256 + int(x)
        n = _moved(n, 1 << 32, key, "ipv4")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        day, layout = _day(text)
        new = dt.date.fromordinal(FIRST_DAY + _moved(day.toordinal() - FIRST_DAY, DAYS, key, "date")).strftime(layout)
        return re.sub(r"(?<!\d)0(\d)(?!\d)", r"\1", new) if re.search(r"(?<!\d)[1-9](?!\d)", text) else new
    if kind == "ssn":
        n = int(digits)
        while True:  # cycle walking over the valid numbers
            n = _moved(n, 10 ** 9, key, "ssn")
            new = _refill(text, str(n).zfill(9))
            if valid("ssn", new):
                return new
    if kind == "iban":
        plain = text.replace(" ", "")
        rest = plain[4:]
        own = "".join(c for c in rest if c.isdigit())
        new = _refill(rest, _digits(own, key, "iban" + plain[:2]))
        check = f"{98 - iban_rest(plain[:2] + '00' + new):02d}"
        it = iter(plain[:2] + check + new)
        return "".join(c if c == " " else next(it) for c in text)
    lead = 1 if text[0] == "+" else 0
    new = _digits(digits[lead:], key, "phone")
    while not lead and _form(new) != _form(digits):  # cycle walking
        new = _digits(new, key, "phone")
    return _refill(text, digits[:lead] + new)


def replace_text(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The pseudonymised text and (kind, start, end) of each value in the source."""
    spans, out, upto, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        found = _shorter(kind, m[0])
        if not valid(kind, found) and kind != "phone" and (phone := PHONE.match(text, m.start())):
            kind, found = "phone", phone[0]  # what fails as a card, say, may be one
        found = _shorter(kind, found)
        end = m.start() + len(found)
        if not valid(kind, found):
            at = m.start() + 1  # look on behind this run of letters and digits
            while at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
            continue
        spans.append((kind, m.start(), end))
        out += [text[upto: m.start()], pseudonym(kind, found, key)]
        upto = at = end
    return "".join([*out, text[upto:]]), spans


def with_pseudonyms(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and its spans in ``pii_spans``
    (kind:start:end, code points of the source, comma-joined)."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    names = [c for c in docs.columns if c != "pii_spans"]
    docs = docs.select(names)

    def run(batches):
        for b in batches:
            texts, spans = [], []
            for t in b.column(text_col).to_pylist():
                new, own = (t, []) if t is None else replace_text(t, secret) if _HINT.search(t) else (t, [])
                texts.append(new)
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in own))
            cols = [pa.array(texts, pa.string()) if n == text_col else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.string())], [*names, "pii_spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii_spans", T.StringType())]))


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, pii_spans, n_pii`` for every row."""
    out = with_pseudonyms(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), key)
    return out.withColumn("n_pii", F.when(F.col("pii_spans") == "", 0).otherwise(F.size(F.split("pii_spans", ","))).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
