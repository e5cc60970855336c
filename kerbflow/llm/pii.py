"""Personal data in texts: patterns propose spans, validators confirm them, words nearby adjust their score.

Each kind has a pattern, whose matches are taken leftmost first without overlap within the kind, and a validator: the range of
the parts of an address, the Luhn sum of a card, the number of digits of a phone, the rest modulo 97 of an IBAN (whose length its
country fixes) and of a French insurance number, the weighted sum of a bank's routing number, the barred numbers of a social
security number. A match that its validator refuses is dropped, and the search goes on behind it. Texts are read once per kind,
from left to right: no pattern can go back over what it has read more than once.

A confirmed span starts with the points of its kind; a supporting word within ``BEFORE`` code points before or ``AFTER`` behind it
adds ``SHIFT`` points and a contrary one takes them away (0 to 100). Spans of the base kinds (email, ip, card, phone) stay
whatever their score is, so that a caller may choose; those of the other kinds stay from ``least`` points on.

Defined results: NULL and empty texts have no spans. Rows are read one by one, so repeated rows agree and ids may be NULL or
repeated. Spans are in code points, the end exclusive, in the order of start, then kind as in ``KINDS``; spans of different kinds
may overlap. An empty table gives no rows. Texts of any length are read whole. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import bounded_batches

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "routing", "insee"]
BEFORE, AFTER, SHIFT, LEAST = 48, 24, 30, 60

# Points of a confirmed span without context; words that support it and words that speak against it.
POINTS = {"email": 80, "ip": 50, "card": 70, "phone": 50, "iban": 90, "ssn": 40, "routing": 30, "insee": 50}
SUPPORT = {
    "email": ["address", "contact", "email", "mail", "reach", "write"],
    "ip": ["address", "client", "host", "ip", "login", "server"],
    "card": ["amex", "card", "credit", "debit", "mastercard", "payment", "visa"],
    "phone": ["call", "cell", "fax", "mobile", "phone", "tel", "telephone"],
    "iban": ["account", "bank", "iban", "konto", "transfer"],
    "ssn": ["security", "social", "ssn"],
    "routing": ["aba", "bank", "routing", "transit", "wire"],
    "insee": ["insee", "nir", "secu", "securite", "sociale"],
}
AGAINST = {
    "email": ["example", "sample", "test"],
    "ip": ["build", "chapter", "release", "section", "version"],
    "card": ["invoice", "isbn", "order", "tracking"],
    "phone": ["isbn", "order", "version"],
    "iban": ["example", "sample", "test"],
    "ssn": ["model", "part", "serial", "sku"],
    "routing": ["isbn", "order", "tracking"],
    "insee": ["isbn", "order", "tracking"],
}
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that is no address is not tried again from its second digit: the run would be read as often as it is long.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
ROUTING = re.compile(r"[0-9]{9}")
INSEE = re.compile(r"[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}")
NO_DIGIT = re.compile("[^0-9]+")
WORD = re.compile("[a-z]+")
SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: int>>"


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second from the right doubled, ends in 0."""
    doubled = sum(int(d) // 5 + int(d) * 2 % 10 for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN, its first four places moved to the end and letters read as 10 to 35, leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def alone(text: str, start: int, end: int) -> bool:
    """No letter, digit or hyphen touches the span."""
    around = text[start - 1:start] + text[end:end + 1] if start else text[end:end + 1]
    return not any(c == "-" or c.isascii() and c.isalnum() for c in around)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address holds one @; what stands before it goes back to the last match or the first other character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        # a part of many digits is out of range unless it begins with as many zeros
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NO_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The country's length counts; capitals that follow after a space are not part of the number."""
    for m in IBAN.finditer(text):
        places = [k for k, c in enumerate(m.group()) if c != " "]
        size = IBAN_LENGTHS.get(m.group()[:2], 99)
        if size <= len(places):
            end = m.start() + places[size - 1] + 1
            if alone(text, m.start(), end) and mod97(text[m.start():end].replace(" ", "")):
                yield m.start(), end


def social_security(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and alone(text, *m.span()):
            yield m.span()


def routings(text: str) -> Iterator[tuple[int, int]]:
    for m in ROUTING.finditer(text):
        region = int(m.group()[:2])
        if (1 <= region <= 12 or 21 <= region <= 32 or 61 <= region <= 72 or region == 80) and alone(text, *m.span()) and (
                sum(int(d) * w for d, w in zip(m.group(), (3, 7, 1) * 3)) % 10 == 0):
            yield m.span()


def insees(text: str) -> Iterator[tuple[int, int]]:
    for m in INSEE.finditer(text):
        digits = m.group().replace(" ", "")
        if 1 <= int(digits[3:5]) <= 12 and (int(digits[:13]) + int(digits[13:])) % 97 == 0 and alone(text, *m.span()):
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, social_security, routings, insees)))


def score(text: str, kind: str, start: int, end: int, support: frozenset[str], against: frozenset[str]) -> int:
    near = f"{text[max(start - BEFORE, 0):start]} {text[end:end + AFTER]}"
    words = set(WORD.findall(near.lower() if near.isascii() else re.sub("[A-Z]", lambda c: c.group().lower(), near)))
    shift = SHIFT * (not support.isdisjoint(words)) - SHIFT * (not against.isdisjoint(words))
    return min(max(POINTS[kind] + shift, 0), 100)


def spans(text: str, least: int = LEAST) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of one text."""
    found = []
    for rank, kind in enumerate(KINDS):
        support, against = frozenset(SUPPORT[kind]), frozenset(AGAINST[kind])
        for start, end in FINDERS[kind](text):
            points = score(text, kind, start, end, support, against)
            if kind in BASE or points >= least:
                found.append((start, rank, end, points))
    return [(KINDS[rank], start, end, points) for start, rank, end, points in sorted(found)]


def redact(text: str, found: list[tuple[str, int, int, int]]) -> str:
    """The text with the name of its kind instead of each span; of overlapping spans the first gives the name."""
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out += text[at:start], f"<{kind}>"
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, least: int = LEAST, redacted: bool = False) -> DataFrame:
    """doc_id and ``spans`` of every row; with ``redacted`` also its text with the spans replaced."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))
    names = ("kind", "start", "end", "score")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t, least) for t in texts]
            columns = [batch.column(0), pa.array([[dict(zip(names, s)) for s in some] for some in found], span)]
            if redacted:
                columns.append(pa.array([redact(t, some) for t, some in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "redacted"][:len(columns)])

    shape = f"doc_id {kind}, spans {SPANS}" + (", redacted string" if redacted else "")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, shape)


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    every = F.col("spans")
    base = F.filter(every, lambda s: s["kind"].isin(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"),
        (F.size(every) - F.size(base)).cast("bigint").alias("n_added"), F.array_max(every["score"]).alias("top_score"))
