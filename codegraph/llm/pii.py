"""Personal data in texts: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

The base kinds (email, ip, card, phone) are always reported once their checks hold. Two more kinds need more than a
pattern: iban passes mod-97, and ssn has no checksum and so counts only where a context word stands near it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
NEAR, LEAST = 48, 0.5
# The score a confirmed span starts with, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
BONUS = 0.3
CONTEXT = {
    "email": "mail email contact write",
    "ip": "ip address host server",
    "card": "card credit visa mastercard amex payment",
    "phone": "phone tel call mobile fax",
    "iban": "iban bank account transfer",
    "ssn": "ssn social security",
}
WORDS = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")\b", re.I) for k, v in CONTEXT.items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where its run of digits begins, so looking back keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Characters of an IBAN by country.
IBAN_SIZE = {
    x[:2]: int(x[2:])
    for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
    FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21
    LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19
    SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()
}
OWN_IBAN = {k: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for k, n in IBAN_SIZE.items()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def is_ip(s: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: the part before each @ is followed backwards, so no text is scanned twice."""
    done = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the country's length, else the longest, that pass mod-97; after a span that doesn't, the search goes on within it."""
    at = 0
    while m := IBAN.search(text, at):
        own = OWN_IBAN.get(m[0][:2])
        found = next((x for x in (own and own.match(text, m.start()), m) if x and mod97(x[0])), None)
        if found:
            yield found.span()
        at = found.end() if found else m.start() + 4


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    found = [("email", *m) for m in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
        found += [("iban", *m) for m in ibans(text)]
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    scored = []
    for kind, a, b in found:
        near = WORDS[kind].search(text, max(0, a - NEAR), a) or WORDS[kind].search(text, b, b + NEAR)
        score = min(1.0, PRIOR[kind] + BONUS * bool(near))
        if kind in BASE or score >= LEAST:
            scored.append((kind, a, b, score))
    return scored


def _written(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of the base kinds, base_sha256, spans (kind:start:end, code points, end exclusive) and scores.

    Null text counts as empty, which has no spans. Rows are independent: repeated rows, null ids and an empty table
    need nothing special, and other columns are not read. Time is linear in a text's length.
    """
    bare = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = bare.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                found = spans(text)
                base = [x for x in found if x[0] in BASE]
                kinds = [x[0] for x in base]
                row = [*map(kinds.count, BASE), hashlib.sha256(_written(base).encode()).hexdigest(), _written(found), ",".join(f"{x[3]:.2f}" for x in found)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], ["id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return map_batches(bare, scan, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def redact(text: str, least: float = LEAST) -> str:
    """text with each span of at least this score replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b, score in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if a >= at and score >= least:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
