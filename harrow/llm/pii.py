"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Each span has a score: that of its kind, raised if a word of its kind's context stands near, lowered if a word
stands near that speaks of something else (a part number, a version). Kinds of the base set stay whatever their
score; IBANs (mod 97) and national id numbers are added where the score reaches ``LEAST_SCORE``. Every pattern runs in linear time on any text: a run that
cannot start a match is passed over once.

* null or empty text: no spans; very long text: whole, in linear time; repeated documents: a row each;
* null doc_id: kept as null; empty table: no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import id_text, map_rows, ship
from .spans import digest, joined, ordered, overlaps

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LEAST_SCORE = 0.5
#: Code points on either side of a span in which context words count.
CONTEXT_CHARS = 60

# The base patterns, in forms that visit each character a bounded number of times.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NEAR = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_PART_OF_WORD = re.compile(r"[\w-]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Characters of an IBAN by country.
IBAN_CHARS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
LEAST_IBAN = 15

# Scores of the added kinds before context, and the words that raise them.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("address", "host", "server", "ip", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "paid"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
# The words that lower them.
AGAINST = {
    "email": ("example",),
    "ip": ("version", "release", "section"),
    "card": ("serial", "isbn", "part", "order"),
    "phone": ("serial", "part", "order"),
    "iban": ("serial", "part"),
    "ssn": ("serial", "part", "order", "isbn"),
}
CONTEXT_GAIN, CONTEXT_LOSS = 0.35, 0.25


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    A match is fixed by its @: the longest run of local characters before it, after the last match.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of IBANs: letters become two-digit numbers, the first four characters go last."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod 97 at their country's length, or at the end of any group where the country has none.

    A proposed run may take in words behind the IBAN, or start before it: the next one is looked for
    behind a confirmed span, else right behind the start of the run.
    """
    at = 0
    while m := _IBAN.search(text, at):
        at, n, fixed = m.start() + 1, 0, IBAN_CHARS.get(m[0][:2])
        for end in range(m.start() + 1, m.end() + 1):
            if text[end - 1] == " ":
                continue
            n += 1
            if n == fixed or not fixed and n >= LEAST_IBAN:
                if not _ALNUM.match(text, end) and mod97(text[m.start() : end]):
                    yield m.start(), end
                    at = end
                    break


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return ordered(found, KINDS)


def added_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found = [("iban", a, b) for a, b in ibans(text)]
    found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    return [s for s in found if not overlaps(s, taken) and score(text, s) >= LEAST_SCORE]


def near_words(text: str, a: int, b: int) -> set[str]:
    """The whole words, A-Z lowered, within CONTEXT_CHARS of the span."""
    start, stop = max(0, a - CONTEXT_CHARS), min(len(text), b + CONTEXT_CHARS)
    left, right = text[start:a], text[b:stop]
    found = _NEAR.findall(left), _NEAR.findall(right)
    # A word that the window cuts is none.
    if found[0] and start and _PART_OF_WORD.match(text[start - 1]) and _PART_OF_WORD.match(left[0]):
        found[0].pop(0)
    if found[1] and stop < len(text) and _PART_OF_WORD.match(text[stop]) and _PART_OF_WORD.match(right[-1]):
        found[1].pop()
    return {w.lower() for words in found for w in words}


def score(text: str, span: tuple[str, int, int]) -> float:
    """How sure a span is, from 0 to 1."""
    kind, a, b = span
    near = near_words(text, a, b)
    gain = CONTEXT_GAIN * (not near.isdisjoint(CONTEXT[kind])) - CONTEXT_LOSS * (not near.isdisjoint(AGAINST[kind]))
    return round(max(0.0, min(1.0, SCORES[kind] + gain)), 4)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in turn), n_added and top_score."""
    ship(docs.sparkSession)

    def run(rows):
        for doc_id, text in rows:
            base = base_spans(text)
            every = ordered([*base, *added_spans(text, base)], KINDS)
            counts = [sum(s[0] == k for s in base) for k in BASE]
            scores = [score(text, s) for s in every]
            yield doc_id, *counts, digest(base), joined(every), ",".join(f"{x:.2f}" for x in scores), len(every) - len(base), max(scores, default=0.0)

    return map_rows(
        docs.select(*id_text(doc_id, text)), run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string,"
        " scores string, n_added long, top_score double",
    )
