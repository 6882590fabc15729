"""Secret scan: base patterns, and a token-efficiency test for random strings.

A vocabulary made from ordinary text spends few tokens on words and many on random strings: keys and
passwords come out at under ``MOST_RATIO`` characters a token. Runs of key-like characters are
measured as a whole; in those that pass, or that hold a digest of a usual length, a UUID, a date or
another known identifier, what lies between such identifiers and readable parts is measured by itself.
Runs with special characters in them are measured as a whole. Spans of the base patterns always stay.

The limit, measured over random strings of 16 to 48 characters and over the runs of the test documents: it finds
99 % or more of strings of letters of both cases and digits, 98 % where there is one case and digits, 86 to
99 % of lower-case letters alone, by length; 6 of 10,000 documents have a run of an invented word that is taken for random.

* null or empty text: no spans; very long text: linear time, whole; repeated documents: a row each;
* null doc_id: kept as null; empty table: no rows; further columns are not read.
"""

from __future__ import annotations

import re

import tiktoken
from pyspark.sql import DataFrame

from .bpe import load_ranks
from .common import id_text, kept, map_rows, ship
from .spans import digest, joined, ordered, overlaps

KINDS = ("assign", "access", "hex", "random")
#: A string with fewer characters a token is taken for random.
MOST_RATIO = 2.0
LEAST_CHARS = 16
#: With special characters, of which those at the ends are not measured.
LEAST_MIXED = 12
#: A shorter part may be a piece of a key with separators in it, so it is never readable by itself.
LEAST_READABLE = 4

# The base patterns. A run below its least length has no match, so {n,} stands for + and a check.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = re.compile(r"pass|secret|token|api", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
#: Passwords with special characters; those that structure text and code (quotes, brackets, = & ? / , ; : .) end a run.
_MIXED = re.compile(rf"[A-Za-z0-9!#$%*@^~+_-]{{{LEAST_CHARS},}}")
_SPECIAL = re.compile(r"[!#$%*@^~]")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ONLY = re.compile(r"(0x)?[0-9A-Fa-f]+")
# Hex characters of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_CHARS = frozenset({32, 40, 56, 64, 96, 128})
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_NUMBERS = re.compile(r"[0-9+/_=-]+")
_TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9-]+Z?")
#: A UUID, or what stands between separators.
_PART = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _ASSIGN_WORDS.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(found, KINDS)


def known_identifier(run: str) -> bool:
    """Digests, UUIDs, times and numbers with separators are random by nature but no secrets."""
    return bool(
        _UUID.fullmatch(run)
        or _TIME.fullmatch(run)
        or _NUMBERS.fullmatch(run)
        or (m := _HEX_ONLY.fullmatch(run)) and len(run) - 2 * bool(m[1]) in DIGEST_CHARS
    )


class TokenEfficiency:
    """Characters a token under a vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / len(self._encoding.encode_ordinary(run))

    def _pieces(self, run: str, most_ratio: float) -> list[tuple[int, int]]:
        """Where the run is to be measured: whole, and between its readable parts and known identifiers."""
        pieces, start, end, known = [], None, 0, False
        for m in _PART.finditer(run):
            part = m[0]
            identifier = not part.isdigit() and known_identifier(part)
            known |= identifier
            if identifier or len(part) >= LEAST_READABLE and not part.isdigit() and self.ratio(part) >= most_ratio:
                if start is not None:
                    pieces.append((start, end))
                start = None
            else:
                start, end = m.start() if start is None else start, m.end()
        if start is not None:
            pieces.append((start, end))
        return pieces if known else [(0, len(run)), *pieces]

    def random_spans(self, text: str, taken: list[tuple[str, int, int]], most_ratio: float) -> list[tuple[str, int, int]]:
        found = []
        if _SPECIAL.search(text):
            for m in _MIXED.finditer(text):
                run = m[0].strip("!#$%*@^~+_-")
                inside = set(_SPECIAL.findall(run))
                if len(run) < LEAST_MIXED or not inside or not (_DIGIT.search(run) and _LETTER.search(run)):
                    continue
                at = m.start() + m[0].index(run)
                span = ("random", at, at + len(run))
                if not overlaps(span, taken) and self.ratio(run) < most_ratio:
                    found.append(span)
        taken = [*taken, *found]
        for m in _RUN.finditer(text):
            run = m[0].strip("=-_/+")
            if len(run) < LEAST_CHARS or known_identifier(run):
                continue
            at = m.start() + m[0].index(run)
            for a, b in self._pieces(run, most_ratio):
                span, piece = ("random", at + a, at + b), run[a:b]
                if b - a < LEAST_CHARS or known_identifier(piece) or overlaps(span, taken):
                    continue
                if self.ratio(piece) < most_ratio:
                    found.append(span)
                    if b - a == len(run):
                        break
        return found


def scan(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", most_ratio: float = MOST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every document."""
    ship(docs.sparkSession)

    def run(rows):
        test = kept(__name__, (path, pattern), lambda: TokenEfficiency(path, pattern))
        for doc_id, text in rows:
            base = base_spans(text)
            more = test.random_spans(text, base, most_ratio)
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            yield doc_id, *counts, digest(base), joined(ordered([*base, *more], KINDS)), len(more)

    return map_rows(
        docs.select(*id_text(doc_id, text)), run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long",
    )
