"""Tokens of the SQL dialect, found by one regular expression."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import BadSyntaxError

# The keywords of the dialect.
KEYWORDS = frozenset(
    "select from where and insert into values delete update set create table int varchar view as index on".split()
)
INT32_MAX = 2**31 - 1

_TOKEN = re.compile(
    r"""\s*(?:
        (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<int>[0-9]+)
      | '(?P<string>[^']*)'
      | (?P<open>')
      | (?P<delim>\S)
    )""",
    re.X,
)


class Token(NamedTuple):
    """kind: keyword, name, int, string, delim or end."""

    kind: str
    value: str | int

    def __str__(self) -> str:
        return "the end" if self.kind == "end" else repr(self.value)


def tokens(text: str) -> list[Token]:
    """All tokens of ``text`` and one of kind ``end``. Keywords and names are folded to lower case."""
    found, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "open":
            raise BadSyntaxError(f"the string that starts at {m.start('open')} does not end")
        value = m[kind]
        if kind == "word":
            value = value.lower()
            kind = "keyword" if value in KEYWORDS else "name"
        elif kind == "int":
            value = int(value)
            if value > INT32_MAX:
                raise BadSyntaxError(f"{value} is not an int of 32 bits")
        found.append(Token(kind, value))
        at = m.end()
    return [*found, Token("end", "")]
