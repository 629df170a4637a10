"""Tokeniser for source code of the curly-brace kind: literals become classes, comments and spaces go."""

from __future__ import annotations

import re

_PARTS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<raw>b?r(?P<hash>\#*)".*?"(?P=hash))
    |(?P<text>b?"(?:\\.|[^"\\])*")
    |(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\])')
    |(?P<name>[^\W\d]\w*)
    |(?P<number>\d[\w.]*)
    |(?P<op><<=|>>=|\.\.=|\.\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.)
    |(?P<one>.)""",
    re.X | re.S,
)


def lex(code: str) -> list[str]:
    """Tokens of source code; string, raw string and character literals as STR, RAW_STR and CHAR."""
    out = []
    for m in _PARTS.finditer(code):
        kind = m.lastgroup if m.lastgroup != "hash" else "raw"
        if m["raw"] is not None:
            out.append("RAW_STR")
        elif kind == "text":
            out.append("STR")
        elif kind == "char":
            out.append("CHAR")
        elif kind != "skip":
            out.append(m[0])
    return out
