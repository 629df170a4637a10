"""Questions as plain text, parsed on the driver: a question is a literal of the query."""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions.text import AGENT_STOP_WORDS, STOP_WORDS

_STOP = frozenset(STOP_WORDS)


def core_tokens(text: str) -> list[str]:
    """Runs of letters and numbers."""
    return re.findall(r"[^\W_]+", text)


def _camel(word: str) -> list[str]:
    cuts = [0]
    for i in range(1, len(word)):
        before, here, after = word[i - 1], word[i], word[i + 1 : i + 2]
        if here.isupper() and (before.islower() or (before.isupper() and after.islower())):
            cuts.append(i)
    return [word[a:b].lower() for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True) if b > a]


def split_identifier(word: str) -> list[str]:
    """Parts of an identifier in any of the usual spellings, lower-cased."""
    if "::" in word:
        parts = word.split("::")
    elif re.search("[<>]", word):
        parts = re.split(r"[,\s]+", re.sub("[<>]", " ", word))
    else:
        parts = [word]
    return [w for p in parts for piece in re.split("[_-]", p) for w in _camel(piece)]


def words(question: str) -> list[str]:
    """Words of a question that carry meaning."""
    kept = (w for w in re.findall(r"(?:[^\W_]|[._'])+", question) if w.lower() not in _STOP and len(w.encode()) > 1)
    return [p for w in kept for p in split_identifier(w) if p not in _STOP]


@lru_cache(maxsize=1024)
def _parsed(question: str) -> tuple[tuple[str, ...], ...]:
    w = words(question)
    return tuple(tuple(w[i : i + 4]) for i in range(0, len(w), 4)) + tuple((x,) for x in w)


def parse(question: str) -> list[list[str]]:
    """Phrases of a question: runs of up to four words, then every word."""
    return [list(p) for p in _parsed(question)]


def fuzzy_words(question: str) -> list[str]:
    """Words of a question to be looked up with typos; the stop list applies as spelt."""
    return [w for w in core_tokens(question) if w not in _STOP and len(w.encode()) > 1]


def hybrid_words(question: str) -> list[str]:
    """Lower-cased words for ranking; the stop list applies as spelt."""
    return [w.lower() for w in core_tokens(question) if w not in _STOP]


def agent_tokens(text: str) -> list[str]:
    return [t.lower() for t in re.findall("[a-zA-Z0-9_]+", text)]


def agent_words(question: str) -> list[str]:
    """Words of a question for the agent tools; all of them where only stop words are left."""
    t = agent_tokens(question)
    return [w for w in t if w not in AGENT_STOP_WORDS] or t
