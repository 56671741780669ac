"""Normalising freely typed values."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

#: Cyrillic and Greek letters and the Latin ones they look like.
LOOKALIKES = str.maketrans("аАеЕоОрРсСхХуУіІјЈкКмМтТвВнНѕЅԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "aAeEoOpPcCxXyYiIjJkKmMtTbBhHsSdhABEZHIKMNOPTYXoav")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÄÖÅ])(?=[A-ZÄÖÅ])")
_NUMBER = re.compile(r"(?:\bno\W*)?\d+", re.I)
_SPLIT = re.compile(r"[\W_]+")
_BROKEN = re.compile("[ÃÂ][\x80-¿]")


def decoded(value: str) -> str:
    """The text behind escapes, broken encodings, look-alike letters and invisible characters."""
    s = value
    # each turn that changes anything shortens the text, so this ends
    while (t := unquote(html.unescape(s))) != s and len(t) < len(s):
        s = t
    if _BROKEN.search(s):
        try:
            s = s.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    s = unicodedata.normalize("NFKC", s)
    s = "".join(c for c in s if c.isspace() or unicodedata.category(c) not in ("Cf", "Cc"))
    return s.translate(LOOKALIKES)


def folded(text: str) -> str:
    """``text`` without marks on its letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words(value: str) -> list[str]:
    """The words of a value, lower case and without marks, numbers and punctuation."""
    s = _NUMBER.sub(" ", decoded(value))
    if not s.isupper():
        s = _CAMEL.sub(" ", s)
    return [w for w in _SPLIT.split(folded(s.casefold())) if w]


def blank(value: str | None) -> bool:
    """NULL, empty or nothing but white space."""
    return value is None or not value.strip()


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    last, row = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        new = [i]
        for j, cb in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ca != cb))
            if last is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, last[j - 2] + 1)
            new.append(d)
        last, row = row, new
    return row[-1]


def allowed(term: str) -> int:
    """Edits within which a text still stands for a term: one in four letters, rounded, at least one."""
    return max(1, (len(term) + 2) // 4)
