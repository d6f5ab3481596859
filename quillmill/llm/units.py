"""Texts cut into units that tokenizers encode alike alone and in their text.

A unit ends before a space, tab or line feed that follows other than white space, and before an ASCII digit or sign that
follows a Latin letter.  Byte-level BPE splits its input at both places before any merge, so no token lies across; a
vocabulary of pieces has to be asked, which ``pieces_respect`` does.  Joined, the units are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Letters after which, and signs before which, a unit ends.
LETTER, SIGN = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-@\[-`{-~"
_BODY = rf"[^\s{LETTER}]*+(?:[{LETTER}]++(?![{SIGN}])[^\s{LETTER}]++)*+[{LETTER}]*+"
_UNIT = re.compile(rf"\s*+{_BODY}(?:[^\S \t\n]\s*+{_BODY})*+")
_EDGE = re.compile(r"(?<=\S)[ \t\n]")
_ACROSS = re.compile(rf"[{LETTER}][{SIGN}]|[^\s▁][▁ \t\n]")
#: Characters that are cut into units at a time.
PART = 1 << 20


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in order, cut where a unit ends, each part some ``size`` characters long; without such a place it is one part."""
    at = 0
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


def units(text: str) -> list[str]:
    found = _UNIT.findall(text)
    found.pop()  # the empty match at the end
    return found


def pieces_respect(pieces: Iterable[str]) -> bool:
    """Whether no piece of a vocabulary (▁ for space) lies across the end of a unit."""
    return not any(_ACROSS.search(p) for p in pieces)


#: Texts at the edges of the rule, for tests of whoever uses it.
UNIT_CASES = ["", " ", "a", "\n", "a b", "a  b ", "a\n b", "a\n\n  b", "a,b", "a, b", "don't", "x'", "sha256", "a_b", "a\r\nb", "a\xa0b", "a\xa0 b", "a \xa0b", ";\r", "a\tb", "ß.", "²."]
