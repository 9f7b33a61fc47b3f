"""Case folding, character by character, as the pattern matcher compares."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_char(c: str) -> str:
    """The character's upper-case form in lower case, by mappings of one character to one.

    Two characters match each other without regard to case just when this is
    the same for both.
    """
    upper = c.upper()
    # A form of several characters is not a mapping of the character itself.
    return (upper if len(upper) == 1 else c).lower()[0]


@cache
def _otherwise() -> tuple[str, str]:
    """Characters that plain lower-casing treats otherwise, and what they fold to.

    It knows the long s, the dotless i or the variants of Greek letters as
    letters of their own, gives the dotted I two characters, and picks a small
    sigma by its place in a word.
    """
    cased = (c for c in map(chr, range(0x20000)) if c.isalpha() or not c.isalnum())
    found = {c: f for c in cased if (f := fold_char(c)) != c.lower()} | {"Σ": "σ"}
    return "".join(found), "".join(found.values())


def fold(text: Column) -> Column:
    """A text without its differences of case; a part of a text folds as it does inside the whole."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.lower(F.translate(text, *_otherwise())))


def fold_text(text: str) -> str:
    """``fold`` of a literal."""
    return "".join(map(fold_char, text))


def folds_alike_everywhere(c: str) -> bool:
    """Is a character old enough for its case to be the same in every version of Unicode in use?"""
    return unicodedata.ucd_3_2_0.category(c) != "Cn"
