"""Regular-expression text helpers (driver-side strings, never data)."""

from __future__ import annotations

import re

_ESCAPED_PAIR = re.compile(r"\\.", re.DOTALL)


def has_upper(text: str) -> bool:
    """Smart case: does a literal contain an upper-case letter?"""
    return any(ch.isupper() for ch in text)


def pattern_has_upper(pattern: str) -> bool:
    """Smart case for a pattern: escapes such as ``\\W`` do not count."""
    return has_upper(_ESCAPED_PAIR.sub("", pattern))


def quoted(text: str) -> str:
    """A pattern matching ``text`` literally."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def flagged(pattern: str, case_sensitive: bool) -> str:
    """Add flags so that only ``\\n`` ends a line and case folds beyond ASCII."""
    return ("(?md)" if case_sensitive else "(?imud)") + pattern
