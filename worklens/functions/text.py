"""Text expressions, as SQL text."""

from __future__ import annotations

# The characters Python's strip() removes.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: str) -> str:
    return f"trim(BOTH '{BLANKS}' FROM {column})"


def shape(column: str) -> str:
    """The text with every digit written as 0, to compare with a known form."""
    return f"translate({column}, '123456789', '000000000')"


def protocol_text(column: str) -> str:
    """Protocol number as text without thousands commas or a trailing ``.0``."""
    return f"regexp_replace(replace(CAST({column} AS STRING), ',', ''), '[.]0$', '')"
