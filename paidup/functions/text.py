"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Whitespace as Python's str.strip sees it: the Unicode White_Space characters and the
# four information separators.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(_SPACES))


def normal(text: Column) -> Column:
    """Upper case without surrounding whitespace."""
    return F.upper(strip(text))


def blank_to_null(text: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.split(text, r"(?U)[\s\x1c-\x1f]+")


def labelled(label: str, text: Column) -> Column:
    """``**label:** text``, null when the text is missing or blank."""
    value = blank_to_null(text)
    return F.when(value.isNotNull(), F.concat(F.lit(f"**{label}:** "), value))


def trailing_zero_dropped(document: Column) -> Column:
    """Document numbers that a sheet stored as numbers end in ``.0``."""
    return F.regexp_replace(document, r"\.0$", "")
