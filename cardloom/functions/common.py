"""Small column helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Word characters as Python's Unicode \w understands them.
WORD_CHAR = r"[\p{L}\p{N}_]"


def strip(x: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(x, F.lit(WHITESPACE))


def text_or_empty(x: Column) -> Column:
    """Null text counts as empty text."""
    return F.coalesce(x, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    The lambda variable keeps the optimizer from copying an expensive expression
    (a tokenising regex, say) to each place of use.
    """
    return F.transform(F.array(value), body)[0]


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda t: t != "")


def words_between_spaces(x: Column) -> Column:
    """Split on single spaces and drop the empty pieces; tabs do not split."""
    return non_empty(F.split(x, " "))


def clean_strings(items: Column) -> Column:
    """Array of the non-null items as strings; a null array gives an empty one."""
    kept = F.filter(items, lambda x: x.isNotNull())
    return F.coalesce(F.transform(kept, lambda x: x.cast("string")), F.array().cast("array<string>"))


def json_text(value: Column) -> Column:
    """Map, array or struct as JSON text, null fields included."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def round_half_even(x: Column) -> Column:
    """Nearest whole number, halves to the even neighbour."""
    return F.bround(x, 0)
