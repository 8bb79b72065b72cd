"""Normalisation of rules text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.common import WORD_CHAR, bind, strip, text_or_empty

OWN_NAME = "this card"


@dataclass(frozen=True)
class NormalizeOptions:
    strip_reminder_text: bool = False
    replace_card_name: bool = True


def unix_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def drop_parentheticals(x: Column) -> Column:
    """Delete every ``( … )``, also across lines."""
    return F.regexp_replace(x, r"\([^)]*\)", "")


def replace_own_name(x: Column, name: Column) -> Column:
    """Put ``this card`` for each whole-word, case-sensitive mention of the name.

    The regex is compiled only for rows whose text holds the name at all.
    """
    plain = strip(text_or_empty(name))
    quoted = F.concat(F.lit(r"\Q"), F.replace(plain, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?<!{WORD_CHAR})"), quoted, F.lit(f"(?!{WORD_CHAR})"))
    mentioned = (plain != "") & x.contains(plain)
    return F.when(mentioned, F.regexp_replace(x, pattern, F.lit(OWN_NAME))).otherwise(x)


def tidy_whitespace(x: Column) -> Column:
    """One space per run, stripped lines, at most one blank line in a row."""
    single = F.regexp_replace(x, "[ \t]+", " ")
    lines = F.array_join(F.transform(F.split(single, "\n"), strip), "\n")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def normalize_rules_text(
    text: Column, name: Column, options: NormalizeOptions = NormalizeOptions()
) -> Column:
    """Normalised text; null gives the empty string."""
    out = strip(unix_newlines(text_or_empty(text)))
    if options.strip_reminder_text:
        out = drop_parentheticals(out)
    if options.replace_card_name:
        out = bind(out, lambda t: replace_own_name(t, name))
    return tidy_whitespace(out)
