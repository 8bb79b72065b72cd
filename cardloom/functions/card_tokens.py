"""Tokeniser for rules text: phrases, symbols, counters, numbers, line breaks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.common import WORD_CHAR, bind, strip, text_or_empty

# Phrases that become one token.
PHRASES = (
    "enters the battlefield",
    "until end of turn",
    "at the beginning of",
    "as long as",
    "you may",
    "target creature",
    "target player",
    "target opponent",
    "draw a card",
)

LINE_BREAK = "NEWLINE"
SEPARATORS = " .,;:!?\n"


@dataclass(frozen=True)
class TokenOptions:
    keep_newlines: bool = True
    lowercase: bool = True
    phrases: Sequence[str] = PHRASES


def join_phrases(x: Column, phrases: Sequence[str] = PHRASES) -> Column:
    """Glue each phrase with underscores, longest phrase first, ignoring case.

    A plain substring test spares most texts the regex.
    """

    def glue(phrase: str):
        pattern = rf"(?iu)(?<!{WORD_CHAR})\Q{phrase}\E(?!{WORD_CHAR})"
        joined = phrase.replace(" ", "_")
        return lambda t: F.when(
            F.lower(t).contains(phrase.lower()), F.regexp_replace(t, pattern, joined)
        ).otherwise(t)

    for phrase in sorted(phrases, key=len, reverse=True):
        x = bind(x, glue(phrase))
    return x


def _scan_pattern(keep_newlines: bool) -> str:
    # A symbol in braces, or a run of characters that are no separator and do not
    # start such a symbol. Possessive runs keep long tokens off the regex stack.
    symbol = r"\{[^}\n]+\}"
    run = rf"(?:[^{SEPARATORS}{{]++|\{{(?![^}}\n]+\}}))++"
    return ("\n|" if keep_newlines else "") + symbol + "|" + run


def _typed(token: Column) -> Column:
    # Tokens that start with a plain letter need no regex.
    return (
        F.when((token >= "A") & (token < "{"), token)
        .when(token == "\n", F.lit(LINE_BREAK))
        .when(
            token.startswith("{") & token.rlike(r"^\{[^}]+\}$"),
            F.concat(F.lit("MANA:"), F.upper(token)),
        )
        .when(token.rlike(r"(?U)^[+-]\d/[+-]\d$"), F.concat(F.lit("COUNTER:"), token))
        .when(token.rlike(r"(?U)^\d+$"), F.concat(F.lit("NUM:"), token))
        .otherwise(token)
    )


def card_tokens(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """Tokens of a normalised text as ``array<string>``; null gives none.

    Blank lines go first: the break of the line before already stands for them.
    Separators at the end go too, since all they could add is trailing breaks.
    """
    lines = F.transform(F.split(strip(text_or_empty(text)), "\n"), strip)
    out = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    if options.lowercase:
        out = F.lower(out)
    out = join_phrases(out, options.phrases)
    out = F.rtrim(out, F.lit(SEPARATORS))
    found = F.regexp_extract_all(out, F.lit(_scan_pattern(options.keep_newlines)), F.lit(0))
    return F.transform(found, _typed)
