"""Word tokens and n-grams for the TF-IDF vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.common import WORD_CHAR, bind, text_or_empty


def word_tokens(text: Column, lowercase: bool = True) -> Column:
    """All maximal runs of word characters, one-letter words included."""
    x = text_or_empty(text)
    if lowercase:
        x = F.lower(x)
    return F.regexp_extract_all(x, F.lit(f"{WORD_CHAR}+"), F.lit(0))


def spaced_words(text: Column, lowercase: bool = True) -> Column:
    """The text with its words set apart by ASCII characters that are in no word, for tasks that
    cut it by bytes: plain ASCII as it is, in any case of letters, other text as its words with
    spaces between them."""
    x = text_or_empty(text)
    plain = F.is_valid_utf8(x) & (F.octet_length(x) == F.char_length(x))
    return F.when(plain, x).otherwise(F.array_join(word_tokens(x, lowercase), " "))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """Space-joined n-grams of all sizes from ``low`` to ``high``.

    Built by zipping shifted slices, so no lambda indexes back into the array.
    """

    def grams(w: Column) -> Column:
        sizes, current = [], w
        for n in range(1, high + 1):
            if n > 1:
                count = F.greatest(F.size(w) - (n - 1), F.lit(0))
                current = F.zip_with(
                    F.slice(current, 1, count),
                    F.slice(w, n, count),
                    lambda a, b: F.concat(a, F.lit(" "), b),
                )
            if n >= low:
                sizes.append(current)
        return F.concat(*sizes)

    return bind(words, grams)


def gram_runs(grams: Column) -> Column:
    """The grams in sorted order as ``(term, opens)`` structs.

    ``opens`` is 1 on the first copy of a term in this row and 0 on the others, so
    one explode yields document frequency (sum of ``opens``) and corpus frequency
    (row count) without grouping by document.
    """

    def mark(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), s)
        return F.zip_with(
            s,
            F.slice(before, 1, F.size(s)),
            lambda a, b: F.struct(
                a.alias("term"), F.when(b.isNull() | (a != b), 1).otherwise(0).alias("opens")
            ),
        )

    return bind(F.sort_array(grams), mark)
