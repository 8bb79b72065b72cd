"""Rule labelling as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.common import WORD_CHAR, strip
from cardloom.functions.label_rules import (
    FALLBACK,
    FALLBACK_LABEL,
    REVIEW_BELOW,
    RULE_SOURCE,
    RULES,
    Rule,
)


def label_text(normalized: Column, raw: Column) -> Column:
    """Normalised text, else raw text, else empty; in lower case."""
    return F.lower(
        F.coalesce(F.nullif(normalized, F.lit("")), F.nullif(raw, F.lit("")), F.lit(""))
    )


def lower_types(types: Column) -> Column:
    """Lower-cased type array; null counts as empty."""
    return F.coalesce(F.transform(types, F.lower), F.array().cast("array<string>"))


# A word boundary between Unicode word characters; the JVM's own differs on some digits.
_BOUNDARY = f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"


def found(text: Column, pattern: str) -> Column:
    """Regex search with Unicode classes; the dot stops at a line feed only."""
    return text.rlike("(?Ud)" + pattern.replace(r"\b", _BOUNDARY))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rule_applies(rule: Rule, text: Column, folded: Column, types: Column) -> Column:
    """The rule's conditions, cheap ones first so that ``and`` can stop early.

    ``folded`` is the text with the two letters folded that a case-blind search
    takes for plain ``s`` and ``i``.
    """
    tests: list[Column] = []
    for name, wanted in rule.types:
        has = F.array_contains(types, name)
        tests.append(has if wanted else ~has)
    if rule.blank is not None:
        is_blank = strip(text) == ""
        tests.append(is_blank if rule.blank else ~is_blank)
    if rule.words:
        tests.append(_any([text.contains(w) for w in rule.words]))
    if rule.signals:
        tests.append(~_any([text.contains(s) for s in rule.signals]))
    if rule.hints:
        tests.append(_any([folded.contains(h) for h in rule.hints]))
    for patterns in (rule.any_of, rule.also):
        if patterns:
            tests.append(_any([found(folded, p) for p in patterns]))
    tests.extend(~found(folded, p) for p in rule.unless)
    return reduce(lambda a, b: a & b, tests)


_MATCH_TYPE = "array<struct<label:string,confidence:double,source:string,reason:string>>"


def _match(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.label).alias("label"),
        F.lit(rule.confidence).cast("double").alias("confidence"),
        F.lit(RULE_SOURCE).alias("source"),
        F.lit(rule.reason).alias("reason"),
    )


def ranked_rules(rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by confidence, highest first, ties in rule order.

    Confidences are constants, so ranking happens here and not per row. A label may
    occur once only; then its best match is its only match.
    """
    names = [r.label for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("each label needs exactly one rule")
    return sorted(rules, key=lambda r: -r.confidence)


def rule_hits(
    text: Column, folded: Column, types: Column, rules: Sequence[Rule] = RULES
) -> Column:
    """Ranked matches of one row; empty when no rule applies.

    Concatenated from one array per rule: unlike an array filter this compiles.
    """
    none = F.array().cast(_MATCH_TYPE)
    return F.concat(
        *[
            F.when(rule_applies(r, text, folded, types), F.array(_match(r))).otherwise(none)
            for r in ranked_rules(rules)
        ]
    )


def or_fallback(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(_match(FALLBACK)))


def fold_letters(text: Column) -> Column:
    """Fold the long s and the dotless i, which a case-blind search equates with s and i."""
    return F.translate(text, "\u017f\u0131", "si")


def labels_of(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["label"])


def map_of(matches: Column, field: str) -> Column:
    """Map from label to one field of its match."""
    return F.map_from_entries(
        F.transform(matches, lambda m: F.struct(m["label"].alias("key"), m[field].alias("value")))
    )


def max_confidence(matches: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["confidence"])), F.lit(0.0))


def review_flag(matches: Column) -> Column:
    return F.array_contains(labels_of(matches), FALLBACK_LABEL) | (
        max_confidence(matches) < REVIEW_BELOW
    )
