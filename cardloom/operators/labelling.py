"""Label tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.common import json_text
from cardloom.functions.label_rules import RULES, TAXONOMY, Rule
from cardloom.functions.labels import (
    fold_letters,
    label_text,
    labels_of,
    lower_types,
    map_of,
    max_confidence,
    or_fallback,
    review_flag,
    rule_hits,
)
from cardloom.operators.joins import join_clusters
from cardloom.operators.project import optional_column, require_columns
from cardloom.operators.stats import share_true, value_counts

_MAPS = {
    "label_confidences": "confidence",
    "label_sources": "source",
    "label_reasons": "reason",
}


def with_matches(cards: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``matches``: the ranked label records of each row. One projection, no
    shuffle; every rule is a regex or substring test on the row itself."""
    require_columns(cards, ["basic_types"])
    text = label_text(
        optional_column(cards, "oracle_text_norm"), optional_column(cards, "oracle_text")
    )
    return (
        cards.withColumns({"_text": text, "_types": lower_types(F.col("basic_types"))})
        .withColumn("_folded", fold_letters(F.col("_text")))
        .withColumn("_hits", rule_hits(F.col("_text"), F.col("_folded"), F.col("_types"), rules))
        .withColumn("matches", or_fallback(F.col("_hits")))
        .drop("_text", "_types", "_folded", "_hits")
    )


def card_labels(
    cards: DataFrame,
    clusters: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    as_json: bool = False,
) -> DataFrame:
    """The label table. Maps are real maps, or JSON text on request."""
    matches = F.col("matches")
    maps = {name: map_of(matches, field) for name, field in _MAPS.items()}
    if as_json:
        maps = {name: json_text(m) for name, m in maps.items()}
    matched = with_matches(join_clusters(cards, clusters), rules)
    return matched.select(
        "id",
        optional_column(matched, "oracle_id"),
        optional_column(matched, "name"),
        optional_column(matched, "type_line"),
        optional_column(matched, "cmc", "double"),
        "cluster",
        matches[0]["label"].alias("primary_label"),
        labels_of(matches).alias("labels"),
        *[m.alias(name) for name, m in maps.items()],
        max_confidence(matches).alias("max_confidence"),
        review_flag(matches).alias("needs_review"),
    )


def labels_long(cards: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per card and label, with its rank from 1.

    Every row has at least one match (the fallback), so the outer explode adds no
    row; it spares the optimizer's size filter, which would copy the rules below
    the projection and run them twice.
    """
    exploded = with_matches(cards, rules).select("id", F.posexplode_outer("matches"))
    return exploded.select(
        "id",
        (F.col("pos") + 1).alias("label_rank"),
        F.col("col.label").alias("label"),
        F.col("col.confidence").alias("confidence"),
        F.col("col.source").alias("source"),
        F.col("col.reason").alias("reason"),
    )


def best_match_per_label(*rule_sets: DataFrame) -> DataFrame:
    """Keep the most confident match of each card and label among the label rows of
    several rule sets. Of equal ones the earlier set's stays, then the smaller source."""
    fields = ("id", "label", "confidence", "source", "reason")
    rows = [s.select(*fields, F.lit(k).alias("place")) for k, s in enumerate(rule_sets)]
    together = reduce(DataFrame.unionByName, rows)
    order = F.struct(-F.col("confidence"), "place", "source", "reason")
    record = F.struct("confidence", "source", "reason")
    return (
        together.groupBy("id", "label")
        .agg(F.min_by(record, order).alias("best"))
        .select("id", "label", "best.*")
    )


def taxonomy(spark: SparkSession) -> DataFrame:
    """The fixed taxonomy as a dimension table, sorted by label."""
    rows = [(t.label, t.category, t.description) for t in TAXONOMY]
    return spark.createDataFrame(rows, "label string, category string, description string").orderBy(
        "label"
    )


def label_names() -> list[str]:
    return sorted(t.label for t in TAXONOMY)


def with_taxonomy(long_labels: DataFrame) -> DataFrame:
    """Add category and description; the taxonomy is a fixed list of 35 rows."""
    return long_labels.join(F.broadcast(taxonomy(long_labels.sparkSession)), "label", "left")


def label_summary(labels: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row: cards labelled, distinct primary labels, share to review, clusters."""
    one = labels.agg(
        F.count(F.lit(1)).alias("cards_labeled"),
        F.count_distinct("primary_label").alias("primary_labels"),
        share_true(F.col("needs_review")).alias("review_share"),
        F.count_distinct("cluster").alias("clusters"),
    )
    if clusters is None:
        return one
    found = clusters.agg(F.count_distinct("cluster").alias("n")).first()["n"]
    return one.withColumn("clusters", F.lit(found).cast("long"))


def primary_label_counts(labels: DataFrame, n: int | None = None) -> DataFrame:
    return value_counts(labels, "primary_label", n)
