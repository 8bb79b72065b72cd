"""Type, token and enriched tables from the core table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.card_tokens import TokenOptions, card_tokens
from cardloom.functions.rules_text import NormalizeOptions, normalize_rules_text
from cardloom.functions.type_line import TYPE_ARRAYS, over_faces, type_faces
from cardloom.operators.project import optional_column, require_columns


def with_type_arrays(df: DataFrame) -> DataFrame:
    """Add ``type_faces`` and the three card-level arrays; no join needed."""
    require_columns(df, ["type_line"])
    faced = df.withColumn("type_faces", type_faces(F.col("type_line")))
    return faced.withColumns({c: over_faces(F.col("type_faces"), c) for c in TYPE_ARRAYS})


def type_features(core: DataFrame) -> DataFrame:
    return with_type_arrays(core).select(
        "id", optional_column(core, "oracle_id"), "name", "type_line", *TYPE_ARRAYS, "type_faces"
    )


def with_normal_text(
    df: DataFrame, options: NormalizeOptions = NormalizeOptions()
) -> DataFrame:
    require_columns(df, ["oracle_text", "name"])
    text = normalize_rules_text(F.col("oracle_text"), F.col("name"), options)
    return df.withColumn("oracle_text_norm", text)


def oracle_tokens(
    core: DataFrame,
    normalize: NormalizeOptions = NormalizeOptions(),
    tokens: TokenOptions = TokenOptions(),
) -> DataFrame:
    normal = core if "oracle_text_norm" in core.columns else with_normal_text(core, normalize)
    return normal.select(
        "id",
        optional_column(core, "oracle_id"),
        "name",
        "oracle_text_norm",
        card_tokens(F.col("oracle_text_norm"), tokens).alias("oracle_tokens"),
    )


def enriched_cards(
    core: DataFrame, options: NormalizeOptions = NormalizeOptions()
) -> DataFrame:
    """Core table plus normalised text and type arrays, in one pass over the rows."""
    return with_type_arrays(with_normal_text(core, options)).drop("type_faces")
