"""Projections, null handling and simple filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the core table, in order.
CORE_COLUMNS = (
    "id",
    "oracle_id",
    "name",
    "released_at",
    "lang",
    "layout",
    "type_line",
    "oracle_text",
    "mana_cost",
    "colors",
    "color_identity",
    "keywords",
    "legalities",
    "set",
    "set_name",
    "rarity",
    "cmc",
    "power",
    "toughness",
)


class MissingInput(Exception):
    """A needed table, file or column is absent; the message names it."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingInput(f"{what} is missing {', '.join(missing)}")
    return df


def core_projection(df: DataFrame, columns: Sequence[str] = CORE_COLUMNS) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    return df.select(*[c for c in columns if c in df.columns])


def optional_column(df: DataFrame, name: str, data_type: str = "string") -> Column:
    """The column, or a typed null where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(data_type).alias(name)


def fill_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def drop_nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def where_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def where_in(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def where_name_is(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Equality that ignores case; a null name counts as empty."""
    return df.filter(F.lower(F.coalesce(F.col(column), F.lit(""))) == F.lower(F.lit(name)))


def first_match(df: DataFrame, name: str, column: str = "name", key: str = "id") -> DataFrame:
    """The matching row with the smallest key; an error when nothing matches."""
    row = where_name_is(df, name, column).orderBy(key).limit(1)
    if row.isEmpty():
        raise LookupError(f"no row with {column} '{name}'")
    return row
