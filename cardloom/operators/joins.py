"""Equi-joins on a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.project import optional_column, require_columns
from cardloom.session import BROADCAST_LIMIT, stored

# Rows of a task of a join whose sides are dealt beforehand.
JOIN_ROWS = 100_000
# Rows of a file of a table whose rows are costly to work on.
FILE_ROWS = 25_000


def dealt(*sides: DataFrame, key: str = "id", rows: int = JOIN_ROWS) -> list[DataFrame]:
    """The sides of joins on one key, each dealt by it into as many partitions, of about
    ``rows`` rows of the first side. Adaptive execution merges partitions by their
    compressed size, which says little of what rows that repeat each other take to sort."""
    parts = max(1, -(-sides[0].count() // rows))
    return [side.repartition(parts, key) for side in sides]


def evened(df: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """The rows in partitions of about ``rows`` rows, whatever their keys are. Scans are split
    by compressed bytes, so a table of short texts that repeat each other is read, and all that
    is made of it is worked out, by few tasks; files of few rows are shared among all of them."""
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


def left_join(
    left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "id"
) -> DataFrame:
    """Left join that takes only the named columns of the right side."""
    require_columns(right, [key, *columns], "right side")
    return left.join(right.select(key, *columns), key, "left")


def left_join_suffixed(
    left: DataFrame, right: DataFrame, columns: Sequence[str], suffix: str, key: str = "id"
) -> DataFrame:
    """Left join; right columns whose name the left side has too get the suffix."""
    renamed = [
        F.col(c).alias(c + suffix if c in left.columns else c) for c in columns
    ]
    return left.join(right.select(key, *renamed), key, "left")


def join_clusters(
    cards: DataFrame, clusters: DataFrame | None, key: str = "id"
) -> DataFrame:
    """Left join to the cluster table; without one, a null cluster."""
    if clusters is None:
        plain = cards.drop("cluster")
        return plain.select("*", optional_column(plain, "cluster", "int"))
    return left_join(cards.drop("cluster"), clusters, ["cluster"], key)


def aligned_join(left: DataFrame, row_map: DataFrame, key: str = "id") -> DataFrame:
    """Inner join to a row map, sorted by row; an error unless every row pairs up."""
    joined = stored(left.join(row_map, key, "inner"), "aligned")
    got, wanted = joined.count(), row_map.count()
    if got != wanted:
        raise ValueError(f"row alignment mismatch: joined {got} rows, row map has {wanted}")
    return joined.orderBy("matrix_row")


def lookup_with_default(
    rows: DataFrame, mapping: DataFrame, column: str, default: object, key: str = "id"
) -> DataFrame:
    """Look ``column`` up by key as string; the default where it is missing."""
    keyed = mapping.select(F.col(key).cast("string").alias("_key"), F.col(column).alias("_value"))
    found = rows.withColumn("_key", F.col(key).cast("string")).join(keyed, "_key", "left")
    return found.withColumn(column, F.coalesce(F.col("_value"), F.lit(default))).drop(
        "_key", "_value"
    )


def table_bytes(df: DataFrame, *, text: Sequence[str] = (), fixed: int = 64) -> int:
    """Bytes a settled table would take: measured text plus a fixed part per row."""
    length = sum((F.octet_length(c) for c in text), F.lit(0)).cast("long")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()
    return row["b"] + fixed * row["n"]


def small_side(df: DataFrame, size: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast a side whose measured size fits; beyond it leave a shuffle join,
    whose skewed keys adaptive execution splits."""
    return F.broadcast(df) if size <= limit else df
