"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.common import round_half_even


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Non-null values with their count, most frequent first, ties by value.

    Nulls drop out by their count of 0. A filter on the value would be pushed below
    the projection and compute an expensive column (labels, say) twice.
    """
    counted = (
        df.groupBy(column)
        .agg(F.count(column).alias("count"))
        .filter(F.col("count") > 0)
        .orderBy(F.desc("count"), column)
    )
    return counted if n is None else counted.limit(n)


def item_counts(df: DataFrame, column: str, item: str, n: int | None = None) -> DataFrame:
    """Value counts over the items of an array column; empty arrays add nothing."""
    return value_counts(df.select(F.explode(column).alias(item)), item, n)


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias("distinct_count"))


def key_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Row count, distinct non-null keys, and whether the two agree."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(column).alias("distinct_count")
    ).withColumn("is_unique", F.col("row_count") == F.col("distinct_count"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long")
    )


def share_true(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def null_share(df: DataFrame, n: int | None = None) -> DataFrame:
    """Share of nulls per column, from one pass, largest first."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], list(df.columns), "column_name", "null_share")
    ordered = long.orderBy(F.desc("null_share"), "column_name")
    return ordered if n is None else ordered.limit(n)


def whole_number_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts by nearest whole number (halves to even), nulls left out, by value."""
    value = round_half_even(F.col(column)).cast("int")
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("value")
    )


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def size_summary(df: DataFrame, group: str) -> DataFrame:
    """Count, mean, spread and quartiles of the group sizes.

    Works on one number per group, counted by size first, so that the exact
    percentiles hold one entry per distinct size.
    """
    by_size = group_sizes(df, group).groupBy("size").agg(F.count(F.lit(1)).alias("freq"))
    n, total = F.sum("freq"), F.sum(F.col("size") * F.col("freq"))
    squares = F.sum((F.col("size") * F.col("size")).cast("double") * F.col("freq"))
    variance = (squares - total * total / n) / (n - 1)
    quarter = [
        F.percentile("size", q, F.col("freq")).alias(name)
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    ]
    return by_size.agg(
        n.alias("count"),
        (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        F.min("size").alias("min"),
        *quarter,
        F.max("size").alias("max"),
    )


def size_rank(df: DataFrame, group: str) -> DataFrame:
    """Groups numbered from 1 by size, largest first. One row per cluster, so the
    single window partition stays small."""
    order = Window.orderBy(F.desc("size"), group)
    return group_sizes(df, group).withColumn("size_rank", F.row_number().over(order))
