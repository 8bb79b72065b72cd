"""Row numbers, top-n, head and tail, seeded samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.session import settle

_LOCAL_ROW = (1 << 33) - 1


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """Number all rows from 0 in the given total order, without a single-task sort.

    Range-partition and sort, settle that layout, then add to each row's place in
    its partition the number of rows in the partitions before. Only the partition
    counts go through one task.
    """
    laid_out = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_local": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_ROW)),
            }
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row per partition of the layout, so the broadcast is small.
    return (
        laid_out.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )


def top_per_group(
    df: DataFrame, group: str | Sequence[str], order: Sequence[Column | str], n: int,
    rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps n rows per group and task
    before the shuffle, so a hot group never travels whole."""
    keys = [group] if isinstance(group, str) else list(group)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows, in ascending order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly n rows (all, when there are fewer), the same for any partitioning.

    Rows are ordered by a hash of seed and key. A first cut at a hash value that
    should let through slightly more than n rows keeps the top-n small; when the cut
    leaves fewer than n, the whole table is ranked instead.
    """
    drawn = df.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    total = df.count()
    wanted = n + 10 * math.sqrt(n) + 10
    if wanted < total:
        cut = format(int(wanted / total * (1 << 60)), "015x")
        thinned = drawn.filter(F.col("_draw") < cut)
        if thinned.count() >= n:
            drawn = thinned
    return drawn.orderBy("_draw", key).limit(n).drop("_draw")


def capped_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """The table itself, or a seeded sample of n rows when it is larger."""
    return seeded_sample(df, n, seed, key) if df.count() > n else df
