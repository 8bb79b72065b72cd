"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
# Odd, nearest to 2^31 / golden ratio: multiples modulo 2^31 fill the interval evenly.
GOLDEN, RANGE = 1327217885, 1 << 31
CELLS = 4096


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, k, source_size, target, quota) per source of ``rows`` (source, size).

    Sources by code point, null last, take the weights in turn. Targets share the sum of
    all sizes by weight but stop at ``most`` times the source's size; what is left over is
    shared again. In the order of size over weight the stopped sources come first, so one
    pass finds them. Works on one row per source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("k"), F.lit(len(weights))) + 1)
    table = (
        sizes.withColumn("k", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn(
            "stopped",
            F.col("cap") * (F.col("weights") - F.col("weight_before"))
            <= (F.col("total") - F.col("cap_before")) * F.col("weight"),
        )
        .withColumn("cap_stopped", F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("weight_left", F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(everything))
    )
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * (F.col("total") - F.col("cap_stopped")) / F.col("weight_left")
    )
    return table.withColumn("target", target).select(
        "source", "k", "source_size", "target",
        F.least(F.round("target").cast("long"), F.col("cap")).alias("quota"),
    )


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, k, rank): which source each block of the mix comes from, ranked per source.

    Slots are points of a golden-ratio sequence mapped through the cumulative quotas, cut
    into cells so that points meet their source by an equal key. Ranks are counted per run
    of slots and then added up, so that no source is ranked in one task. Blocks that the
    sequence leaves short of a quota follow at the end; surplus points are left out.
    """
    spark = sources.sparkSession
    need = sources.select("k", F.ceil(F.col("quota") / block).cast("long").alias("blocks"))
    n = need.agg(F.sum("blocks").alias("n")).first().n or 0
    ends = F.sum("blocks").over(Window.orderBy("k")).cast("double") / max(n, 1)
    share = need.filter("blocks > 0").select(
        "k", "blocks", ends.alias("high"), (ends - F.col("blocks") / max(n, 1)).alias("low")
    )
    cells = share.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell"),
    )
    point = F.pmod(F.pmod(F.col("id"), F.lit(RANGE)) * GOLDEN, F.lit(RANGE)) / RANGE
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cells, "cell").filter("u >= low and u < high").select("slot", "k", F.floor(F.col("slot") / 65536).alias("run"))
    runs = drawn.groupBy("k", "run").agg(F.count(F.lit(1)).alias("points"))
    earlier = Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("points").over(earlier), F.lit(0)))
    in_run = F.row_number().over(Window.partitionBy("k", "run").orderBy("slot")) - 1
    ranked = (
        drawn.withColumn("in_run", in_run)
        .join(runs, ["k", "run"])
        .select("slot", "k", (F.col("before") + F.col("in_run")).alias("rank"))
        .join(share.select("k", "blocks"), "k")
        .filter("rank < blocks")
        .select("slot", "k", "rank")
    )
    got = runs.groupBy("k").agg(F.sum("points").alias("got"))
    rest = (
        share.join(got, "k", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("got < blocks")
        .select("k", F.explode(F.expr("sequence(got, blocks - 1)")).alias("rank"))
        .select((F.col("rank") * 0 + n + F.col("k")).alias("slot"), "k", "rank")
    )
    return ranked.union(rest)


def mix_pieces(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 256):
    """(placed, pieces): the rows placed in their sources' streams and the mix's pieces.

    ``rows`` has doc_id, source, size and any other slim columns. Each source's rows are
    put in the order of a hash of doc_id (``placed`` adds k, start, source_size, target);
    the stream is repeated up to ``most`` times and cut into blocks of equal size; the
    blocks are joined to the schedule's slots. A piece is a run of one row's words:
    (k, start, slot, epoch, first, last).
    """
    from .common import written

    n = rows.count()
    digits = max(1, ceil(log(max(n, 2) / 10_000, 16)))
    sources = written(source_targets(rows, weights, most), "sources")
    keyed = (
        rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        .withColumn("part", F.substring("order", 1, digits))
        .join(sources, rows.source.eqNullSafe(sources.source))
        .drop(sources.source)
    )
    parts = keyed.groupBy("k", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("k", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("k", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(parts, ["k", "part"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("before", "inside", "part", "order"),
        "placed",
    )
    pieces = (
        placed.filter("size > 0")
        .select("k", "start", "size", "source_size", "quota", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"))
        .withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
        .filter(F.col("from") < F.col("to"))
        .withColumn("rank", F.explode(F.expr(f"sequence(from div {block}, (to - 1) div {block})")))
        .join(schedule(sources, block), ["k", "rank"])
        .select(
            "k", "start", "slot", "epoch",
            (F.greatest("from", F.col("rank") * block) - F.col("from")).alias("first"),
            (F.least("to", (F.col("rank") + 1) * block) - F.col("from")).alias("last"),
        )
    )
    return placed, pieces


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words per row and a hash of the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("h"),
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 256) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    The mix takes ``taken`` words of the row, repeats counted, never over ``most`` times
    its size; per source they add up to the rounded target. Null texts have size 0, null
    is a source of its own, repeated rows are rows like others, an empty table gives none.
    The order of the mix depends on doc_id and size only, so reruns agree.
    """
    placed, pieces = mix_pieces(sizes(docs), weights, most, block)
    taken = pieces.groupBy("k", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    full = placed.filter("size > 0").join(taken, ["k", "start"], "left").union(
        placed.filter("size = 0").select(*["k", "start"], *[c for c in placed.columns if c not in ("k", "start")], F.lit(None).cast("long"))
    )
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 256) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with ``taken`` and ``pieces``.

    ``pieces`` lists (slot, epoch, first, last): at that slot of the mix come the row's
    words first to last - 1. Rows that repeat doc_id and text share out their pieces.
    Input columns named taken or pieces are replaced; others may have any names.
    """
    placed, pieces = mix_pieces(sizes(docs), weights, most, block)
    piece = F.struct("slot", "epoch", "first", "last")
    lists = pieces.groupBy("k", "start").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    per_row = (
        placed.filter("size > 0").join(lists, ["k", "start"])
        .groupBy(F.col("doc_id").alias("id"), "h").agg(F.array_sort(F.collect_list("pieces")).alias("lists"))
    )
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    copy = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    numbered = packed.withColumn("copy", copy)
    joined = numbered.join(per_row, numbered.id.eqNullSafe(per_row.id) & (numbered.h == per_row.h))
    mine = F.get("lists", F.col("copy") - 1)
    taken = F.aggregate(mine, F.lit(0).cast("long"), lambda s, p: s + p["last"] - p["first"])
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("taken", "pieces")]
    return joined.filter(mine.isNotNull()).select(*columns, taken.alias("taken"), mine.alias("pieces"))
