"""Exact dedup by an extendible-hash index in shared files, in DataFrame functions only."""

from __future__ import annotations

import uuid
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.session import checkpoint_root

from .common import by_key, written

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
# Keys that a bucket holds before it is split, and the bits that a directory may have:
# at most 2^16 entries of two numbers, so that it can be broadcast. Buckets of a full
# directory grow with the keys: 1.5 million keys, about 60 MB, for 10^11 texts.
BUCKET_KEYS, MOST_BITS = 8192, 16
# Keys (of eight bytes) that are broadcast to find the texts that must be compared.
BROADCAST_KEYS = 2_000_000
_INDEX = "h long, link string, n long, keep_id long, keep_chars long, bucket long"


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of a hash: its cell in a directory of that depth."""
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def _best() -> tuple[Column, Column, Column]:
    """Aggregates (n, keep_chars, best): ``best`` orders by most code points, then least id,
    null last, in one number of fixed width, which a hash aggregate can hold."""
    order = F.expr("cast(chars as decimal(38, 0)) * 36893488147419103232 - coalesce(cast(id as decimal(38, 0)), 9223372036854775808)")
    return F.count(F.lit(1)).alias("n"), F.max("chars").alias("keep_chars"), F.max(order).alias("best")


def _keep_id() -> Column:
    order = "cast(keep_chars as decimal(38, 0)) * 36893488147419103232 - best"
    return F.expr(f"if({order} < 9223372036854775808, cast({order} as long), null)")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(cell, bucket) and the directory's depth in bits, for a table of distinct keys ``h``.

    A directory of depth d has 2^d entries; it is doubled until no bucket holds over
    ``bucket_keys`` keys, or 16 bits are used. A bucket that fits at fewer bits is not split
    further: all entries below it point to it. ``bucket`` is the bucket's first cell, so
    buckets are ranges of keys. The loads of all depths come from one count at the deepest.
    """
    # Keys are hashes, so the first depth is seldom doubled again.
    deepest = min(MOST_BITS, max(0, ceil(log2(max(1, 8 * keys.count() / bucket_keys)))))
    while True:
        cells = written(keys.groupBy(_prefix(deepest).alias("cell")).agg(F.count(F.lit(1)).alias("load")), "exact-cells")
        if deepest == MOST_BITS or (cells.agg(F.max("load")).first()[0] or 0) <= bucket_keys:
            break
        deepest += 1
    ways = cells.select(
        "cell", "load", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("bits")
    ).withColumn("prefix", F.expr(f"shiftright(cell, {deepest} - bits)"))
    load = F.sum("load").over(Window.partitionBy("bits", "prefix"))
    fits = ways.withColumn("held", load).filter((F.col("held") <= bucket_keys) | (F.col("bits") == deepest))
    local = fits.groupBy("cell").agg(F.min("bits").alias("bits"))
    bucket = F.expr(f"shiftleft(shiftright(cell, {deepest} - bits), {deepest} - bits)")
    return local.select("cell", bucket.alias("bucket")), deepest


def build_index(docs: DataFrame, rows: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index of ``rows`` (id, h, chars), read back: (h, link, n, keep_id, keep_chars, bucket).

    A key is a hash of a text. Copies are counted by key first, with partial sums before the
    shuffle, so that a text with many copies is one entry of the index and cannot overfill a
    bucket. Texts whose key has several rows are grouped by their bytes. Owner tasks take
    whole buckets, chain the texts of a key and write a folder for each bucket. ``link`` is
    the digest of a text where its key has a chain of several; it is null else.
    """
    spark = docs.sparkSession
    keys = written(rows.groupBy("h").agg(*_best()), "exact-keys")
    cells, bits = directory(keys.select("h"), bucket_keys)
    shared = keys.filter("n > 1").select("h")
    few = shared.count() <= BROADCAST_KEYS
    texts = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        without_spaces(F.col("text")).alias("norm"),
    ).withColumn("h", F.xxhash64("norm"))
    if few:
        texts = texts.join(F.broadcast(shared), "h", "left_semi")
    links = texts.groupBy("h", "norm").agg(*_best()).select(
        "h", F.sha2("norm", 256).alias("link"), "n", _keep_id().alias("keep_id"), "keep_chars"
    )
    if few:
        # A key with one row needs no comparison.
        alone = keys.filter("n = 1").select("h", F.lit(None).cast("string").alias("link"), "n", _keep_id().alias("keep_id"), "keep_chars")
        links = links.unionByName(alone)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chain = F.count(F.lit(1)).over(Window.partitionBy("bucket", "h"))
    owned = (
        links.withColumn("cell", _prefix(bits))
        .join(F.broadcast(cells), "cell")
        .repartition(owners, "bucket")
        .withColumn("link", F.when(chain > 1, F.col("link")))
        .select("h", "link", "n", "keep_id", "keep_chars", "bucket")
        .sortWithinPartitions("bucket", "h")
    )
    path = f"{checkpoint_root(spark).rstrip('/')}/exact-index-{uuid.uuid4().hex}"
    owned.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(T.StructType.fromDDL(_INDEX)).parquet(path)


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal if their bytes are, without ASCII white space; null is empty. Of equal
    texts the row with the most code points stays, then the one with the smallest doc_id,
    null last; ``keep_id`` is its doc_id. Of rows that repeat doc_id and text, one is kept.
    An empty table gives no rows, very long texts are compared whole, other columns are
    ignored.

    Texts cross the shuffle only if their key is shared, and once a task at most.
    """
    packed = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        without_spaces(F.col("text")).alias("norm"),
    ).select(
        F.monotonically_increasing_id().alias("row"), "id", "chars",
        F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"),
    )
    rows = written(packed, "exact-rows")
    index = build_index(docs, rows, bucket_keys).drop("bucket")
    found = by_key(rows, index, ["h"], "n", rows.count())
    found = written(found.filter("link is null or link = sha").drop("link"), "exact-found")

    # Rows that repeat the row that stays: the first of them, as written, stays.
    best = found.filter("n > 1 and id <=> keep_id and chars = keep_chars")
    repeated = best.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first")).filter("copies > 1")
    repeated = written(repeated, "exact-repeated")
    marked = by_key(found, repeated, ["h", "sha"], "copies", rows.count(), "left")
    kept = F.expr("id <=> keep_id and chars = keep_chars and coalesce(row = first, true)")
    return marked.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever those are called.

    As ``exact_duplicates``; of rows that repeat doc_id and text, any one stays.
    """
    judged = exact_duplicates(docs, bucket_keys).filter("kept")
    stays = judged.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"),
        F.sha2(without_spaces(F.col("text")), 256).alias("sha"),
    )
    same = keyed.id.eqNullSafe(stays.id) & (keyed.sha == stays.sha)
    best = keyed.join(stays, same, "left_semi")
    # A doc_id may stand with several texts that differ in white space: the longest stays.
    one = best.groupBy("id", "sha").agg(F.max_by("row", "chars").alias("row"))
    return one.select("row.*")
