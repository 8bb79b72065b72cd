"""Card dumps, Parquet tables and vector artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.operators.project import MissingInput, core_projection
from cardloom.operators.tfidf import TfidfConfig, TfidfModel

_TEXT = (
    "id", "oracle_id", "name", "released_at", "lang", "layout", "type_line", "oracle_text",
    "mana_cost",
)
CARD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [
        T.StructField(c, T.ArrayType(T.StringType()))
        for c in ("colors", "color_identity", "keywords")
    ]
    + [T.StructField("legalities", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("set", "set_name", "rarity")]
    + [T.StructField("cmc", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("power", "toughness")]
)

# Folders of stored postings: their usual size, and how many there may be.
PART_ROWS = 1_000_000
MOST_PARTS = 4096
# Tasks that write the rows of a usual folder; more share a larger one.
TASKS_A_PART = 2


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def require_path(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise MissingInput(f"missing {path}")
    return path


def read_cards(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Cards from JSON arrays under a declared schema, core columns only.

    A ``whole_file`` array is parsed by one task per file; write the result to
    Parquet once and go on from there. Files with one array (or card) per line are
    split among tasks. Malformed input and values of a wrong type raise an error.
    """
    require_path(spark, path)
    raw = spark.read.schema(CARD_SCHEMA).option("multiLine", whole_file).option("mode", "FAILFAST").json(path)
    return core_projection(raw.withColumn("released_at", F.to_timestamp("released_at")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(require_path(spark, path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_vectors(model: TfidfModel, weights: DataFrame, ids: DataFrame, path: str) -> None:
    """Vocabulary, weights and row ids, keyed by id instead of by position."""
    write_table(model.vocabulary, f"{path}/vocabulary")
    write_table(weights, f"{path}/weights")
    write_table(ids.select("id"), f"{path}/row_ids")


def save_postings(weights: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """``weights`` (a stored table) again, dealt into folders by term.

    Folders hold about ``part_rows`` rows each, or are at most ``MOST_PARTS``; a query
    reads those of its own terms. Folders of many rows, as those of frequent terms are, are
    written by several tasks, split by id in proportion to their rows.
    """
    parts = min(MOST_PARTS, max(1, weights.count() // part_rows))
    part = F.pmod("term_idx", F.lit(parts)).cast("int").alias("part")
    # MOST_PARTS rows at most.
    sizes = {r["part"]: r["count"] for r in weights.groupBy(part).count().collect()}
    splits = [max(1, -(-sizes.get(p, 0) * TASKS_A_PART // part_rows)) for p in range(parts)]
    dealt = weights.select("id", "term_idx", "weight", F.lit(parts).alias("parts"), part)
    if sum(splits) > 1:
        split = F.pmod(F.xxhash64("id"), F.lit(splits)[F.col("part")])
        dealt = dealt.repartition(sum(splits), "part", split)
    dealt.sortWithinPartitions("part", "term_idx").write.mode("overwrite").partitionBy("parts", "part").parquet(path)


def load_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The stored postings in the folders of ``terms`` (term_idx, those of one document)."""
    postings = read_table(spark, path)
    written_as = postings.select("parts").first()
    if written_as is None:
        return postings
    part = F.pmod("term_idx", F.lit(written_as["parts"])).alias("part")
    wanted = [r["part"] for r in terms.select(part).distinct().collect()]  # MOST_PARTS at most
    return postings.filter(F.col("part").isin(wanted))


def load_vectors(
    spark: SparkSession, path: str, config: TfidfConfig = TfidfConfig()
) -> tuple[TfidfModel, DataFrame, DataFrame]:
    vocabulary = read_table(spark, f"{path}/vocabulary")
    weights = read_table(spark, f"{path}/weights")
    ids = read_table(spark, f"{path}/row_ids")
    model = TfidfModel(vocabulary, ids.count(), vocabulary.count(), config)
    return model, weights, ids
