"""A corpus from raw documents: identify, dedup lines and documents, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the
folder in ``spark.checkpoint.dir`` and reads again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import decontaminate, language_id, line_dedup, mixing, simhash
from cardloom.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that language ID rejects: no letter, or no language's code fits."""
    model = language_id.fit(docs.filter(~language_id.held_out(docs)))
    return language_id.predict(docs, model).filter("accepted").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove copied and nearly copied lines; a text may become empty, rows stay."""
    judged = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_removed") > 0, F.array_join("kept_lines", "\n")).otherwise(F.col("row.text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = text
    if "n_chars" in columns:
        changed = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(F.col("row.n_chars"))
    return judged.select(*[value.alias(name) for name, value in columns.items()])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated rows; cut the passages of test items from the others."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix with the words taken of each and their places in the schedule."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", remove_benchmark),
    ("mix_sources", mix),
]

# Language ID learns from the documents, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
