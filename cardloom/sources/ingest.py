"""Landed bulk files: catalogue lookup, versions, manifest, checksums, output checks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators.project import MissingInput
from cardloom.sources import checksums
from cardloom.sources.tables import path_exists, read_cards, require_path

CATALOGUE_SCHEMA = (
    "data array<struct<type:string,name:string,download_uri:string,updated_at:string>>"
)
MANIFEST_SCHEMA = (
    "bulk_type string, name string, download_uri string, updated_at string, saved_as string, commit string"
)

# Files up to this size are hashed as one row, longer ones split by split.
WHOLE_BYTES = 64 * 1024 * 1024

# The tables and artifacts a full build leaves behind.
EXPECTED_OUTPUTS = (
    "cards_core",
    "cards_enriched",
    "type_features",
    "oracle_tokens",
    "oracle_clusters",
    "cluster_report",
    "cluster_representatives",
    "card_labels",
    "vectors/vocabulary",
    "vectors/weights",
    "vectors/row_ids",
    "models/svd",
    "models/kmeans",
)


def version_stamp(updated_at: Column) -> Column:
    """The update time without ``:`` and ``-``, for use in a file name."""
    return F.translate(updated_at, ":-", "")


def bulk_info(spark: SparkSession, catalogue: str, bulk_type: str) -> DataFrame:
    """The first catalogue entry of a type, with its file name; an error if none."""
    require_path(spark, catalogue)
    listed = spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(catalogue)
    entry = (
        listed.select(F.posexplode("data").alias("pos", "e"))
        .filter(F.col("e.type") == F.lit(bulk_type))
        .orderBy("pos")
        .limit(1)
    )
    updated = F.coalesce("e.updated_at", F.lit(""))
    info = entry.select(
        F.col("e.type").alias("bulk_type"),
        F.coalesce("e.name", "e.type").alias("name"),
        F.col("e.download_uri").alias("download_uri"),
        updated.alias("updated_at"),
        F.concat("e.type", F.lit("_"), version_stamp(updated), F.lit(".json")).alias("saved_as"),
    )
    if info.isEmpty():
        raise MissingInput(f"no bulk entry of type '{bulk_type}' in {catalogue}")
    return info


def ingest_bulk(
    spark: SparkSession,
    catalogue: str,
    bulk_type: str,
    landing: str,
    out: str,
    force: bool = True,
    whole_file: bool = True,
) -> str:
    """Turn the landed file of the catalogue's current version into a core table.

    Returns the version's path. An existing version is kept unless ``force`` is set;
    a written version gets one row in the manifest beside the data.

    A version is written aside, with the row that the manifest shall have, and moved into
    place whole. The manifest row is added from there, once per commit: a run that died
    between the two is completed by the next one, and replays add nothing. What died while
    writing is never seen as a version; a version that was being replaced is written anew.
    """
    info = bulk_info(spark, catalogue, bulk_type)
    saved_as = info.first()["saved_as"]
    target = f"{out}/{saved_as.removesuffix('.json')}"
    if force or not path_exists(spark, f"{target}/_SUCCESS"):
        _write_version(spark, read_cards(spark, f"{landing}/{saved_as}", whole_file), info, out, target)
    _enter_in_manifest(spark, out, target)
    return target


def _write_version(spark: SparkSession, cards: DataFrame, info: DataFrame, out: str, target: str) -> None:
    commit = uuid.uuid4().hex
    staged = f"{out}/_staging/{commit}"
    cards.write.parquet(staged)
    # Readers of the table skip names that begin with an underscore.
    info.withColumn("commit", F.lit(commit)).write.json(f"{staged}/_commit")
    move = spark._jvm.org.apache.hadoop.fs.Path
    fs = move(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(move(target), True)
    if not fs.rename(move(staged), move(target)):
        raise OSError(f"could not move {staged} to {target}")


def _enter_in_manifest(spark: SparkSession, out: str, target: str) -> None:
    if not path_exists(spark, f"{target}/_commit"):
        return  # written before versions carried their row
    row = spark.read.schema(MANIFEST_SCHEMA).json(f"{target}/_commit")
    if path_exists(spark, f"{out}/manifest"):
        row = row.join(manifest(spark, out).select("commit"), "commit", "left_anti")
    if not row.isEmpty():
        row.write.mode("append").json(f"{out}/manifest")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The versions below ``out``, one row for each commit."""
    return spark.read.schema(MANIFEST_SCHEMA).json(require_path(spark, f"{out}/manifest"))


def file_checksums(
    spark: SparkSession, path: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """SHA-256 and size per file, one file per row.

    Files of up to ``whole_bytes`` are rows of ``binaryFile``. Longer ones are read split by split
    (``checksums.chained_sha256``) when this is called; without OpenSSL, or with a name by which line
    readers unpack a file, they are rows too, and limited to 2 GB.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(require_path(spark, path))
    )
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    hashed = [name, F.col("length").alias("file_bytes"), F.sha2("content", 256).alias("sha256")]
    # Names and lengths come from the listing; filters on length keep contents from being read.
    long = files.filter(F.col("length") > whole_bytes).select("path", "length", name).collect()
    split = [f for f in long if checksums.openssl() and not checksums.is_compressed(spark, f.path)]
    out = files.filter(F.col("length") <= whole_bytes).select(*hashed)
    if len(split) < len(long):
        whole = [checksums.literal_path(f.path) for f in long if f not in split]
        out = out.unionByName(spark.read.format("binaryFile").load(whole).select(*hashed))
    digests = checksums.chained_sha256(spark, [(f.path, f.length) for f in split]) if split else []
    # A scan plans no split for an empty file, so those come from the listing.
    listed = [(f.file_name, f.length, digest) for f, digest in zip(split, digests, strict=True)] + [
        (empty, 0, hashlib.sha256(b"").hexdigest()) for empty in _empty_files(spark, path, pattern)
    ]
    return out.unionByName(spark.createDataFrame(listed, "file_name string, file_bytes long, sha256 string"))


def _empty_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    glob = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.globStatus(glob) or []
    return [s.getPath().getName() for s in listed if s.isFile() and s.getLen() == 0]


def missing_outputs(
    spark: SparkSession, root: str, expected: Sequence[str] = EXPECTED_OUTPUTS
) -> DataFrame:
    """Expected outputs without a file below ``root``. Contents are not read."""
    wanted = spark.createDataFrame([(e,) for e in expected], "output string")
    if not path_exists(spark, root):
        return wanted
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    )
    steps = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    # An output is named by its first one or two path steps.
    prefixes = F.array(steps[0], F.array_join(F.slice(steps, 1, 2), "/"))
    there = files.select(F.explode(prefixes).alias("output")).distinct()
    return wanted.join(there, "output", "left_anti").orderBy("output")


def require_outputs(
    spark: SparkSession, root: str, expected: Sequence[str] = EXPECTED_OUTPUTS
) -> None:
    missing = [r["output"] for r in missing_outputs(spark, root, expected).collect()]
    if missing:
        raise MissingInput(f"expected outputs are missing: {', '.join(missing)}")


def table_quality(tables: Mapping[str, DataFrame], needed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per table: row count and whether it has every needed column and any row."""
    checks = []
    for name, df in tables.items():
        has = set(needed.get(name, ())) <= set(df.columns)
        checks.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(has).alias("has_columns"),
                (F.lit(has) & (F.col("row_count") > 0)).alias("is_valid"),
            )
        )
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out
