"""The batch build: core table to labels, one lazy DataFrame per stage, written once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.rules_text import NormalizeOptions
from cardloom.operators.cluster_report import cluster_report, cluster_representatives
from cardloom.operators.clustering import (
    ClusterConfig,
    assign_clusters,
    fit_kmeans,
    save_kmeans,
    unit_vectors,
)
from cardloom.operators.joins import evened
from cardloom.operators.labelling import card_labels
from cardloom.operators.neighbors import nearest_to_one, show_neighbors
from cardloom.operators.project import core_projection, first_match, require_columns
from cardloom.operators.reduction import (
    fit_svd,
    ml_vectors,
    normalize_scores,
    save_svd,
)
from cardloom.operators.text_tables import enriched_cards, oracle_tokens, type_features
from cardloom.operators.tfidf import TfidfConfig, all_rows, fit_tfidf, tfidf_weights
from cardloom.session import stored
from cardloom.sources.ingest import require_outputs
from cardloom.sources.tables import (
    load_postings,
    load_vectors,
    read_table,
    save_postings,
    save_vectors,
    write_table,
)


@dataclass(frozen=True)
class BuildConfig:
    tfidf: TfidfConfig = field(default_factory=TfidfConfig)
    clusters: ClusterConfig = field(default_factory=ClusterConfig)
    normalize: NormalizeOptions = field(default_factory=NormalizeOptions)
    # Space in which representatives are measured: "svd" or "normalized".
    space: str = "svd"


def build_text_tables(core: DataFrame, out: str, config: BuildConfig = BuildConfig()) -> None:
    core = core_projection(require_columns(core, ["id", "name", "type_line", "oracle_text"]))
    write_table(evened(core), f"{out}/cards_core")
    core = read_table(core.sparkSession, f"{out}/cards_core")
    write_table(type_features(core), f"{out}/type_features")
    write_table(oracle_tokens(core, config.normalize), f"{out}/oracle_tokens")
    write_table(enriched_cards(core, config.normalize), f"{out}/cards_enriched")


def build_vectors(spark: SparkSession, out: str, config: BuildConfig = BuildConfig()) -> None:
    cards = require_columns(read_table(spark, f"{out}/cards_enriched"), ["oracle_text_norm"])
    model = fit_tfidf(cards, config.tfidf, "oracle_text_norm")
    save_vectors(model, tfidf_weights(cards, model, "oracle_text_norm"), cards, f"{out}/vectors")
    save_postings(read_table(spark, f"{out}/vectors/weights"), f"{out}/vectors/postings")


def build_clusters(spark: SparkSession, out: str, config: BuildConfig = BuildConfig()) -> None:
    model, weights, ids = load_vectors(spark, f"{out}/vectors", config.tfidf)
    rows = stored(all_rows(ids, weights), "rows")
    svd = fit_svd(ml_vectors(rows, model.n_terms), config.clusters.n_components)
    save_svd(svd, spark, f"{out}/models/svd")
    write_table(svd.scores, f"{out}/vectors/scores")
    scores = read_table(spark, f"{out}/vectors/scores")
    features = unit_vectors(scores)
    kmeans, _ = fit_kmeans(features, config.clusters)
    save_kmeans(kmeans, f"{out}/models/kmeans")
    write_table(assign_clusters(features, kmeans), f"{out}/oracle_clusters")


def build_report(spark: SparkSession, out: str, config: BuildConfig = BuildConfig()) -> None:
    cards = read_table(spark, f"{out}/cards_enriched")
    clusters = read_table(spark, f"{out}/oracle_clusters")
    weights = read_table(spark, f"{out}/vectors/weights")
    scores = read_table(spark, f"{out}/vectors/scores")
    if config.space == "normalized":
        scores = normalize_scores(scores)
    write_table(
        cluster_representatives(cards, scores, clusters), f"{out}/cluster_representatives"
    )
    reps = read_table(spark, f"{out}/cluster_representatives")
    write_table(cluster_report(cards, clusters, weights, reps), f"{out}/cluster_report")


def build_labels(spark: SparkSession, out: str, clusters: bool = True) -> None:
    cards = read_table(spark, f"{out}/cards_enriched")
    found = read_table(spark, f"{out}/oracle_clusters") if clusters else None
    write_table(card_labels(cards, found), f"{out}/card_labels")


def build_all(core: DataFrame, out: str, config: BuildConfig = BuildConfig()) -> None:
    """All stages in order, then a check that every expected output is there."""
    spark = core.sparkSession
    build_text_tables(core, out, config)
    build_vectors(spark, out, config)
    build_clusters(spark, out, config)
    build_report(spark, out, config)
    build_labels(spark, out)
    require_outputs(spark, out)


def find_similar(spark: SparkSession, out: str, name: str, k: int = 10) -> DataFrame:
    """Cards most similar to the first card of that name: score, name, type line."""
    cards = read_table(spark, f"{out}/cards_enriched")
    _, weights, ids = load_vectors(spark, f"{out}/vectors")
    query = first_match(cards, name).first()["id"]
    near = nearest_to_one(
        weights, ids, query, k, postings=lambda terms: load_postings(spark, f"{out}/vectors/postings", terms)
    )
    return show_neighbors(near, cards, "name", "type_line").select(
        "id", "score", "rank", "name", "type_line"
    )
