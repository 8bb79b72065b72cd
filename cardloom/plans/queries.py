"""The registered queries: one function of (spark, sf_dir) per operator group.

Doubles are rounded and arrays joined to text so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.card_tokens import card_tokens
from cardloom.functions.common import clean_strings, json_text
from cardloom.functions.rules_text import NormalizeOptions
from cardloom.functions.words import ngrams, word_tokens
from cardloom.operators import cluster_report as report
from cardloom.operators import clustering, joins, labelling, project, ranking, stats
from cardloom.operators.neighbors import (
    nearest_for_all,
    nearest_rows,
    nearest_to_one,
    show_neighbors,
)
from cardloom.operators.reduction import (
    SvdModel,
    fit_svd,
    ml_vectors,
    normalize_scores,
    project_rows,
    projection_2d,
)
from cardloom.operators.text_tables import (
    enriched_cards,
    oracle_tokens,
    type_features,
    with_normal_text,
)
from cardloom.operators.tfidf import (
    TfidfConfig,
    all_rows,
    fit_tfidf,
    fit_transform,
    long_rows,
    term_frequencies,
    tfidf_weights,
    vector_shape,
)
from cardloom.plans.build import (
    BuildConfig,
    build_all,
    build_text_tables,
    build_vectors,
    find_similar,
)
from cardloom.plans.demo_cards import demo_cards, demo_clusters, documents
from cardloom.session import scratch_path, stored
from cardloom.sources import ingest, tables

SEED = 42


def _joined(column: str, sep: str = "|") -> Column:
    return F.array_join(column, sep).alias(column)


def _places(column: str, places: int = 6) -> Column:
    return F.round(column, places).alias(column)


# Sources and sinks


def core_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = project.core_projection(demo_cards(spark, sf_dir))
    return core.select(
        "id",
        project.optional_column(core, "oracle_id"),
        "name",
        F.date_format("released_at", "yyyy-MM-dd").alias("released_at"),
        project.optional_column(core, "lang"),
        "layout",
        "type_line",
        "oracle_text",
        "rarity",
        "cmc",
        F.col("cmc").cast("int").alias("cmc_int"),
        "power",
    )


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards written as JSON arrays, 500 cards to a line, and scanned back."""
    path = scratch_path(spark, "cards-json")
    cards = demo_cards(spark, sf_dir).withColumn("_line", F.expr("bigint(substr(id, 2)) div 500"))
    lines = cards.groupBy("_line").agg(
        F.collect_list(F.struct(*[c for c in cards.columns if c != "_line"])).alias("cards")
    )
    lines.select(F.to_json("cards")).write.text(path)
    core = tables.read_cards(spark, path, whole_file=False)
    return core.select(
        "id", "name", F.date_format("released_at", "yyyy-MM-dd").alias("released_at"),
        "oracle_text", "cmc", "set_name",
    )


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "types")
    tables.write_table(type_features(demo_cards(spark, sf_dir)), path)
    return tables.read_table(spark, path).select(
        "id", _joined("basic_types"), F.size("type_faces").alias("faces")
    )


def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue made from the document sources, then its entry for one of them."""
    path = scratch_path(spark, "catalogue")
    entries = (
        documents(spark, sf_dir)
        .groupBy(F.col("source").alias("type"))
        .agg(F.count(F.lit(1)).alias("docs"), F.max("n_chars").alias("longest"))
        .select(
            "type",
            F.concat("type", F.lit("-"), F.col("docs").cast("string")).alias("name"),
            F.concat(F.lit("file:/landing/"), "type").alias("download_uri"),
            F.concat(F.lit("2026-01-02T03:04:"), (10 + F.col("longest") % 50).cast("string")).alias(
                "updated_at"
            ),
        )
    )
    # One entry per source; the catalogue is a single small object.
    entries.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("data")).write.json(path)
    return ingest.bulk_info(spark, path, "src7")


def ingest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the card dump landed and ingested, each twice; what the manifest says
    of them and how many cards they hold."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "versions")
    cards = demo_cards(spark, sf_dir).withColumn("_number", F.expr("bigint(substr(id, 2))"))
    counted = None
    for updated, landed in (("2026-01-02", cards.filter("_number % 3 <> 0")), ("2026-01-05", cards)):
        lines = landed.groupBy(F.expr("_number div 500")).agg(
            F.collect_list(F.struct(*[c for c in cards.columns if c != "_number"])).alias("cards")
        )
        lines.select(F.to_json("cards")).write.text(f"{landing}/cards_{updated.replace('-', '')}.json")
        catalogue = f"{landing}/catalogue-{updated}"
        entry = F.struct(F.lit("cards").alias("type"), F.lit(updated).alias("updated_at"))
        spark.range(1).select(F.array(entry).alias("data")).write.json(catalogue)
        for _ in range(2):
            target = ingest.ingest_bulk(spark, catalogue, "cards", landing, out, force=False, whole_file=False)
        version = tables.read_table(spark, target).agg(
            F.count(F.lit(1)).alias("cards"), F.countDistinct("name").alias("names")
        ).withColumn("updated_at", F.lit(updated))
        counted = version if counted is None else counted.unionByName(version)
    return ingest.manifest(spark, out).join(counted, "updated_at").select("updated_at", "saved_as", "cards", "names")


def missing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output a source, of its long documents: the sources that leave none."""
    root = scratch_path(spark, "by-source")
    docs = documents(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("none")))
    docs.filter("n_chars > 8000").write.partitionBy("source").parquet(root)
    # One name a source, a small dimension of the corpus.
    expected = [f"source={r.source}" for r in docs.select("source").distinct().collect()]
    return ingest.missing_outputs(spark, root, expected)


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.file_checksums(spark, sf_dir, "*.parquet")


def written_file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of one text file per nation, which lists its customers by name."""
    root = scratch_path(spark, "listings")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_name")
    files = customers.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name")
    files.write.partitionBy("c_nationkey").text(root)
    return ingest.file_checksums(spark, root, "*.txt").select("file_bytes", "sha256")


def validate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = demo_cards(spark, sf_dir)
    enriched = enriched_cards(cards)
    return ingest.table_quality(
        {
            "cards_core": cards,
            "type_features": type_features(cards),
            "oracle_tokens": oracle_tokens(cards),
            "cards_enriched": enriched,
            "oracle_clusters": demo_clusters(spark, sf_dir),
        },
        {
            "cards_core": ["id", "name"],
            "type_features": ["type_faces"],
            "oracle_tokens": ["oracle_tokens"],
            "cards_enriched": ["oracle_text_norm", "set_name"],
            "oracle_clusters": ["id", "cluster"],
        },
    )


def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write three of the expected tables and list the rest."""
    root = scratch_path(spark, "outputs")
    cards = demo_cards(spark, sf_dir)
    tables.write_table(cards, f"{root}/cards_core")
    tables.write_table(type_features(cards), f"{root}/type_features")
    tables.write_table(cards.select("id"), f"{root}/vectors/row_ids")
    return ingest.missing_outputs(spark, root)


# Text


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_normal_text(demo_cards(spark, sf_dir)).select("id", "oracle_text_norm")


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation of long real text; the language code stands for the name."""
    docs = documents(spark, sf_dir).select(
        "id", F.col("text").alias("oracle_text"), F.col("lang").alias("name")
    )
    return with_normal_text(docs).select("id", "oracle_text_norm")


def strip_reminder(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = NormalizeOptions(strip_reminder_text=True, replace_card_name=False)
    return with_normal_text(demo_cards(spark, sf_dir), options).select("id", "oracle_text_norm")


def card_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oracle_tokens(demo_cards(spark, sf_dir)).select(
        "id", F.size("oracle_tokens").alias("n_tokens"), _joined("oracle_tokens", "¦")
    )


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card tokeniser on long real text."""
    tokens = documents(spark, sf_dir).select("id", card_tokens(F.col("text")).alias("tokens"))
    return tokens.select(
        "id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "¦")).alias("digest")
    )


def type_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_features(demo_cards(spark, sf_dir)).select(
        "id", "oracle_id", "name", "type_line",
        _joined("basic_types"), _joined("super_types"), _joined("sub_types"),
    )


def type_face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = type_features(demo_cards(spark, sf_dir)).select(
        "id", F.posexplode_outer("type_faces").alias("face", "f")
    )
    return faces.filter(F.col("f").isNotNull()).select(
        "id", "face", "f.raw_face_type_line",
        *[
            F.array_join(F.col(f"f.{c}"), "|").alias(c)
            for c in ("basic_types", "super_types", "sub_types")
        ],
    )


def type_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.item_counts(type_features(demo_cards(spark, sf_dir)), "basic_types", "basic_type")


def word_gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and grams per document."""
    words = documents(spark, sf_dir).select("id", word_tokens(F.col("text")).alias("words"))
    return words.select(
        "id",
        F.size("words").alias("n_words"),
        F.size(ngrams(F.col("words"))).alias("n_grams"),
        F.md5(F.array_join(ngrams(F.col("words"), 2, 3), "¦")).alias("digest"),
    )


# Joins


def enriched_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards joined to type arrays, tokens and clusters by id."""
    cards, typed, tokens, clusters = joins.dealt(
        with_normal_text(demo_cards(spark, sf_dir)),
        type_features(demo_cards(spark, sf_dir)),
        oracle_tokens(demo_cards(spark, sf_dir)),
        demo_clusters(spark, sf_dir),
    )
    full = joins.left_join(cards, typed, ["basic_types", "super_types", "sub_types"])
    full = joins.left_join(full, tokens, ["oracle_tokens"])
    full = joins.join_clusters(full, clusters)
    return full.select(
        "id", "oracle_text_norm", _joined("basic_types"), _joined("super_types"),
        _joined("sub_types"), F.size("oracle_tokens").alias("n_tokens"), "cluster",
    )


def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = enriched_cards(demo_cards(spark, sf_dir))
    types = type_features(demo_cards(spark, sf_dir))
    both = joins.left_join_suffixed(
        cards, types, ["basic_types", "sub_types", "type_faces"], "_type_features"
    )
    return both.select(
        "id", _joined("basic_types"), _joined("basic_types_type_features"),
        _joined("sub_types_type_features"), F.size("type_faces").alias("faces"),
    )


def optional_cluster_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches: with a cluster table and without one."""
    cards = demo_cards(spark, sf_dir).select("id", "name")
    absent = joins.join_clusters(cards, None).withColumnRenamed("cluster", "no_cluster")
    return joins.join_clusters(absent, demo_clusters(spark, sf_dir))


def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = demo_cards(spark, sf_dir).select("id")
    return joins.lookup_with_default(cards, demo_clusters(spark, sf_dir), "cluster", -1)


def row_alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", "lang")
    row_map = ranking.with_row_index(docs.select("id"), "id", name="matrix_row")
    return joins.aligned_join(docs, row_map).select("matrix_row", "id", "lang")


# Labels


def card_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = enriched_cards(demo_cards(spark, sf_dir))
    labels = labelling.card_labels(cards, demo_clusters(spark, sf_dir), as_json=True)
    return labels.withColumn("labels", F.array_join("labels", "|"))


def labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.labels_long(enriched_cards(demo_cards(spark, sf_dir)))


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on long real text, each document taken for a creature's."""
    docs = documents(spark, sf_dir).select(
        "id",
        F.col("text").alias("oracle_text"),
        F.array(F.lit("Creature")).alias("basic_types"),
    )
    labels = labelling.card_labels(docs)
    return labels.select("id", "primary_label", F.array_join("labels", "|").alias("labels"))


def best_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of raw and of normalised text, the better match of each kept. Confidences of
    the raw text are moved up, down or left equal, so that either side wins and ties occur."""
    cards = enriched_cards(demo_cards(spark, sf_dir))
    moved = F.element_at(F.array(*[F.lit(x) for x in (0.02, -0.02, 0.0)]), F.length("label") % 3 + 1)
    raw = labelling.labels_long(cards.drop("oracle_text_norm")).withColumns(
        {"confidence": F.round(F.col("confidence") + moved, 2), "source": F.lit("raw")}
    )
    normal = labelling.labels_long(cards).withColumn("source", F.lit("normalised"))
    return labelling.best_match_per_label(raw, normal)


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = demo_clusters(spark, sf_dir)
    labels = labelling.card_labels(enriched_cards(demo_cards(spark, sf_dir)), clusters)
    return labelling.label_summary(labels, clusters).withColumn(
        "review_share", F.round("review_share", 6)
    )


def primary_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labelling.card_labels(enriched_cards(demo_cards(spark, sf_dir)))
    return labelling.primary_label_counts(labels)


def taxonomy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = labelling.labels_long(enriched_cards(demo_cards(spark, sf_dir)))
    return (
        labelling.with_taxonomy(long)
        .groupBy("category", "label", "description")
        .agg(F.count(F.lit(1)).alias("cards"))
    )


# Filters, counts, samples


def filter_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = with_normal_text(demo_cards(spark, sf_dir))
    return project.where_equal(cards, "name", "blue bolt").select("id", "name", "oracle_text_norm")


def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = type_features(demo_cards(spark, sf_dir))
    return project.where_in(cards, "name", ["red rod", "hot gizmo", "no such card"]).select(
        "id", "name", "type_line", _joined("basic_types")
    )


def filter_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = with_normal_text(demo_cards(spark, sf_dir))
    member = joins.join_clusters(cards, demo_clusters(spark, sf_dir))
    known = project.drop_nulls(member, "cluster")
    filled = project.fill_text(known, "name", "type_line")
    return project.where_equal(filled, "cluster", 3).select("id", "name", "type_line")


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.first_match(demo_cards(spark, sf_dir), "OLD Anvil").select("id", "name")


def null_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = joins.join_clusters(demo_cards(spark, sf_dir), demo_clusters(spark, sf_dir))
    return stats.null_share(cards, 6).withColumn("null_share", F.round("null_share", 6))


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.key_uniqueness(demo_cards(spark, sf_dir), "oracle_id")


def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_count(demo_clusters(spark, sf_dir), "cluster")


def cmc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.whole_number_histogram(demo_cards(spark, sf_dir), "cmc")


def cmc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_range(cmc_histogram(spark, sf_dir), "value")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(demo_cards(spark, sf_dir), "layout")


def cluster_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(demo_clusters(spark, sf_dir), "cluster", 20)


def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = stats.size_summary(demo_clusters(spark, sf_dir), "cluster")
    return summary.select(
        "count", _places("mean"), _places("std"), "min", _places("q25"), _places("q50"),
        _places("q75"), "max",
    )


def size_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_rank(demo_clusters(spark, sf_dir), "cluster")


def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shape(enriched_cards(demo_cards(spark, sf_dir)))


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = type_features(demo_cards(spark, sf_dir))
    return ranking.head(cards, 5, "name", "id").select("id", "name", _joined("sub_types"))


def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tail(documents(spark, sf_dir), 20, "id").select("id", "lang", "n_chars")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.seeded_sample(documents(spark, sf_dir).select("id", "lang"), 50, SEED)


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped_sample(demo_cards(spark, sf_dir).select("id", "name"), 500, SEED)


# TF-IDF


def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_tfidf(documents(spark, sf_dir))
    return model.vocabulary.select("term", "term_idx", "df", "corpus_tf", _places("idf"))


def capped_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary cut to its 5,000 most frequent terms."""
    config = TfidfConfig(min_df=2, max_features=5_000, ngram_range=(1, 1))
    model = fit_tfidf(documents(spark, sf_dir), config)
    return model.vocabulary.select("term", "term_idx", "df", "corpus_tf")


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(documents(spark, sf_dir))


def tfidf_weight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    _, weights = fit_transform(docs, keep=False)
    return weights.select("id", "term", "term_idx", _places("weight"))


def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New text (the benchmark items) under the documents' vocabulary."""
    model = fit_tfidf(documents(spark, sf_dir))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    weights = tfidf_weights(items, model, key="item_id")
    return weights.select("id", "term", _places("weight"))


def tfidf_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return vector_shape(docs, fit_tfidf(docs))


def saved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector artifacts written, read back, and assembled to one row per document."""
    docs = documents(spark, sf_dir)
    model, weights = fit_transform(docs, keep=False)
    path = scratch_path(spark, "artifacts")
    tables.save_vectors(model, weights, docs, path)
    _, weights, ids = tables.load_vectors(spark, path)
    rows = all_rows(ids, weights)
    squares = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w * w)
    return rows.select(
        "id",
        F.size("indices").alias("n_terms"),
        F.round(squares, 6).alias("squared_length"),
        F.md5(F.array_join("indices", ",")).alias("digest"),
    )


# Similarity


def similar_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents most similar to the first one of a source."""
    docs = documents(spark, sf_dir)
    _, rows = fit_transform(docs, packed=True)
    query = project.first_match(docs, "SRC7", "source").first()["id"]
    near = nearest_to_one(long_rows(rows), docs, query, 10)
    return show_neighbors(near, docs, "lang", "source")


def similar_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a card by name; template texts make many exact ties."""
    cards = with_normal_text(demo_cards(spark, sf_dir))
    _, weights = fit_transform(cards, text="oracle_text_norm")
    query = project.first_match(cards, "Blue Rod").first()["id"]
    near = nearest_to_one(weights, cards, query, 10)
    return show_neighbors(near, cards, "name", "type_line")


def similar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest documents of every benchmark item."""
    docs = documents(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "id")
    model, rows = fit_transform(docs, packed=True)
    queries = all_rows(items, tfidf_weights(items, model))
    return nearest_rows(all_rows(docs, rows), queries, 5)


def similar_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest documents of every document."""
    docs = documents(spark, sf_dir)
    _, rows = fit_transform(docs, packed=True)
    return nearest_for_all(rows, docs, 10)


# Clusters


def _clustered_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = enriched_cards(demo_cards(spark, sf_dir))
    return joins.join_clusters(cards, demo_clusters(spark, sf_dir))


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scores = rows.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("scores")
    )
    return scores, rows.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.cluster_stats(_clustered_cards(spark, sf_dir))
    return found.select("cluster", "cluster_size", _places("avg_cmc"), _places("median_cmc")).orderBy(
        F.desc("cluster_size"), "cluster"
    )


def cluster_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_items(_clustered_cards(spark, sf_dir), "sub_types", 12)


def cluster_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top terms by language, the language standing for the cluster."""
    docs = documents(spark, sf_dir)
    model, rows = fit_transform(docs, packed=True)
    clusters = docs.select("id", F.col("lang").alias("cluster"))
    best = report.top_terms(rows, clusters, vocabulary=model.vocabulary)
    return best.withColumn("weight", F.round("weight", 6))


def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = report.centroids(*_embeddings(spark, sf_dir))
    return centers.select("cluster", F.posexplode("centroid").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = report.representatives(*_embeddings(spark, sf_dir))
    return best.select("cluster", "representative_rank", "id", _places("centroid_distance"))


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows scaled to unit length."""
    scores, _ = _embeddings(spark, sf_dir)
    exploded = normalize_scores(scores).select("id", F.posexplode("scores").alias("dim", "value"))
    return exploded.withColumn("value", F.round("value", 6))


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = _embeddings(spark, sf_dir)
    features = clustering.unit_vectors(scores)
    config = clustering.ClusterConfig(n_clusters=10, n_init=3)
    model, _ = clustering.fit_kmeans(features, config)
    return clustering.assign_clusters(features, model)


def kmeans_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every embedding row was assigned to a centre that is nearest to it."""
    scores, _ = _embeddings(spark, sf_dir)
    features = clustering.unit_vectors(scores)
    config = clustering.ClusterConfig(n_clusters=10, n_init=3)
    model, _ = clustering.fit_kmeans(features, config)
    centers = F.array(*[F.array(*map(F.lit, c.tolist())) for c in model.clusterCenters()])
    gaps = F.transform(
        centers,
        lambda c: F.aggregate(
            F.zip_with(c, "row", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x
        ),
    )
    rows = normalize_scores(scores).select("id", F.col("scores").alias("row"))
    return (
        clustering.assign_clusters(features, model)
        .join(rows, "id")
        .withColumn("gaps", gaps)
        .select("id", (F.get("gaps", "cluster") <= F.array_min("gaps") + 1e-9).alias("nearest"))
    )


def _whole_svd(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SvdModel]:
    """The embedding rows in sparse form and their decomposition in all dimensions."""
    scores, _ = _embeddings(spark, sf_dir)
    rows = stored(
        scores.select(
            "id",
            F.sequence(F.lit(0), F.size("scores") - 1).alias("indices"),
            F.col("scores").cast("array<double>").alias("weights"),
        ),
        "rows",
    )
    width = rows.agg(F.max(F.size("weights"))).first()[0]
    return rows, fit_svd(ml_vectors(rows, width), width)


def svd_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of the embedding rows after a full-rank SVD, which keeps them."""
    projected = project_rows(*_whole_svd(spark, sf_dir))
    squares = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + x * x)
    return projected.select("id", F.round(squares, 6).alias("squared_length"))


def svd_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of the embedding dimensions, put together again from singular values
    and vectors: right only if the vectors are the singular ones."""
    _, model = _whole_svd(spark, sf_dir)
    squares = F.array(*[F.lit(float(v * v)) for v in model.singular_values])
    entries = model.components.select("term_idx", F.posexplode("components").alias("component", "value"))
    left = entries.select(F.col("term_idx").alias("i"), "component", (F.col("value") * F.get(squares, "component")).alias("scaled"))
    right = entries.select(F.col("term_idx").alias("j"), "component", "value")
    return (
        left.join(right, "component").groupBy("i", "j")
        .agg(F.sum(F.col("scaled") * F.col("value")).alias("value"))
        .select("i", "j", (F.round("value", 4) + 0.0).alias("value"))
    )


def svd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of powers of the singular values, as shares of the largest such sum that the
    rows' lengths allow."""
    _, model = _whole_svd(spark, sf_dir)
    squares = model.singular_values**2
    sums = [(p, float((squares ** p).sum() / squares.sum() ** p)) for p in (2, 3)]
    return spark.createDataFrame(sums, "power int, share double").withColumn("share", F.round("share", 8))


def svd_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, rows = fit_transform(docs, packed=True)
    rows = stored(all_rows(docs, rows), "rows")
    return fit_svd(ml_vectors(rows, model.n_terms), 8).scores


def projection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, rows = fit_transform(docs, packed=True)
    rows = stored(all_rows(docs, rows), "rows")
    scores = fit_svd(ml_vectors(rows, model.n_terms), 2).scores
    clusters = docs.select("id", (F.xxhash64("source") % 5).cast("int").alias("cluster"))
    return projection_2d(scores, clusters)


_SMALL = BuildConfig(clusters=clustering.ClusterConfig(n_clusters=12, n_components=16, n_init=2))


def full_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole build over the cards, lists as JSON text."""
    out = scratch_path(spark, "build")
    build_all(demo_cards(spark, sf_dir), out, _SMALL)
    built = tables.read_table(spark, f"{out}/cluster_report")
    lists = [f.name for f in built.schema if f.dataType.typeName() == "array"]
    return built.withColumns({c: json_text(F.col(c)) for c in lists})


def similar_in_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar cards looked up by name in stored tables."""
    out = scratch_path(spark, "build")
    build_text_tables(demo_cards(spark, sf_dir), out)
    build_vectors(spark, out)
    return find_similar(spark, out, "hot gizmo")


def clean_string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null items dropped from a list column, and the list as JSON text."""
    cards = demo_cards(spark, sf_dir)
    raw = F.array("name", "type_line", F.col("cmc").cast("string"))
    return cards.select("id", json_text(clean_strings(raw)).alias("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "core_projection": core_projection,
    "json_scan": json_scan,
    "parquet_round_trip": parquet_round_trip,
    "manifest_lookup": manifest_lookup,
    "ingest_versions": ingest_versions,
    "missing_by_source": missing_by_source,
    "file_checksums": file_checksums,
    "written_file_checksums": written_file_checksums,
    "validate_outputs": validate_outputs,
    "missing_outputs": missing_outputs,
    "normalize_text": normalize_text,
    "normalize_documents": normalize_documents,
    "strip_reminder": strip_reminder,
    "card_tokens": card_token_lists,
    "document_tokens": document_tokens,
    "type_features": type_feature_rows,
    "type_faces": type_face_rows,
    "type_frequency": type_frequency,
    "word_grams": word_gram_counts,
    "enriched_join": enriched_join,
    "suffix_join": suffix_join,
    "optional_cluster_join": optional_cluster_join,
    "lookup_default": lookup_default,
    "row_alignment_check": row_alignment_check,
    "card_labels": card_label_rows,
    "labels_long": labels_long,
    "document_labels": document_labels,
    "best_label_match": best_label_match,
    "label_summary": label_summary,
    "primary_label_counts": primary_label_counts,
    "taxonomy_join": taxonomy_join,
    "filter_by_name": filter_by_name,
    "filter_in": filter_in,
    "filter_cluster": filter_cluster,
    "first_match": first_match,
    "null_share": null_share,
    "key_uniqueness": key_uniqueness,
    "distinct_count": distinct_count,
    "cmc_histogram": cmc_histogram,
    "cmc_range": cmc_range,
    "value_counts": value_counts,
    "cluster_value_counts": cluster_value_counts,
    "size_summary": size_summary,
    "size_rank": size_rank,
    "shape": shape,
    "head_rows": head_rows,
    "tail_rows": tail_rows,
    "seeded_sample": seeded_sample,
    "capped_sample": capped_sample,
    "clean_strings": clean_string_lists,
    "tfidf_vocabulary": tfidf_vocabulary,
    "capped_vocabulary": capped_vocabulary,
    "term_frequencies": term_frequency,
    "tfidf_weights": tfidf_weight_rows,
    "tfidf_transform": tfidf_transform,
    "tfidf_shape": tfidf_shape,
    "saved_vectors": saved_vectors,
    "similar_to_doc": similar_to_doc,
    "similar_cards": similar_cards,
    "similar_batch": similar_batch,
    "similar_all_pairs": similar_all_pairs,
    "cluster_stats": cluster_stats,
    "cluster_top_items": cluster_top_items,
    "cluster_top_terms": cluster_top_terms,
    "cluster_centroids": cluster_centroids,
    "cluster_representatives": cluster_representatives,
    "unit_rows": unit_rows,
    "kmeans_clusters": kmeans_clusters,
    "kmeans_nearest": kmeans_nearest,
    "svd_lengths": svd_lengths,
    "svd_gram": svd_gram,
    "svd_values": svd_values,
    "svd_project": svd_project,
    "projection_2d": projection_points,
    "cluster_report": full_cluster_report,
    "find_similar": similar_in_build,
}
