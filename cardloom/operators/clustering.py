"""KMeans with several starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


@dataclass(frozen=True)
class ClusterConfig:
    # The defaults of the workload.
    n_clusters: int = 200
    n_components: int = 256
    random_state: int = 42
    n_init: int = 10


def unit_vectors(scores: DataFrame, column: str = "scores") -> DataFrame:
    """``(id, features)`` with rows of unit length."""
    dense = scores.select("id", array_to_vector(F.col(column).cast("array<double>")).alias("raw"))
    return Normalizer(p=2.0, inputCol="raw", outputCol="features").transform(dense).drop("raw")


def fit_kmeans(
    features: DataFrame, config: ClusterConfig = ClusterConfig()
) -> tuple[KMeansModel, float]:
    """The model of lowest training cost over ``n_init`` seeds, and that cost."""
    held = features.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    best: tuple[KMeansModel, float] | None = None
    for start in range(config.n_init):
        model = KMeans(k=config.n_clusters, seed=config.random_state + start).fit(held)
        cost = model.summary.trainingCost
        if best is None or cost < best[1]:
            best = (model, cost)
    held.unpersist()
    return best


def assign_clusters(features: DataFrame, model: KMeansModel) -> DataFrame:
    return model.transform(features).select("id", F.col("prediction").cast("int").alias("cluster"))


def save_kmeans(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_kmeans(path: str) -> KMeansModel:
    return KMeansModel.load(path)
