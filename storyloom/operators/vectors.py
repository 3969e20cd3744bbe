"""Vector search by Euclidean distance: inverted cells, recall and registry checks; joins are in vector_join."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.vector_join import knn, knn_cells, pairs_compared, probes_for, visits  # noqa: F401

CELLS = 100


# -- inverted cells ------------------------------------------------------------


def fit_cells(base: DataFrame, cells: int = CELLS, seed: int = 7, iterations: int = 10) -> KMeansModel:
    features = base.select(array_to_vector("vector").alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=iterations, initMode="random").fit(features)


def assign_cells(base: DataFrame, model: KMeansModel) -> DataFrame:
    """Adds ``cell``; stored partitioned by it, a search reads only probed cells."""
    out = model.setPredictionCol("cell").transform(base.withColumn("features", array_to_vector("vector")))
    return out.drop("features")


def write_cells(celled: DataFrame, path: str, splits: int = 32) -> None:
    """Store by cell; a cell that holds a large share of the rows has several writers."""
    split = F.pmod(F.xxhash64("id"), F.lit(splits))
    celled.repartition("cell", split).write.mode("overwrite").partitionBy("cell").parquet(path)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found: ``query_id, recall``."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )


# -- registry ------------------------------------------------------------------


def _dimensions(embedding: DataFrame, models: DataFrame) -> DataFrame:
    """``article_id, model_key, size, dimensions``."""
    sized = embedding.select("article_id", "model_key", F.size("vector").alias("size"))
    return sized.join(models.select(F.col("key").alias("model_key"), "dimensions"), "model_key", "left")


def embedding_check(embedding: DataFrame, models: DataFrame) -> DataFrame:
    """Vectors of unknown models or wrong length, and repeated (article, model) pairs."""
    problem = F.when(F.col("dimensions").isNull(), "unknown_model").when(F.col("size") != F.col("dimensions"), "wrong_size")
    sizes = (
        _dimensions(embedding, models)
        .select("article_id", "model_key", problem.alias("problem"))
        .where("problem is not null")
    )
    repeated = (
        embedding.groupBy("article_id", "model_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("article_id", "model_key", F.lit("repeated").alias("problem"))
    )
    return sizes.unionByName(repeated)


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Mean vector per label: ``query_id, vector``; sums combine on the map side."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("vector")))
    return vectors.groupBy(F.col(label).alias("query_id")).agg(mean.alias("vector"))
