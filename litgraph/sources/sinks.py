"""Sinks: vector table (S6 / V2), graph node and edge lists (S7), map
features (S8).  All write with Spark writers to shared storage; nothing is
collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(id, embedding array<float>, ...)`` as parquet (no index: the
    only read pattern is a full scan)."""
    vectors.write.mode(mode).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet",
               mode: str = "overwrite") -> None:
    """Node list under ``path/nodes``, edge list under ``path/edges``
    (parquet or JSON lines)."""
    nodes.write.mode(mode).format(fmt).save(f"{path}/nodes")
    edges.write.mode(mode).format(fmt).save(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    return (spark.read.format(fmt).load(f"{path}/nodes"),
            spark.read.format(fmt).load(f"{path}/edges"))


def place_features(places: DataFrame) -> DataFrame:
    """One GeoJSON point feature per place (``latitude, longitude, popup,
    n_authors`` from ``authors_by_location``) as a JSON text column."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col("longitude"), F.col("latitude")).alias("coordinates")).alias("geometry"),
        F.struct(F.col("popup"), F.col("n_authors")).alias("properties"),
    )
    return places.select(F.to_json(feature).alias("value"))


def save_place_features(places: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write features as JSON lines (one feature per line)."""
    place_features(places).write.mode(mode).text(path)


def save_results(results: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Keep the pipeline's tables between reruns: one parquet folder per
    table on shared storage (the reference keeps them in session memory)."""
    for name, df in results.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
