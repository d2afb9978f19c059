"""Kept results with versions (S9): what is read is always one whole write.

``publish`` writes the tables of a version into a folder of their own and then
appends their places to a manifest, as one small file: readers see the version
from that moment on, and all of it.  A write that fails before leaves only a
folder that nothing points to.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.session import released_shuffles

MANIFEST = "version long, name string, folder string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    empty = spark.createDataFrame([], MANIFEST)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if found else empty


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 where there is none."""
    return _manifest(spark, path).agg(F.max("version")).first()[0] or 0


def publish(spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], path: str) -> int:
    """Write the tables as the next version and return its number.  A table may
    be a function of those before it, as they are written."""
    version = current_version(spark, path) + 1
    folder = f"{path}/data/{version}-{uuid.uuid4().hex}"
    written: dict[str, DataFrame] = {}
    for name, table in tables.items():
        df = table(written) if callable(table) else table
        with released_shuffles(spark):
            df.write.parquet(f"{folder}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    rows = [(version, name, f"{folder}/{name}") for name in tables]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load_version(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the newest."""
    version = current_version(spark, path) if version is None else version
    found = _manifest(spark, path).where(F.col("version") == version).collect()  # a row a table
    if not found:
        raise ValueError(f"no version {version} at {path}")
    return {r["name"]: spark.read.parquet(r["folder"]) for r in found}
