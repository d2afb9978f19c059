"""Versions of kept results: whole or not at all; a refresh equals a rebuild."""

import pytest
from pyspark.sql import functions as F

from litgraph.operators.authors import records_by_id
from litgraph.plans import fixtures as fx
from litgraph.plans import pipeline as P
from litgraph.session import scratch_path
from litgraph.sources import versions
from tests.conftest import SF_SMALL


def test_a_failed_write_leaves_the_old_version(spark):
    path = scratch_path(spark, "kept")
    assert versions.current_version(spark, path) == 0
    with pytest.raises(ValueError):
        versions.load_version(spark, path)
    assert versions.publish(spark, {"a": spark.range(3), "b": spark.range(1)}, path) == 1
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.publish(spark, {"a": spark.range(9), "b": broken}, path)
    assert versions.current_version(spark, path) == 1
    assert versions.load_version(spark, path)["a"].count() == 3
    # a table may be made of the version it replaces
    old = versions.load_version(spark, path)
    assert versions.publish(spark, {"a": old["a"].union(spark.range(4)), "b": old["b"]}, path) == 2
    assert versions.load_version(spark, path)["a"].count() == 7
    assert versions.load_version(spark, path, 1)["a"].count() == 3


def test_refresh_equals_rebuild(spark):
    """Records that are added, changed and removed."""
    iso, gaz = fx.iso(spark), fx.gazetteer(spark)
    records = fx.records(spark, SF_SMALL).cache()
    key = F.col("MedlineCitation.PMID._VALUE").cast("long")
    path = scratch_path(spark, "profiles")
    # first: other authors in some records, and records that are there no more
    shifted = records.where(key % 7 == 3).select(F.col("MedlineCitation").withField(
        "PMID._VALUE", (key - 1).cast("string")).alias("MedlineCitation"))
    first = records.where((key % 7 != 2) & (key % 7 != 5)).unionByName(shifted)
    P.publish_authors(first, iso, gaz, path)
    removed = records.where(key % 7 == 6).select(key.cast("string").alias("uid"))
    assert P.refresh_authors(records.where((key % 7 == 2) | (key % 7 == 5)), iso, gaz, path, removed) == 2
    now = records.where(key % 7 != 6)
    other = scratch_path(spark, "profiles")
    P.publish_authors(now, iso, gaz, other)

    def rows(p):
        found = versions.load_version(spark, p)
        return [sorted(map(str, found[t].select(sorted(found[t].columns)).collect())) for t in ("placed", "authors")]
    assert rows(path) == rows(other)


def test_only_touched_names_are_merged_again(spark, monkeypatch):
    from litgraph.operators import authors as au
    iso, gaz = fx.iso(spark), fx.gazetteer(spark)
    records = fx.records(spark, SF_SMALL).cache()
    path = scratch_path(spark, "profiles")
    P.publish_authors(records, iso, gaz, path)
    merged, merge = [], au.merge_authors
    monkeypatch.setattr(au, "merge_authors", lambda df, *a: merged.append(df.select("forename", "lastname").distinct().count()) or merge(df, *a))
    one = records_by_id(records, records.select(F.min("MedlineCitation.PMID._VALUE").alias("uid")))
    P.refresh_authors(one, iso, gaz, path)
    names = versions.load_version(spark, path)["authors"].count()
    assert 0 < merged[0] <= 10 < names
