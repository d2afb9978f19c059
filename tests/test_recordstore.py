"""The record store: the same records as a scan, from few folders."""

from pyspark.sql import functions as F

from litgraph.operators.authors import records_by_id
from litgraph.plans import fixtures as fx
from litgraph.session import scratch_path
from litgraph.sources.recordstore import records_of, save_records
from tests.conftest import SF_SMALL
from tests.test_textindex import _metrics, _nodes


def rows(df):
    return sorted(str(r) for r in df.select("MedlineCitation").collect())


def test_store_reads_the_folders_of_the_ids_only(spark):
    records = fx.records(spark, SF_SMALL).cache()
    path = scratch_path(spark, "records")
    key = F.col("MedlineCitation.PMID._VALUE")
    save_records(records.where(key.cast("long") < 3000), path)
    save_records(records.where(key.cast("long") >= 3000), path)
    ids = records.select(key.alias("uid"))
    some = ids.orderBy("uid").limit(2).union(spark.createDataFrame([("nowhere",), (None,)], "uid string"))
    got = records_of(spark, path, some)
    assert rows(got) == rows(records_by_id(records, some)) and len(rows(got)) == 2
    got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    scan = [x for x in _nodes(plan) if "numFiles" in _metrics(x)][0]
    assert 0 < _metrics(scan)["numFiles"] <= len(spark.read.parquet(path).inputFiles()) / 8
    assert "EqualTo(pmid" in plan.toString() and "PartitionFilters: [" in plan.toString()
    # many ids: a join; all, none
    many = ids.where("uid % 3 = 0")
    assert many.count() > 64 and rows(records_of(spark, path, many)) == rows(records_by_id(records, many))
    assert rows(records_of(spark, path, ids)) == rows(records)
    assert records_of(spark, path, ids.where("false")).collect() == []
