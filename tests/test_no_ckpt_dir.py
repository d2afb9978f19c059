"""Queries must run in a session whose checkpoint folder is unset (the
driver's own session): operators set a private one only then."""

import os
import subprocess
import sys
import tempfile
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_cluster_session_without_shared_folder_raises():
    from types import SimpleNamespace

    import pytest

    from litgraph.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                         getConf=lambda: SimpleNamespace(get=lambda *_: None))
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(spark)


def test_queries_in_fresh_session_without_checkpoint_dir():
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        assert not spark.sparkContext.getCheckpointDir()
        import __spark_entry__ as e
        for key in ["node_ids", "connected_components", "khop_neighbors", "dbscan_general", "graph_roundtrip"]:
            assert e.queries()[key](spark, "/root/testdata/sf0.001").count() >= 0, key
        print("OK")
    """)
    # an empty conf folder: no spark-defaults, so no checkpoint folder is named
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="litgraph-noconf-"))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900, env=env)
    assert "OK" in out.stdout, out.stderr[-3000:]
