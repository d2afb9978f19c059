"""Driver contract and the DuckDB oracle on the smallest scale."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["latitude", "longitude", "popup", "n_authors"]


def test_every_query_has_oracle_or_is_rows_only():
    qs, oracle = entry.queries(), entry.oracle_sql()
    # the optional corpus operators have tests of their own
    library = {q for q in qs if not re.match(r"op\d+_|pipeline$", q)}
    assert library <= set(oracle)
    assert set(oracle) <= set(qs)


FAST = ["merge_authors", "authors_by_location", "main_authors", "search_topk_bm25", "fuse_by_research",
        "similarity_edges", "dbscan_general", "node_hover", "filter_table_multi", "compose_query",
        "embed_tfidf", "search_composed", "attach_vectors"]
KEYS = sorted(entry.queries()) if os.environ.get("LITGRAPH_ORACLE_ALL") else FAST


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, key):
    from tools.oracle_check import compare, duck
    res = compare(spark, duck(SF_SMALL), key, entry.queries()[key], entry.oracle_sql().get(key), SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res
