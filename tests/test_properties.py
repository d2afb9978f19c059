"""Property tests (hypothesis): many random inputs per Spark job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litgraph.functions import strings as S
from litgraph.operators import cluster

# whitespace limited to the characters both Python's strip() and ours remove
TEXT = st.text(alphabet=st.sampled_from(list("ab É,.: \t\n\r\x0b\x0c")), max_size=25)


def py_country(a):
    c = a.split(",")[-1].strip()
    return c.split(".")[0].strip()


def py_city(a):
    parts = a.split(",")
    return parts[-2].strip() if len(parts) >= 2 else None


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=200, max_size=200))
def test_affiliation_rules_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = df.select("i", S.affiliation_country("a").alias("c"), S.affiliation_city("a").alias("t"),
                    S.clean_author_name("a").alias("n")).collect()
    for r in got:
        a = texts[r.i]
        assert (r.c, r.t) == (py_country(a), py_city(a)), repr(a)
        assert r.n == a.split(":")[0].strip(), repr(a)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 39), st.integers(0, 39)), min_size=5, max_size=60))
def test_dbscan_m2_is_components_of_size_two_or_more(spark, raw):
    pairs = sorted({(min(a, b), max(a, b)) for a, b in raw if a != b})
    if not pairs:
        return
    edges = spark.createDataFrame(pairs, "src long, dst long")
    points = spark.range(40).select("id")
    labels = {r.id: r.cluster for r in cluster.dbscan(points, edges, 2).collect()}
    comp = {r.id: r.component for r in cluster.connected_components(edges).collect()}
    # same partition of the linked points; unlinked points are noise
    for i in range(40):
        assert (labels[i] == -1) == (i not in comp)
    for a, b in pairs:
        assert labels[a] == labels[b]
    groups = {}
    for i, c in comp.items():
        groups.setdefault(c, set()).add(labels[i])
    assert all(len(v) == 1 for v in groups.values())
    assert len({labels[i] for i in comp}) == len(groups)
    # clusters are numbered in order of their smallest member
    order = sorted(groups)
    assert [next(iter(groups[c])) for c in order] == list(range(len(order)))
