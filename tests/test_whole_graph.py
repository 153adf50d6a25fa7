"""The graph over all successive lines, and its spanning forest against Kruskal's method."""

from test_queries import DATA

from monsoonway.operators import network as N
from monsoonway.plans import accessibility


def test_whole_forest_equals_kruskal(spark):
    root, want = {}, []

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for w, a, b in sorted((r["w"], r["a"], r["b"]) for r in N.order_graph(spark, str(DATA)).collect()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(map(tuple, accessibility.mst_links(spark, str(DATA)).collect())) == sorted(want)


def test_lines_of_different_weeks_are_an_edge(spark, tmp_path):
    lines = [(1, 1, 10, 5, 1.0, "1995-01-02"), (1, 2, 10, 6, 2.0, "1995-06-01"), (1, 3, 10, 7, 3.0, "1995-06-02"), (2, 1, 10, 9, 4.0, "1995-06-02")]
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, day string")
    table.selectExpr("*", "l_quantity AS l_extendedprice", "cast(day AS timestamp) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, N.order_graph(spark, str(tmp_path)).collect())) == [(5, 6, 1.0), (6, 7, 2.0)]
