"""Operators that SQL does not express, and sources, on small fixtures."""

import math

import pytest

from monsoonway.functions import expressions as X
from monsoonway.operators import network as N
from monsoonway.operators import statistics as S
from monsoonway.sources import raster, tables
from monsoonway.streaming import counts
from pyspark.sql import functions as F


def kruskal(edges):
    root = {v: v for e in edges for v in e[:2]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    out = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


def test_spanning_links_equal_kruskal(spark):
    edges = [(a, b, float((a * 7 + b * 13) % 5)) for a in range(30) for b in range(a + 1, 30) if (a * b + a) % 6 == 1 or b == a + 15]
    got = N.spanning_links(spark.createDataFrame(edges, "a long, b long, w double"))
    assert sorted(map(tuple, got.collect())) == kruskal(edges)
    assert N.spanning_links(spark.createDataFrame([], "a long, b long, w double")).isEmpty()


def test_shortest_costs_on_the_small_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 2.0)], "a long, b long, w double")
    got = {(r.origin, r.node): r.cost for r in N.shortest_costs(spark.createDataFrame([(1,)], "origin long"), edges).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 2.0}


def test_raster_samples(spark):
    values = [[float(r * 4 + c + 1) for c in range(4)] for r in range(4)]
    values[1][1] = -9999.0
    cut = [(i, j, [row[2 * j : 2 * j + 2] for row in values[2 * i : 2 * i + 2]]) for i in range(2) for j in range(2)]
    tiles = spark.createDataFrame(cut, "tile_row int, tile_column int, cells array<array<double>>")
    points = spark.createDataFrame([(0, 0.1, 3.9), (1, 1.2, 2.8), (2, 1.1, 2.8), (3, 3.4, 1.2), (4, 9.0, 9.0), (5, None, 1.0)], "id int, x double, y double")
    grid = raster.Grid(0.0, 4.0, 1.0, 4, 4, 2, -9999.0)
    got = {r.id: r.value for r in raster.sample_points(tiles, points, grid).collect()}
    assert got == {0: 1.0, 1: None, 2: None, 3: 12.0, 4: None, 5: None}


@pytest.mark.parametrize(("how", "want"), [("sum", 5.0), ("mean", 2.5), ("max", 3.0), ("first_valid", 2.0)])
def test_raster_reduction(spark, how, want):
    samples = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, 3.0), (2, 0, None)], "id int, nth int, value double")
    assert {r.id: r.value for r in raster.reduce_samples(samples, "id", "nth", how).collect()} == {1: want, 2: None}


def test_visibility(spark, tmp_path):
    (tmp_path / "a.csv").write_text('DATE,LATITUDE,VIS\n2024-01-01T01:00:00,1.0,"016000,1,N,1"\n2024-01-02T01:00:00,1.0,"009000,1,N,1"\n2024-01-09T01:00:00,1.0,"999999,1,N,1"\n')
    got = tables.read_visibility(spark, str(tmp_path / "a.csv"), "2024-01-01").collect()
    assert [(str(r.week_start), r.metres) for r in got] == [("2024-01-01", 9000.0)]


def test_catalog_upsert(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "name string, path string, size string")
    new = spark.createDataFrame([("b", "y"), ("c", "z")], "name string, path string")
    got = tables.upsert_catalog(old, new, ["name", "path", "size"], ["name", "path"])
    assert sorted(map(tuple, got.collect())) == [("a", "x", "1"), ("b", "y", ""), ("c", "z", "")]


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "c string, v int"), path, ["c"])
    tables.write_partitions(spark.createDataFrame([("b", 3)], "c string, v int"), path, ["c"])
    assert sorted((r.c, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_clusters_hold_all_rows(spark):
    points = spark.createDataFrame([(i, float(i % 3) * 100 + i * 0.01, 0.0, 1.0 + i % 2) for i in range(60)], "id long, x double, y double, w double")
    got = S.weighted_clusters(points, "id", "x", "y", "w", k=3).orderBy("cluster_rank").collect()
    assert [r.rows for r in got] == [20, 20, 20] and math.isclose(sum(r.weight for r in got), 90.0)
    assert S.weighted_clusters(points.limit(0), "id", "x", "y", "w").isEmpty()


def test_bootstrap_interval_holds_the_correlation(spark):
    rows = spark.createDataFrame([(i, "g", float(i), float(i + (i * 37) % 50)) for i in range(200)], "id long, k string, x double, y double")
    r = S.bootstrap_correlation(rows, ["k"], "id", "x", "y", 100).first()
    assert r.low < r.rho < r.high and r.supported
    assert S.bootstrap_correlation(rows, ["k"], "id", "x", "y", 100).first() == r


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-{d:02d} 03:00:00", "ab"[d % 2], float(d)) for d in range(1, 29)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "e"))
    stream = counts.stream_weekly_counts(spark, str(tmp_path / "e"), "2024-01-01")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, counts.weekly_counts(rows, "2024-01-01").collect()))


def test_addresses(spark):
    urls = [("https://www.A.org/x/?q=1",), ("http://a.org/x#top",), (None,)]
    assert [r[0] for r in spark.createDataFrame(urls, "u string").select(X.normalised_url(F.col("u"))).collect()] == ["a.org/x", "a.org/x", None]
