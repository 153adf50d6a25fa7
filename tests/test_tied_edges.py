"""Components by rounds, by one task and by both, against a plain search."""

import random

import pytest

from monsoonway.operators import network as N


def _plain(nodes, edges):
    of = {n: n for n in {*nodes, *(x for e in edges for x in e)}}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    return {n: of[n] for n in nodes}


@pytest.mark.parametrize("tied", [0, 25, 10_000])
def test_components_equal_a_plain_search(spark, tied):
    draw = random.Random(tied)
    edges = [(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)] + [(7, 7), (3, 4), (4, 3), (3, 4)]
    nodes = [*range(95), *range(200, 231), 500, 500]
    found = N.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"), tied)
    assert sorted(map(tuple, found.collect())) == sorted(_plain(nodes, edges).items())


def test_no_edges_and_no_nodes(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in N.components(spark.createDataFrame([(3,)], "node long"), none).collect()] == [(3, 3)]
    assert N.components(spark.createDataFrame([], "node long"), none).count() == 0


def test_orders_in_more_tasks_give_the_same_lines(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, N.order_graph(spark, "/root/testdata/sf0.001").collect()))
    want = rows()
    monkeypatch.setattr(N, "TASK_LINES", 500)
    assert N.successive(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
    assert rows() == want
