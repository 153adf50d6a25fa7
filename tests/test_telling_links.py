"""Dense graphs are thinned to the links that decide costs: same costs as over all links, few links left."""

import random

import numpy as np

from monsoonway.operators import network as N


def graph(week, nodes, seed):
    draw = random.Random(seed)
    return [(week, a, b, float(draw.randint(1, 50))) for a in nodes for b in nodes if a < b]


def test_thinned_graphs_keep_all_costs(spark):
    # two weeks of a dense part that the origins reach, one that they do not, and a node behind one heavy link alone
    links = [x for week in (1, 2) for x in graph(week, range(60), week) + graph(week, range(100, 160), week + 7) + [(week, 3, 99, 5000.0)]]
    table = N.checkpointed(spark.createDataFrame(links, "week int, a long, b long, w double"))
    own = np.array([0, 5, 170])
    taken, costs = N.telling_links(own, table, ["week"], light=2)
    rows = lambda found: sorted((r["week"], r["origin"], r["node"], r["cost"]) for r in found.collect())
    assert rows(costs) == rows(N._relaxed(own, table, ["week"]))
    assert (1, 0, 99) in {(r["week"], r["origin"], r["node"]) for r in costs.collect()}
    assert taken.count() < len(links) / 4


def test_graphs_without_keys_or_origins(spark):
    table = N.checkpointed(spark.createDataFrame(graph(1, range(40), 3), "week int, a long, b long, w double").drop("week"))
    for own in (np.array([7]), np.zeros(0, np.int64)):
        _, costs = N.telling_links(own, table, [], light=2)
        rows = lambda found: sorted((r["origin"], r["node"], r["cost"]) for r in found.collect())
        assert rows(costs) == (rows(N._relaxed(own, table, [])) if len(own) else [])
