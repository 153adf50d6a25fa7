"""Boxes of unions of parts, against boxes of rows that were fanned out."""

import random


from monsoonway.operators import relational as R
from monsoonway.plans import queries as Q


def test_boxes_of_parts_equal_those_of_fanned_rows(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.choice(Q.SURFACES), float(draw.choice([1, 2, 2, 5, 9.5])), draw.randint(1, 3)) for _ in range(60)] + [("c", "unknown", 4.0, 2), (None, "paved", 1.0, 1), ("d", "unpaved", 7.0, 1)]
    counts = spark.createDataFrame(rows, "k string, surface string, v double, count long")
    want = R.five_numbers_of(Q._scenarios(counts), ["k", "scenario", "effective"], "v")
    found = R.five_numbers_each(counts, ["k"], "v", Q.SURFACES, Q.SCENARIO_SURFACES)
    order = lambda t: sorted(map(str, t.select(*want.columns).collect()))
    assert order(found) == order(want)


def test_road_boxes_do_not_fan_out(spark):
    plan = Q.boxplot_stats_roads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # of one generator: the boxes of a group, not its rows
    assert plan.count("Generate explode") == 1
