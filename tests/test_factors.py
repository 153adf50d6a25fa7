"""Rules, scopes, histograms, weeks and files against literal cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from monsoonway.operators import factors as W
from monsoonway.operators import network as N
from monsoonway.operators import relational as R
from monsoonway.sources import weeks as S


def test_increments_of_metres(spark):
    """A rise, a standstill, a reset, and nulls; a small fall is noise."""
    series = [0.001, 0.003, 0.003, 0.0005, None, 0.002]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(series)] + [(2, i, v) for i, v in enumerate([0.010, 0.009995, 0.0105])], "k long, i long, v double")
    got = [r["mm"] for r in R.increments(rows, ["k"], ["i"], "v", "mm", 1000.0).orderBy("k", "i").collect()]
    assert got[:4] == pytest.approx([1, 2, 0, 0.5]) and got[4:6] == [None, None] and got[6:] == pytest.approx([10, 0, 0.505])


def test_merged_histograms_and_boxplots(spark):
    parts = [spark.createDataFrame(x, "k long, value double, count long") for x in ([(1, 1.0, 1), (1, 2.0, 1)], [(1, 2.0, 1), (1, 5.0, 1)])]
    whole = W.merged_histograms(parts, ["k"], "value")
    r = W.boxplots(whole, ["k"], "value").first()
    assert (r["n"], r["v_min"], r["q25"], r["q50"], r["q75"], r["v_max"]) == (4, 1, 1, 2, 2, 5)


def test_scoped_values_as_percentiles_of_all(spark):
    raw = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (1, 30.0, 1)], "k long, value double, count long")
    scoped = spark.createDataFrame([(1, 20.0, 3), (1, 30.0, 1)], "k long, value double, count long")
    assert sorted((r["pct"], r["count"]) for r in W.scoped_percentiles(raw, scoped, ["k"], "value").collect()) == [(75, 3), (100, 1)]


@pytest.mark.parametrize("scope, scenario, want", [
    ("unpaved", "actual_unpaved", "FFTF"), ("unpaved", "unknown_as_paved", "FFTF"), ("unpaved", "unknown_as_unpaved", "FTTT"), ("effective_paved", "unknown_as_paved", "TTFT"),
    ("actual_unpaved", "unknown_as_unpaved", "FFTF"), ("*", "actual_unpaved", "TTTT"), ("both", "actual_unpaved", "TTTT")])
def test_scopes(spark, scope, scenario, want):
    rows = spark.createDataFrame(list(enumerate(["paved", "unknown", "unpaved", "unknown"])), "i long, surface string")
    got = [r[0] for r in rows.orderBy("i").select(W.in_scope(F.col("surface"), scope, scenario)).collect()]
    assert "".join("FT"[x] for x in got) == want


def test_rules():
    rows = [{"factor": "Rain_percentile", "scope": "paved", "direction": "gte", "minor": "90", "severe": "x"}, {"factor": "rain_percentile", "scope": "paved", "minor": "1"}, {"factor": "visibility", "direction": "lte", "minor": 1000, "closure": float("nan")},
            {"factor": "depth", "minor": 0.1}]
    rules = W.parsed_rules(rows)
    assert [(r["factor"], r["scope"], r["direction"]) for r in rules] == [("rain_percentile", "paved", "gte"), ("visibility", "all", "lte"), ("depth", "all", "gte")]
    assert rules[0]["levels"]["minor"] == 90 and rules[0]["levels"]["severe"] is None and rules[1]["levels"]["closure"] is None
    assert W.needed_factors(rules) == ["depth", "rain", "visibility"]
    sources = {"rain": "era5", "visibility": "station", "depth": "flood_depth"}
    assert W.routed(rules, sources) == {"flood_depth": ["depth"], "era5": ["rain"], "station": ["visibility"]} and "flood_depth" not in W.routed(rules, sources, flood=False)
    with pytest.raises(ValueError):
        W.parsed_rules([{"factor": "x", "direction": "above"}])


def test_weeks_and_files():
    assert S.month_list(date(2024, 1, 29), date(2024, 2, 4)) == [(2024, 1), (2024, 2)] and len(S.week_starts(date(2024, 1, 1), date(2024, 12, 31))) == 53
    months = [f"era5-land-2024-{m:02d}.nc" for m in range(1, 13)]
    assert S.months_needed(months, date(2024, 1, 29), date(2024, 2, 4)) == months[:2]
    with pytest.raises(FileNotFoundError):
        S.days_needed({date(2024, 1, 1): "a"}, date(2024, 1, 1), date(2024, 1, 2))
    flood = "ENSEMBLE_FLOOD_20240101T000000.tif"
    assert S.stamped_in_week([flood], date(2024, 1, 1)) == [flood] and S.stamped_in_week([flood], date(2024, 1, 8)) == []
    there = {f"d/era5-land-hourly-brazil-2024-{m:02d}.nc" for m in range(1, 13)}
    assert len(S.resolved_paths(None, "d/era5-land-hourly-brazil-2024-q3.nc", there.__contains__)) == 12
    assert S.resolved_paths(["x"], "y", there.__contains__) == ["x"] and S.resolved_paths(None, "y", {"y"}.__contains__) == ["y"] and S.resolved_paths(None, None, {"z"}.__contains__, "z") == ["z"]
    rows = [{"dataset_name": "a", "bbox_if_known": "[0, 0, 2, 2]"}, {"dataset_name": "b", "bbox_if_known": "[5, 5, 6, 6]"}, {"dataset_name": "c", "bbox_if_known": None}, {"dataset_name": "d", "bbox_if_known": "oops"}]
    assert [r["dataset_name"] for r in S.catalog_in_box(rows, (1, 1, 3, 3))] == ["a"]
    assert S.week_directories(["o/week_2024_01_08", "o/week_2024_01_01", "o/other"]) == {date(2024, 1, 1): "o/week_2024_01_01", date(2024, 1, 8): "o/week_2024_01_08"}
    assert not S.has_station_files(["stations.csv"]) and S.has_station_files(["stations.csv", "723.csv"])
    assert not S.usable_visibility(["DATE,VIS", '2024-01-01T00:00:00,"999999,9,N,9"']) and S.usable_visibility(["DATE,VIS", '2024-01-01T00:00:00,"016000,1,N,1"'])


def test_costs_of_several_graphs_by_both_ways(spark):
    """A small graph of two components and a twin of double weight: walked in tasks, and relaxed as tables."""
    links = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 2.0)]
    edges = spark.createDataFrame([(g, a, b, w * g) for g in (1, 2) for a, b, w in links], "g long, a long, b long, w double")
    want = sorted((g, 1, n, c * g) for g in (1, 2) for n, c in ((1, 0.0), (2, 1.0), (3, 2.0))) + [(g, 4, n, c * g) for g in (1, 2) for n, c in ((4, 0.0), (5, 2.0))]
    for held in (N.HELD_LINKS, 0):
        assert sorted(tuple(r) for r in N.graph_costs([1, 4], edges, ["g"], held).collect() if r["cost"] or r["origin"] == r["node"]) == sorted(want)


def test_scope_boxplots_equal_the_joined_way(spark):
    """Scopes as sums of surfaces give the boxes that histograms of each scope give, and scopes without rows none; each value is sorted once."""
    import random

    from monsoonway.operators import factors as W

    draw = random.Random(4)
    rows = [(k, s, float(draw.randrange(12)), draw.randint(1, 4)) for k in range(3) for s in ("paved", "unpaved", "unknown")[: k + 1] for _ in range(15)]
    counts = spark.createDataFrame(rows, "k int, surface string, v double, count long").groupBy("k", "surface", "v").sum("count").withColumnRenamed("sum(count)", "count")
    scopes = [(a, b) for a in ("actual_unpaved", "unknown_as_paved", "unknown_as_unpaved") for b in ("all", "paved", "unpaved")]
    raw = W.merged_histograms([counts.drop("surface")], ["k"], "v")
    want = set()
    for scenario, scope in scopes:
        own = W.merged_histograms([counts.where(W.in_scope(counts.surface, scope, scenario)).drop("surface")], ["k"], "v")
        boxes = W.boxplots(W.scoped_percentiles(raw, own, ["k"], "v"), ["k"], "pct")
        want |= {(r.k, scenario, scope, r.n, r.v_min, r.q25, r.q50, r.q75, r.v_max) for r in boxes.collect()}
    found = W.scope_boxplots(counts, ["k"], "v", ("paved", "unpaved", "unknown"), scopes)
    assert {(r.k, r.scenario, r.scope, r.n, r.v_min, r.q25, r.q50, r.q75, r.v_max) for r in found.collect()} == want and len(want) > 15
