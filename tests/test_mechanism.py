"""Mix, impact, parity and scopes over small frames with nulls, ties, repeated rows and empty tables, against literal values."""

import pytest
from pyspark.sql import functions as F

from monsoonway.operators import mechanism as M

STEPS = "nation string, crop string, route long, surface string, share double, hours double, weight long"


def rounded(rows, *names):
    return sorted((tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names) for r in rows), key=str)


def test_route_mix(spark):
    steps = spark.createDataFrame([("a", "x", 1, "paved", 75.0, 4.0, 2), ("a", "x", 1, "unpaved", 25.0, 4.0, 2), ("a", "x", 2, "unpaved_synthetic_line", 40.0, 10.0, 1), ("a", "x", 2, "unknown", 60.0, 10.0, 1),
                                   ("a", "x", 3, "paved", 100.0, 99.0, None), (None, "x", 4, None, 100.0, None, 5), (None, None, 5, "paved", 100.0, 1.0, 0)], STEPS)
    found = M.route_mix(steps, ["nation", "crop"], ["nation", "route"], "surface", "share", "hours", "weight").collect()
    got = {(r["nation"], r["crop"]): r for r in found}
    # the route without a weight counts as a route, not in a mean
    assert got["a", "x"]["routes"] == 3 and got["a", "x"]["hours"] == pytest.approx(6.0)
    assert [got["a", "x"][f"{s}_share"] for s in ("paved", "unpaved", "unknown", "synthetic")] == pytest.approx([50.0, 50 / 3, 20.0, 40 / 3])
    assert got[None, "x"]["hours"] == 0.0 and got[None, "x"]["paved_share"] == 0.0
    assert got[None, None]["hours"] == 0.0 and got[None, None]["routes"] == 1
    assert M.route_mix(steps.limit(0), ["nation"], ["route"], "surface", "share", "hours", "weight").count() == 0


def test_threshold_impact(spark):
    rows = spark.createDataFrame([("a", 1, "paved", 3.0, 4.0, 1.0, 8.0), ("a", 1, "paved", 3.0, 4.0, 2.0, 8.0), ("a", 1, "unpaved", 1.0, 5.0, 0.0, 2.0), ("a", 2, "paved", 4.5, 4.0, 8.0, 8.0), ("a", 1, "unknown", 900.0, 1.0, 1.0, 1.0),
                                  ("b", 1, "paved", None, 2.0, None, None), ("c", 1, "unpaved", 2.0, 0.0, 0.0, 0.0)], "nation string, week int, surface string, wet double, base double, km double, all_km double")
    found = M.threshold_impact(rows, ["nation"], ["week"], "surface", "wet", "base", "km", "all_km").collect()
    names = ("nation", "increase_h", "base_h", "affected_km", "base_km", "impact_ratio", "affected_share")
    # 6 - 4 and 4.5 - 4 are increases, 1 - 5 is none
    assert rounded(found, *names) == [("a", 2.5, 13.0, 11.0, 18.0, round(2.5 / 13, 6), round(11 / 18, 6)), ("b", 0.0, 2.0, 0.0, 0.0, 0.0, 0.0), ("c", 2.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_frame_keeps_every_burden(spark):
    burden = spark.createDataFrame([("a", 0.0), (None, 1.0), ("z", None)], "nation string, burden_h double")
    mix = spark.createDataFrame([("a", 4, 2.0, 30.0), (None, 1, 0.0, 10.0)], "nation string, routes long, hours double, unpaved_share double")
    impact = spark.createDataFrame([("a", 0.5)], "nation string, impact_ratio double")
    found = {r["nation"]: r for r in M.mechanism_frame(burden, mix, impact, ["nation"]).collect()}
    assert set(found) == {"a", None, "z"}
    assert (found[None]["unpaved_share"], found[None]["impact_ratio"], found["z"]["unpaved_share"], found["z"]["hours"]) == (10.0, 0.0, 0.0, None)
    assert found["a"]["log_burden"] == 0.0 and found["a"]["log_impact"] == pytest.approx(0.405465, abs=1e-6) and found["z"]["log_burden"] is None and found[None]["log_burden"] == pytest.approx(0.693147, abs=1e-6)


def test_parity(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, None, 2.0), (4, "a", None), (5, "a", None), (6, "a", 1.0), (7, "a", 1.0)], "k long, s string, hours double")
    stored = spark.createDataFrame([(1, "a", 2.001), (2, "a", 2.1), (3, None, 2.0), (4, "a", None), (5, "a", 1.0), (6, "a", 1.0), (6, "a", 3.0)], "k long, s string, hours double")
    found = M.stored_parity(rows, stored, ["k", "s"], "hours", 0.01)
    assert rounded(found.collect(), "k", "parity") == sorted([(1, "equal"), (2, "differs"), (3, "missing"), (4, "equal"), (5, "differs"), (6, "equal"), (6, "differs"), (7, "missing")], key=str)
    assert M.stored_parity(rows, stored.limit(0), ["k", "s"], "hours", 0.01).where("parity <> 'missing'").count() == 0


def test_scopes(spark):
    cells = spark.createDataFrame([(1, 2, 0, 3), (2, 0, 0, 0), (3, None, 4, None)], "cell long, paved long, unpaved long, unknown long")
    found = M.overlay_scopes(cells, "cell")
    assert [(r["scenario"], r["scope"], r["roads"]) for r in found.where("cell = 1").collect()] == [
        ("actual_unpaved", "all", 5), ("actual_unpaved", "paved", 2), ("unknown_as_paved", "all", 5), ("unknown_as_paved", "paved", 5), ("unknown_as_unpaved", "all", 5), ("unknown_as_unpaved", "paved", 2), ("unknown_as_unpaved", "unpaved", 3)]
    assert found.where("cell = 2").agg(F.count("*"), F.sum("roads")).first()[:] == (3, 0)
    assert {(r["scope"], r["roads"]) for r in found.where("cell = 3").collect()} == {("all", 4), ("unpaved", 4)}
