"""Links, bootstrap, severity and file sources against brute force, fixtures and invariants."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.functions import expressions as X
from monsoonway.operators import geometry as G
from monsoonway.operators import network as N
from monsoonway.operators import statistics as S
from monsoonway.plans import routing
from monsoonway.sources import tables as T

DATA = Path("/root/testdata/sf0.001")


def test_linking_forest_equals_kruskal(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), int(c)) for i, (x, y, c) in enumerate(zip(rng.normal(0, 30, 80), rng.normal(0, 30, 80), rng.integers(0, 9, 80)))]
    rows += [(100, 900.0, 900.0, 50), (101, None, 1.0, 51)]
    found = G.linking_forest(spark.createDataFrame(rows, "id long, x double, y double, component long"), 1.0).collect()
    whole = [r for r in rows if r[1] is not None]
    links = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, a[0], b[0], a[3], b[3]) for a in whole for b in whole if a[0] < b[0] and a[3] != b[3])
    into, want = {r[3]: r[3] for r in whole}, []
    for _, a, b, c, d in links:
        if into[c] != into[d]:
            want.append((a, b))
            gone = into[d]
            into = {k: into[c] if v == gone else v for k, v in into.items()}
    assert sorted((r.a, r.b) for r in found) == sorted(want)
    assert G.linking_forest(spark.createDataFrame(rows[:0], "id long, x double, y double, component long"), 1.0).collect() == []


def test_component_links_join_all_labels(spark):
    assert routing.component_links(spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/embeddings.parquet").select("label").distinct().count() - 1


def test_nearest_reaches_far_and_breaks_ties(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    targets = spark.createDataFrame([(9, 0.0, 2.0), (8, 2.0, 0.0), (7, 0.0, 90.0)], "id long, x double, y double")
    assert sorted(map(tuple, G.nearest(points, targets, 1.0).collect())) == [(1, 8, 4.0), (2, 8, 4998.0**2)]
    assert G.nearest(points, targets.limit(0), 1.0).collect() == []


def test_k_nearest_reaches_far_and_stops(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 3.0, 0.0, 1), (3, 900.0, 0.0, 0), (4, 0.0, 3.0, 1), (5, None, 0.0, 0)], "id long, x double, y double, label int")
    two = sorted(tuple(r)[:3] for r in G.k_nearest(points, points, 1.0, 2).collect())
    assert two == [(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 4), (3, 1, 2), (3, 2, 1), (4, 1, 1), (4, 2, 2)]
    alike = sorted(tuple(r)[:3] for r in G.k_nearest(points, points, 1.0, 2, "label = r_label").collect())
    assert alike == [(1, 1, 3), (2, 1, 4), (3, 1, 1), (4, 1, 2)]


def test_noding_cuts_crossings_touches_and_overlaps(spark):
    lines = [(1, 0.0, 0.0, 10.0, 0.0), (2, 5.0, -5.0, 5.0, 5.0), (3, 7.0, 0.0, 7.0, 4.0), (4, 8.0, 0.0, 12.0, 0.0), (5, 3.0, 3.0, 3.0, 3.0), (6, None, 0.0, 1.0, 1.0), (7, 100.0, 0.0, 900.0, 700.0)]
    found = G.noded(spark.createDataFrame(lines, "line_id long, x1 double, y1 double, x2 double, y2 double"), 3.0).orderBy("line_id", "piece").collect()
    cuts = {i: [(r.x1, r.x2) if i != 2 and i != 3 else (r.y1, r.y2) for r in found if r.line_id == i] for i in range(1, 8)}
    assert cuts[1] == [(0, 5), (5, 7), (7, 8), (8, 10)] and cuts[2] == [(-5, 0), (0, 5)] and cuts[3] == [(0, 4)]
    assert cuts[4] == [(8, 10), (10, 12)] and cuts[5] == [(3, 3)] and cuts[6] == [] and cuts[7] == [(100, 900)]


def test_route_steps_follow_the_cheapest_way(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 2.0), (8, 9, 1.0)], "a long, b long, w double")
    trips = spark.createDataFrame([(1, 4), (1, 9), (1, 1), (1, 4)], "origin long, dest long")
    costs = N.shortest_costs(trips.select("origin").distinct(), edges)
    assert sorted((r.step, r.a, r.b, r.w) for r in N.route_steps(trips, costs, edges).collect()) == [(1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 4, 2.0)]


def test_regressions(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 60))
    y = 2 * a - b + 0.1 * c + rng.normal(size=60)
    rows = spark.createDataFrame([(int(i), *map(float, v), 1) for i, v in enumerate(zip(y, a, b, c))] + [(99, 1.0, 2.0, 4.0, 8.0, 2), (98, None, 2.0, 4.0, 8.0, 1)], "id long, y double, a double, b double, c double, g int")
    z = lambda v: (v - v.mean()) / v.std()
    m = np.stack([z(a), z(b), z(c)], 1)
    want = np.linalg.lstsq(m, z(y), rcond=None)[0]
    one, two = S.standardised_ols_of(rows, ["g"], "y", ["a", "b", "c"]).orderBy("g").collect()
    assert [one.beta_1, one.beta_2, one.beta_3] == pytest.approx(want.tolist()) and one.n == 60 and two.beta_1 is None
    r2 = 1 - ((z(y) - m @ want) ** 2).sum() / 60
    assert one.r_squared == pytest.approx(r2) and one.adjusted == pytest.approx(1 - (1 - r2) * 59 / 56)
    left = S.residuals(rows.where("g = 1 and y is not null"), ["g"], "y", "a", "b").agg(F.sum("residual"), F.corr("residual", "a")).first()
    assert list(left) == pytest.approx([0, 0], abs=1e-9)
    drawn = S.bootstrap_coefficients(rows, ["g"], "id", "y", "a", "b", 40).where("g = 1").first()
    assert drawn.low1 < drawn.beta1 < drawn.high1 and drawn.sign1 == 1.0 and drawn.beta2 < 0


def test_severity_in_both_directions(spark):
    rows = spark.createDataFrame([(0.05,), (0.1,), (0.35,), (9.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(X.severity(F.col("v"), X.FLOOD_METRES)).collect()] == [None, "minor", "severe", "catastrophic", None]
    assert [r[0] for r in rows.select(X.severity(F.col("v"), {"minor": 1.0, "severe": 0.1, "catastrophic": None}, rising=False)).collect()] == ["severe", "severe", "minor", None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\nnot json\n{"id": 2, "t": null}\n')
    assert sorted(r.id for r in T.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string").collect()) == [1, 2]
    T.append_json_lines(spark.range(2), str(tmp_path / "out"))
    T.append_json_lines(spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    place = lambda i, lat, people, country="LR": "\t".join([str(i), f"p{i}", "", "", lat, "2.5", "", "", country, "", "", "", "", "", people, "", "", "", ""])
    (tmp_path / "p.tsv").write_text("\n".join([place(1, "1.5", "60000"), place(2, "x", "70000"), place(3, "1", "20"), place(4, "1", "60000", "GH"), "5\tshort"]))
    assert [tuple(r) for r in T.read_places(spark, str(tmp_path / "p.tsv"), "LR", 50000).collect()] == [(1, "p1", 1.5, 2.5, 60000)]
    (tmp_path / "air.csv").write_text("ident,type,name,latitude_deg,longitude_deg,iso_country,iata_code\nA,large_airport,Aa,1,2,LR,\nB,heliport,Bb,1,2,LR,B\nC,small_airport,Cc,bad,2,LR,C\n")
    assert [tuple(r) for r in T.read_airports(spark, str(tmp_path / "air.csv"), "LR").collect()] == [("A", "large_airport", "Aa", 1.0, 2.0, None)]
    assert [r[0] for r in spark.createDataFrame([("'4",), ("120",)], "c string").select(T.area_code(F.col("c"))).collect()] == ["004", "120"]
    box = spark.createDataFrame([(-4.0, -1.0, 3.0, 2.0)], "west double, south double, east double, north double")
    assert sorted(r.tile for r in T.tiles_over(box).collect()) == ["N00E000", "N00W003", "N00W006", "S03E000", "S03W003", "S03W006"]
    counts = spark.createDataFrame([("a", 1), ("b", None)], "k string, n long")
    assert sorted(map(tuple, T.add_counts(counts, counts, ["k"], ["n"]).collect())) == [("a", 2), ("b", 0)]
    assert [r.id for r in T.missing_keys(spark.range(3), spark.range(2), ["id"]).collect()] == [2]


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000 + i, 2000) for i in range(40)]
    loose = [(3000, 3000), (3001, None)]
    found = N.components(spark.createDataFrame([(n,) for e in chain + star for n in e] + [(3000,), (3002,)], "node long"), spark.createDataFrame([*chain, *star, *loose, (5, 1)], "a long, b long"))
    assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {(0, 201), (1000, 41), (3000, 1), (3002, 1)}


def test_route_steps_leave_heavy_links_out_and_keep_ties(spark, monkeypatch):
    """A dense graph whose routes are known: only links that some route may take are written, and of equal routes the smallest last node counts."""
    heavy = [(a, b, 100.0 + a + b) for a in range(30) for b in range(a + 1, 30)]
    rows = heavy + [(i, i + 1, 1.0) for i in range(29)] + [(0, 40, 1.0), (40, 2, 1.0), (2, 1, 1.0)]
    edges = spark.createDataFrame(rows, "a long, b long, w double")
    trips = spark.createDataFrame([(0, 2), (0, 3), (5, 0), (3, 3), (0, 77)], "origin long, dest long")
    costs = N.shortest_costs(trips.select("origin").distinct(), edges).cache()
    written, kept = [], N.checkpointed

    def noted(df):
        out = kept(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(N, "checkpointed", noted)
    found = sorted((r.origin, r.dest, r.step, r.a, r.b) for r in N.route_steps(trips, costs, edges).collect())
    assert found == [(0, 2, 1, 0, 1), (0, 2, 2, 1, 2), (0, 3, 1, 0, 1), (0, 3, 2, 1, 2), (0, 3, 3, 2, 3), *((5, 0, k + 1, 5 - k, 4 - k) for k in range(5))]
    assert max(written) < 60
