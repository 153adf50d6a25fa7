"""NetCDF series, areas, goal-directed routes and terminal graphs: literals, brute force and odd rows."""

import heapq
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.operators import areas as A
from monsoonway.operators import goal_routes as R
from monsoonway.operators import network as N
from monsoonway.operators import terminals as T
from monsoonway.sources import netcdf

HOUR = 3_600_000_000


def at(*day):
    return int((datetime(*day) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def put(path, *args, **more):
    path.write_bytes(netcdf.encoded(*args, **more))


def read(spark, path, **options):
    netcdf.register(spark)
    return spark.read.format("netcdf").options(**options).load(str(path))


def test_files_that_name_time_differently_are_one_series(spark, tmp_path):
    one, zero = np.ones((1, 1, 1), np.float32), np.zeros(1)
    put(tmp_path / "a.nc", np.array([at(2024, 1, 1)]), zero, zero, {"t2m": one}, time_name="valid_time")
    put(tmp_path / "b.nc", np.array([at(2024, 2, 1)]), zero, zero, {"t2m": one * 2})
    found = read(spark, tmp_path)
    assert found.columns == ["time", "latitude", "longitude", "t2m"]
    assert [tuple(r) for r in found.orderBy("time").collect()] == [(datetime(2024, 1, 1), 0.0, 0.0, 1.0), (datetime(2024, 2, 1), 0.0, 0.0, 2.0)]


def test_scalar_coordinates_are_left_out(spark, tmp_path):
    one, zero = np.ones((1, 1, 1), np.float32), np.zeros(1)
    put(tmp_path / "a.nc", np.array([at(2024, 1, 1)]), zero, zero, {"t2m": one}, scalars=("expver", "depthBelowLandLayer"))
    put(tmp_path / "b.nc", np.array([at(2024, 2, 1)]), zero, zero, {"t2m": one * 2})
    found = read(spark, tmp_path)
    assert "expver" not in found.columns and found.count() == 2


def test_packed_and_missing_values(spark, tmp_path):
    raw = np.array([[[10, -999, 20]]], np.int16)
    put(tmp_path / "a.nc", np.array([at(2024, 1, 1)]), np.zeros(1), np.arange(3.0), {"tp": raw, "r": np.array([[[np.nan, np.inf, 1.0]]])}, attributes={"tp": {"_FillValue": np.int16(-999), "scale_factor": 0.5, "add_offset": 1.0}})
    found = read(spark, tmp_path / "a.nc").orderBy("longitude").collect()
    assert [r["tp"] for r in found] == [6.0, None, 11.0] and [r["r"] for r in found] == [None, None, 1.0]
    assert read(spark, tmp_path / "a.nc", variables="r").columns == ["time", "latitude", "longitude", "r"]


def test_repeated_stamps_come_from_the_first_file_and_slabs_are_pruned(spark, tmp_path):
    lats, lons = np.array([2.0, 1.0, 0.0]), np.array([0.0, 1.0])
    for name, first, value in (("a.nc", 0, 1.0), ("b.nc", 2, 2.0)):
        put(tmp_path / name, at(2024, 1, 1) + np.arange(first, first + 4) * HOUR, lats, lons, {"v": np.full((4, 3, 2), value)})
    whole = read(spark, tmp_path, slab_bytes="32")
    assert whole.count() == 6 * 6 and {(r["time"].hour, r["v"]) for r in whole.collect()} == {*((h, 1.0) for h in range(4)), (4, 2.0), (5, 2.0)}
    reader = netcdf.NetCDFReader(netcdf.listed(str(tmp_path)), ["v"], 1 << 20)
    asked = whole.where((F.col("time") >= F.lit("2024-01-01 04:00:00").cast("timestamp_ntz")) & (F.col("latitude") < 0.5))
    assert [(r["time"].hour, r["latitude"]) for r in asked.collect()] == [(h, 0.0) for h in (4, 4, 5, 5)]
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    list(reader.pushFilters([GreaterThanOrEqual(("time",), datetime(2024, 1, 1, 4)), LessThan(("latitude",), 0.5)]))
    assert [(p.path[-4:], p.steps, p.rows) for p in reader.partitions()] == [("b.nc", (2, 3), (2, 3))]


def test_month_files_of_a_window(spark, tmp_path):
    for m in (1, 2, 3):
        put(tmp_path / f"era5-land-2024-{m:02d}.nc", np.array([at(2024, m, 1)]), np.zeros(1), np.zeros(1), {"v": np.full((1, 1, 1), float(m))})
    assert sorted(r["v"] for r in read(spark, tmp_path, **{"from": "2024-01-29", "to": "2024-02-04"}).collect()) == [1.0, 2.0]


def test_records_along_an_unlimited_dimension():
    """Two record variables of odd sizes, whose records are padded and interleaved."""
    import struct

    name = lambda s: struct.pack(">i", len(s)) + s.encode() + bytes(-len(s) % 4)
    dims = struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("lat") + struct.pack(">i", 1) + name("lon") + struct.pack(">i", 3)
    none = struct.pack(">ii", 0, 0)
    units = struct.pack(">ii", 12, 1) + name("units") + struct.pack(">ii", 2, 21) + b"hours since 2024-01-01" [:21] + bytes(3)

    def file(begins):
        variables = [("lat", [1], 6, 8, none), ("lon", [2], 6, 24, none), ("time", [0], 4, 4, units), ("v", [0, 1, 2], 3, 8, none)]
        out = b"CDF\x01" + struct.pack(">i", 2) + dims + none + struct.pack(">ii", 11, 4)
        for (n, own, kind, size, attributes), begin in zip(variables, begins):
            out += name(n) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", d) for d in own) + attributes + struct.pack(">iii", kind, size, begin)
        return out

    size = len(file([0] * 4))
    data = file([size, size + 8, size + 32, size + 36]) + struct.pack(">d", 5.0) + struct.pack(">3d", 1, 2, 3)
    for t in range(2):
        data += struct.pack(">i", t) + struct.pack(">3h", t * 10, t * 10 + 1, t * 10 + 2) + bytes(2)
    header = netcdf._parsed(data)
    v = header.variables["v"]
    assert v.shape == [2, 1, 3] and v.stride == 12
    import io

    assert netcdf._numbers(io.BytesIO(data), v, 3, 3).tolist() == [10, 11, 12]
    with pytest.raises(ValueError):
        netcdf._parsed(b"\x89HDF\r\n\x1a\n")


@pytest.mark.parametrize("closed, hours", [(False, [1, 2]), (True, [1, 2, 3])])
def test_nearest_cell_series(spark, tmp_path, closed, hours):
    """Each axis by itself, of two as near the larger, longitudes modulo 360, null coordinates, the two kinds of ends."""
    lats, lons = np.array([1.0, 0.0, -1.0]), np.array([0.0, 120.0, 240.0, 359.0])
    values = np.arange(4 * 12.0).reshape(4, 3, 4)
    put(tmp_path / "a.nc", at(2024, 1, 1) + np.arange(4) * HOUR, lats, lons, {"v": values})
    points = spark.createDataFrame([(1, -121.0, 0.4), (2, 60.0, 0.5), (3, -1.2, -7.0), (4, None, 0.0), (4, 0.0, 0.0), (4, 0.0, 0.0)], "id long, longitude double, latitude double")
    found = netcdf.sampled_series(points, str(tmp_path / "a.nc"), ["v"], "2024-01-01 01:00:00", "2024-01-01 03:00:00", closed)
    cell = {1: (1, 2), 2: (0, 1), 3: (2, 3), 4: (1, 0)}
    want = [(i, h, values[h][cell[i]]) for i in (1, 2, 3, 4, 4) for h in hours]
    assert sorted((r["id"], r["time"].hour, r["v"]) for r in found.collect()) == sorted(want)
    assert netcdf.sampled_series(points, str(tmp_path / "a.nc"), ["v"], "2025-01-01 00:00:00", "2025-01-02 00:00:00", closed).count() == 0
    assert netcdf.sampled_series(points.limit(0), str(tmp_path / "a.nc"), ["v"]).count() == 0


def cast(x, y, rings):
    """Even-odd ray casting."""
    n = 0
    for xs, ys in rings:
        for i in range(len(xs)):
            x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % len(xs)], ys[(i + 1) % len(xs)]
            n += (y1 > y) != (y2 > y) and (y - y1) * (x2 - x1) / (y2 - y1) + x1 > x
    return n % 2 == 1


@pytest.mark.parametrize("cell", [0.3, 1.0, 40.0])
def test_areas_equal_ray_casting(spark, cell):
    """Stars with holes and parts apart, across zero, with points on corners, sides and cell edges; wide areas in cells far smaller than they are."""
    draw = np.random.default_rng(3)
    table, rings = [], {}
    for area in range(6):
        own = []
        for part in range(2):
            n = int(draw.integers(3, 14))
            turn, far = np.sort(draw.uniform(0, 2 * np.pi, n)), draw.uniform(2, 12, n)
            x, y = draw.uniform(-10, 10, 2) + part * 40
            for by in (1.0, 0.4):
                own.append(((x + by * far * np.cos(turn)).tolist(), (y + by * far * np.sin(turn)).tolist()))
        rings[area] = own
    rings[6] = [([-8.0, 8.0, 8.0, -8.0], [-3.0, -3.0, 3.0, 3.0]), ([-6.0, 6.0, 6.0, -6.0], [-2.0, -2.0, 2.0, 2.0])]
    table = [(a, i, xs, ys) for a, own in rings.items() for i, (xs, ys) in enumerate(own)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(draw.uniform(-25, 60, (400, 2)))]
    rows += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate([(-8, -3), (8, 3), (0, -3), (0, 3), (0, 0), (7, 2.5), (-8, 0), (8, 0), (6, 2), (-6, -2), (0.3, 2.4)])]
    want = sorted((i, a) for i, x, y in rows for a, own in rings.items() if cast(x, y, own))
    points = spark.createDataFrame([*rows, rows[0], (9999, None, 1.0)], "id long, x double, y double")
    held = spark.createDataFrame([*table, (7, 0, [0.0, 1.0], [0.0, 1.0]), (8, 0, [0.0, None, 1.0], [0.0, 1.0, 1.0])], "area int, ring int, xs array<double>, ys array<double>")
    assert sorted(map(tuple, A.located(points, held, cell).collect())) == want
    assert A.located(points, held.limit(0), cell).count() == 0


def test_inner_cells_are_few_blocks_and_exactly_the_run(spark):
    runs = spark.createDataFrame([(0, 0, a, b) for a, b in ((-7, 9), (0, 1023), (5, 5), (-1, 0), (3, 6))], "area int, cy long, first long, last long").withColumn("cy", F.monotonically_increasing_id())
    own = {r["cy"]: (r["first"], r["last"]) for r in runs.collect()}
    blocks = A._blocks(runs).collect()
    for cy, (a, b) in own.items():
        cells = sorted(c for r in blocks if r["cy"] == cy for c in range(r["block"] << r["level"], (r["block"] + 1) << r["level"]))
        assert cells == list(range(a, b + 1))
    assert sum(1 for r in blocks if own[r["cy"]] == (0, 1023)) == 1


def test_text_form_and_representative_points(spark):
    texts = [("a", "POLYGON ((0 0, 10 0, 10 4, 0 4, 0 0), (1 1, 9 1, 9 3, 1 3, 1 1))"), ("b", "multipolygon(((0 0,2 0,0 2)),((5 5,6 5,6 6,5 6,5 5)))"), ("c", None), ("d", "POINT EMPTY")]
    rings = A.rings_of(spark.createDataFrame(texts, "name string, wkt string"), "name", "wkt")
    found = {(r["area"], r["ring"]): list(zip(r["xs"], r["ys"])) for r in rings.collect()}
    assert found[("b", 0)] == [(0, 0), (2, 0), (0, 2)] and len(found[("a", 1)]) == 4 and {k[0] for k in found} == {"a", "b"}
    again = A.rings_of(A.wkt_of(rings), "area", "wkt")
    assert {(r["area"], r["ring"]): list(zip(r["xs"], r["ys"])) for r in again.collect()} == found
    shapes = {"a": [list(zip(*found[("a", i)])) for i in (0, 1)], "b": [list(zip(*found[("b", i)])) for i in (0, 1)]}
    inside = {r["area"]: (r["x"], r["y"]) for r in A.representative_points(rings).collect()}
    assert set(inside) == {"a", "b"} and all(cast(*inside[k], shapes[k]) for k in inside)


def _drawn_graph(seed, n=160, reach=0.14):
    draw = np.random.default_rng(seed)
    xy = draw.uniform(0, 1, (n, 2))
    links = [(i, j, float(np.hypot(*(xy[i] - xy[j])) * draw.choice([1.0, 1.5, 2.0]))) for i in range(n) for j in range(i + 1, n) if np.hypot(*(xy[i] - xy[j])) < reach]
    return xy, links


def _dijkstra(links, origin):
    near = {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    cost, queue = {origin: 0.0}, [(0.0, origin)]
    while queue:
        far, node = heapq.heappop(queue)
        if far > cost[node]:
            continue
        for n, w in near.get(node, []):
            if far + w < cost.get(n, np.inf):
                cost[n] = far + w
                heapq.heappush(queue, (far + w, n))
    return cost


def _base(spark, xy, links):
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "node long, x double, y double")
    return R.base_table(spark.createDataFrame(links, "a long, b long, w double"), nodes)


def test_goal_directed_costs_equal_dijkstra_and_settle_fewer(spark):
    xy, links = _drawn_graph(1)
    base = _base(spark, xy, [*links, (3, 3, 0.1), (*links[0][:2], links[0][2] * 5)])
    draw = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, len(xy), (60, 2))] + [(5, 5), (7, 9999), (9999, 9999)]
    table = spark.createDataFrame([*pairs, pairs[0], (None, 1)], "origin long, dest long")
    want = {}
    for a, b in set(pairs):
        cost = 0.0 if a == b else _dijkstra(links, a).get(b)
        if cost is not None:
            want[a, b] = round(cost, 9)
    runs = {}
    for goal in (True, False):
        found = R.pair_costs(table, base, goal).collect()
        assert {(r["origin"], r["dest"]): round(r["cost"], 9) for r in found} == want and len(found) == len(want)
        runs[goal] = sum(r["settled"] for r in found)
    assert runs[True] < 0.6 * runs[False]


def test_goal_directed_costs_as_tables(spark):
    """A component that no task holds is walked as tables, with equal costs; another one beside it is not."""
    xy, links = _drawn_graph(4, 40, 0.25)
    xy = np.concatenate([xy, xy[:4] + 3])
    links = [*links, (40, 41, 9.0), (41, 42, 9.0)]
    base = _base(spark, xy, links)
    pairs = [(0, 9), (1, 30), (2, 17), (40, 42), (0, 42)]
    table = spark.createDataFrame(pairs, "origin long, dest long")
    found = {(r["origin"], r["dest"]): (round(r["cost"], 9), r["settled"]) for r in R.pair_costs(table, base, held=5).collect()}
    assert {k: v[0] for k, v in found.items()} == {(a, b): round(c, 9) for a, b in pairs if (c := _dijkstra(links, a).get(b)) is not None}
    assert found[40, 42][1] is not None and any(v[1] is None for v in found.values())


def test_goal_directed_costs_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b long, w double, x1 double, y1 double, x2 double, y2 double")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "origin long, dest long")
    assert [tuple(r)[:3] for r in R.pair_costs(pairs, empty).collect()] == [(1, 1, 0.0)]


def prim(nodes, terminals):
    """Grows from the component with most terminals, by all distances."""
    n = {}
    for i, _, _, c in nodes:
        n[c] = n.get(c, 0) + (i in terminals)
    open_ = {c for c, k in n.items() if k}
    held = {min(open_, key=lambda c: (-n[c], c))}
    open_ -= held
    out = []
    while open_:
        best = min(((x1 - x2) ** 2 + (y1 - y2) ** 2, min(i, j), max(i, j), i, j, d) for i, x1, y1, c in nodes if c in held for j, x2, y2, d in nodes if d in open_)
        out.append((len(out) + 1, best[3], best[4], best[5], round(best[0], 9)))
        held.add(best[5])
        open_.remove(best[5])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_growth_equals_prim(spark, seed):
    draw = np.random.default_rng(seed)
    nodes = [(i, float(x), float(y), int(draw.integers(0, 9))) for i, (x, y) in enumerate(draw.integers(0, 40, (60, 2)))]
    terminals = sorted({int(i) for i in draw.integers(0, 60, 15)})
    table = spark.createDataFrame(nodes, "id long, x double, y double, component long")
    found = T.growth(table, spark.createDataFrame([(i,) for i in terminals], "id long"), 1.0).orderBy("step").collect()
    assert [(*tuple(r)[:4], round(r["d2"], 9)) for r in found] == prim(nodes, terminals)


def test_connected_terminals(spark):
    """Two roads apart and a lone node without a terminal: connectors at 15 km/h, one added link, and the lone node stays alone."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 10.0, 0.0), (4, 11.0, 0.0), (5, 500.0, 500.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0.1), (3, 4, 0.1)], "a long, b long, w double")
    terminals = spark.createDataFrame([(0, 0.0, 3.0), (1, 1.0, 1.5), (2, 11.0, -3.0), (3, None, 0.0)], "id long, x double, y double")
    points, every, placed = T.connected_terminals(nodes, edges, terminals, 1.0)
    assert {(r["terminal"], r["id"], r["road"], r["length"]) for r in placed.collect()} == {(0, 6, 1, 3.0), (1, 7, 2, 1.5), (2, 8, 4, 3.0)}
    assert {(r["kind"], r["a"], r["b"], round(r["w"], 9)) for r in every.collect()} == {("road", 1, 2, 0.1), ("road", 3, 4, 0.1), ("terminal_connector", 6, 1, 0.2), ("terminal_connector", 7, 2, 0.1), ("terminal_connector", 8, 4, 0.2), ("component_connector", 2, 3, 0.6)}
    labels = {r["node"]: r["component"] for r in N.components(points.select(F.col("id").alias("node")), every).collect()}
    assert len({labels[i] for i in (6, 7, 8)}) == 1 and labels[5] == 5
    one = spark.createDataFrame([(1, 0.0, 0.0, 1)], "id long, x double, y double, component long")
    assert T.growth(one, one, 1.0).count() == 0 and T.growth(one.limit(0), one.limit(0), 1.0).count() == 0


def _lines(spark, draw, n, first):
    rows = []
    for i in range(n):
        x, y = draw.integers(0, 30, 2).tolist()
        dx, dy = draw.integers(-6, 7, 2).tolist()
        rows.append((first + i, float(x), float(y), float(x + dx), float(y + dy)))
    return spark.createDataFrame(rows, "line_id long, x1 double, y1 double, x2 double, y2 double")


def test_renoding_equals_noding_everything(spark):
    """Lines on whole numbers cross, touch, overlap and repeat; lines without length and without coordinates among them."""
    from monsoonway.operators import geometry as G
    from monsoonway.operators import renoding as L

    draw = np.random.default_rng(6)
    base, first, second = _lines(spark, draw, 60, 0), _lines(spark, draw, 7, 100), _lines(spark, draw, 7, 200)
    odd = spark.createDataFrame([(300, 5.0, 5.0, 5.0, 5.0), (301, None, 1.0, 2.0, 2.0)], base.schema)
    rows = lambda t: sorted((r["line_id"], r["piece"], *(round(r[c], 7) for c in ("x1", "y1", "x2", "y2"))) for r in t.collect())
    lines, cuts = base, L.cuts_of(base, 4.0)
    pieces = G.split_at(base, cuts)
    assert rows(pieces) == rows(G.noded(base, 4.0))
    for added in (first, second.unionByName(odd), odd.limit(0)):
        cuts, pieces = (N.checkpointed(t) for t in L.renoded(lines, cuts, pieces, added, 4.0))
        lines = lines.unionByName(added)
        assert rows(pieces) == rows(G.noded(lines, 4.0)) and rows(pieces.where("line_id = 301")) == []


def test_parents_by_covering_and_by_nearness(spark):
    from monsoonway.operators import renoding as L

    lines = spark.createDataFrame([(5, 0.0, 0.0, 10.0, 0.0), (3, 2.0, 0.0, 8.0, 0.0), (9, 0.0, 2.0, 10.0, 2.0)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    pieces = spark.createDataFrame([(1, 0, 4.0, 0.0, 6.0, 0.0), (1, 1, 0.0, 0.0, 1.0, 0.0), (2, 0, 4.0, 1.6, 6.0, 1.6), (2, 1, 4.0, 50.0, 6.0, 50.0)], "line_id long, piece long, x1 double, y1 double, x2 double, y2 double")
    found = {(r["line_id"], r["piece"]): (r["parent"], r["covered"]) for r in L.parents(pieces, lines, 3.0, 1e-6).collect()}
    assert found == {(1, 0): (3, True), (1, 1): (5, True), (2, 0): (9, False), (2, 1): (None, False)}


def test_weekly_run_resumes_and_replaces(spark):
    from datetime import date

    from monsoonway.operators import weekly_access as W

    links = lambda scale: spark.createDataFrame([(date(2024, 1, 1 + 7 * w), s, a, b, c * scale) for w in range(2) for s in ("x", "y") for a, b, c in ((1, 2, 1.0 + w), (2, 3, 2.0), (7, 8, 1.0), (3, 4, 0.0))], "week_start date, scenario string, a long, b long, w double")
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(9)], "node long, x double, y double")
    od = spark.createDataFrame([(1, 3, "p"), (1, 3, "q"), (1, 8, "p"), (2, 2, "p"), (1, None, "p"), (3, 4, "z")], "origin long, dest long, crop string")
    folder = N.scratch_folder(spark)
    rows = lambda: {(str(r["week_start"]), r["scenario"], r["origin"], r["dest"], r["crop"]): (r["travel_time_h"], r["route_status"]) for r in spark.read.parquet(folder).collect()}
    assert W.run_weeks(links(1.0).where("scenario = 'x'"), nodes, od, folder) == 2 and W.run_weeks(links(1.0).where("scenario = 'x'"), nodes, od, folder) == 0
    assert W.run_weeks(links(10.0), nodes, od, folder) == 2 and W.run_weeks(links(100.0), nodes, od, folder, [("2024-01-08", "y"), ("2030-01-01", "y")]) == 1
    found = rows()
    assert len(found) == 4 * 6 and {k[:2]: v for k, v in found.items() if k[2:] == (1, 3, "q")} == {("2024-01-01", "x"): (3.0, "ok"), ("2024-01-08", "x"): (4.0, "ok"), ("2024-01-01", "y"): (30.0, "ok"), ("2024-01-08", "y"): (400.0, "ok")}
    assert found["2024-01-01", "x", 1, 8, "p"] == (None, "unreachable") == found["2024-01-01", "x", 1, None, "p"] == found["2024-01-01", "x", 3, 4, "z"] and found["2024-01-01", "x", 2, 2, "p"] == (0.0, "ok")


def test_keyed_graphs_as_tables(spark):
    xy, links = _drawn_graph(4, 30, 0.3)
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "node long, x double, y double")
    weighted = spark.createDataFrame([(k, a, b, w * (1 + (a * k) % 3)) for k in (0, 1) for a, b, w in links], "k long, a long, b long, w double")
    pairs = spark.createDataFrame([(0, 9), (1, 22), (5, 5)], "origin long, dest long")
    base = R.base_table(weighted, nodes, ("k",))
    found = [{(r["k"], r["origin"], r["dest"]): round(r["cost"], 9) for r in R.pair_costs(pairs, base, held=held, keys=("k",)).collect()} for held in (5, 10_000)]
    want = {(k, a, b): round(c, 9) for k in (0, 1) for a, b in ((0, 9), (1, 22), (5, 5)) if (c := _dijkstra([(x, y, w * (1 + (x * k) % 3)) for x, y, w in links], a).get(b)) is not None}
    assert found[0] == found[1] == want


def test_k_nearest_of_rare_targets_without_a_wide_round(spark, monkeypatch):
    """Labels with fewer targets than asked for, also of one point alone, dense and lone points: as all distances say, and no round joins all pairs."""
    from monsoonway.operators import geometry as G

    draw = np.random.default_rng(8)
    xy = np.concatenate([draw.normal(0, 1, (150, 2)), draw.uniform(-500, 500, (50, 2))])
    rows = [(i, float(x), float(y), "rare" if i % 97 == 3 else "none" if i == 7 else "lone" if i == 9 else None if i == 11 else "many") for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "id long, x double, y double, label string")
    reaches, inner = [], G.within
    monkeypatch.setattr(G, "within", lambda a, b, r, s=(): reaches.append(r) or inner(a, b, r, s))

    def brute(k, may):
        out = []
        for i, x, y, a in rows:
            near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v, b in rows if j != i and (may(a, b) if may else j in (3, 100)))
            out += [(i, r + 1, j) for r, (_, j) in enumerate(near[:k])]
        return sorted(out)

    for k in (1, 3):
        assert sorted(tuple(r)[:3] for r in G.k_nearest(points, points, None, k, same=("label",)).collect()) == brute(k, lambda a, b: a is not None and a == b)
        assert sorted(tuple(r)[:3] for r in G.k_nearest(points, points, None, k, only="label = 'rare'").collect()) == brute(k, lambda a, b: b == "rare")
        reaches.clear()
        assert sorted(tuple(r)[:3] for r in G.k_nearest(points, points, None, k).collect()) == brute(k, lambda a, b: True)
        assert max(reaches) < 700  # the points lie 2,000 apart
        reaches.clear()
        # all of the two targets are taken by every point, without a search
        assert sorted(tuple(r)[:3] for r in G.k_nearest(points, points, None, k + 1, only="id in (3, 100)").collect()) == brute(k + 1, None) and not reaches
        assert G.k_nearest(points, points.limit(0), None, k).count() == 0 == G.k_nearest(points.limit(0), points, None, k).count()
