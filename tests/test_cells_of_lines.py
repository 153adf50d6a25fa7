"""Noding by cells: cuts leave a cell once and packed, cells of whatever size give the same, and reach is that of the pieces."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.operators import crossings as C
from monsoonway.operators import geometry as G
from monsoonway.operators import network as N
from monsoonway.operators import renoding as L

SCHEMA = "line_id long, x1 double, y1 double, x2 double, y2 double"


def _drawn(seed, n, wide, whole):
    draw = np.random.default_rng(seed)
    at, by = draw.normal(0, wide, (n, 2)), draw.normal(0, wide / 4, (n, 2))
    ends = np.round(np.column_stack([at, at + by])) if whole else np.column_stack([at, at + by])
    rows = [(i, *map(float, e)) for i, e in enumerate(ends)]
    # copies, turned copies, a point, a line without coordinates and far ones, of which two share an end
    rows += [(n + i, *rows[i][1:]) for i in range(0, n, 7)] + [(3 * n, *rows[3][3:], *rows[3][1:3]), (3 * n + 1, 2.0, 2.0, 2.0, 2.0), (3 * n + 2, None, 0.0, 1.0, 1.0)]
    return rows + [(4 * n, 900.0, 0.0, 910.0, 0.0), (4 * n + 1, 910.0, 0.0, 910.0, 5.0), (4 * n + 2, 950.0, 0.0, 951.0, 0.0)]


def _plain(rows):
    """Places in billionths at which each line is cut, every pair compared."""
    cuts = {r[0]: set() for r in rows if None not in r}
    for i, x1, y1, x2, y2 in (r for r in rows if r[0] in cuts):
        rx, ry = x2 - x1, y2 - y1
        for j, u1, v1, u2, v2 in (r for r in rows if r[0] in cuts and r[0] != i):
            sx, sy, qx, qy = u2 - u1, v2 - v1, u1 - x1, v1 - y1
            cross, aside = rx * sy - ry * sx, qx * ry - qy * rx
            if cross:
                found = [(qx * sy - qy * sx) / cross] if -1e-9 <= aside / cross <= 1 + 1e-9 else []
            else:
                found = [((x - x1) * rx + (y - y1) * ry) / (rx * rx + ry * ry) for x, y in ((u1, v1), (u2, v2))] if aside == 0 and rx * rx + ry * ry else []
            cuts[i] |= {int(np.floor(t * 1e9 + 0.5)) for t in found if 1e-9 <= t <= 1 - 1e-9}
    return cuts


@pytest.mark.parametrize("leaf", [8, 1024])
@pytest.mark.parametrize("whole", [False, True])
def test_cells_find_every_cut_once(spark, monkeypatch, leaf, whole):
    rows = _drawn(3, 120, 6.0, whole)
    want = {k: v for k, v in _plain(rows).items() if v}
    lines = spark.createDataFrame(rows, SCHEMA)
    task = lambda cell, margin: (lambda key, table: setattr(C, "LEAF", leaf) or C.cuts_of_cell(cell, margin)(key, table))
    monkeypatch.setattr(G, "cuts_of_cell", task)
    for cell in (0.7, 4.0, 3000.0):
        found = L.cuts_of(lines, cell).collect()
        listed = Counter((r["line_id"], t) for r in found for t in r["at"])
        assert set(listed.values()) == {1} and set(listed) == {(k, t) for k, v in want.items() for t in v}


@pytest.mark.parametrize("whole", [False, True])
def test_reach_by_cells_is_that_of_the_pieces(spark, whole):
    lines = spark.createDataFrame(_drawn(5, 90, 16.0, whole), SCHEMA)
    own = lines.dropna()
    keyed = G.noded(lines, 4.0).select("line_id", G.node_key(F.col("x1"), F.col("y1")).alias("a"), G.node_key(F.col("x2"), F.col("y2")).alias("b")).collect()
    of = {}
    for _ in range(len(keyed)):
        before = dict(of)
        for r in keyed:
            low = min(of.get(k, r["line_id"]) for k in (r["a"], r["b"], ("line", r["line_id"])))
            of[r["a"]] = of[r["b"]] = of["line", r["line_id"]] = low
        if of == before:
            break
    want = {k[1]: v for k, v in of.items() if isinstance(k, tuple)}
    links = N.checkpointed(G.meeting(lines, 4.0))
    found = N.components(own.select(F.col("line_id").alias("node")), links)
    assert {r["node"]: r["component"] for r in found.collect()} == want and len(set(want.values())) > 3
    # what leaves the cells grows with the lines there, not with their cuts
    assert links.count() < G.cells_of(lines, 4.0).count()


def test_pieces_carry_columns_and_need_no_kept_ones(spark):
    lines = spark.createDataFrame(_drawn(7, 60, 5.0, True), SCHEMA).withColumn("label", F.col("line_id") % 4)
    before, added = lines.where("label <> 3"), lines.where("label = 3")
    cuts = N.checkpointed(L.cuts_of(before, 4.0))
    rows = lambda t: sorted((r["line_id"], r["piece"], r["label"], *(round(r[c], 7) for c in ("x1", "y1", "x2", "y2"))) for r in t.dropna().collect())
    want = rows(G.noded(lines, 4.0, ("label",)))
    pieces = G.split_at(before, cuts, ("label",))
    assert want == rows(L.renoded(before, cuts, None, added, 4.0, ("label",))[1]) == rows(L.renoded(before, cuts, pieces, added, 4.0, ("label",))[1])
