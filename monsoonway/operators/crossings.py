"""What one task does for one square cell of a plane: where the lines that pass it cut each other, and which of them meet.

A cell owns the points whose five-decimal coordinates lie in it, so each cut, and each point that lines share, is found in one cell alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .network import _tied

#: Cuts this close to an end of a line, as a share of its length, are that end.
END = 1e-9
#: Places along a line are whole billionths of it; points are told apart in units of 1 / GRID.
WHOLE, GRID = 1_000_000_000, 100_000
#: Lines from which a cell is quartered within its task, how often at most, and pairs of lines compared at once.
LEAF, DEEP, AT_ONCE = 1024, 6, 250_000


def _whole(v: np.ndarray) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    low = np.floor(np.abs(v))
    return np.copysign(low + (np.abs(v) - low >= 0.5), v).astype(np.int64)


def _within(px: np.ndarray, py: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    return (box[0] <= px) & (px < box[2]) & (box[1] <= py) & (py < box[3])


def _ordered(px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """An order in which equal points lie together."""
    if len(px) and (int(np.ptp(px)) + 1) * (wide := int(np.ptp(py)) + 1) < 2**62:
        return np.argsort((px - px.min()) * wide + (py - py.min()))
    return np.lexsort((py, px))


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different lines below ``n`` that tie what the pairs (a, b) tie, at most one a line."""
    if n <= 4 * LEAF:  # a square of the lines is small, and tells repeated pairs without an order
        square = np.zeros((n, n), bool)
        square[a, b] = True
        a, b = np.nonzero(square)
    low, high = (c.to_numpy() for c in _tied(pa.table([a, b], names=["a", "b"])).columns)
    return low[low != high], high[low != high]


class _Lines:
    """Lines that differ, some of them marked as fresh; old ones cut each other no more."""

    def __init__(self, ends: np.ndarray, fresh: np.ndarray):
        self.x, self.y = ends[:, 0], ends[:, 1]
        self.rx, self.ry = ends[:, 2] - self.x, ends[:, 3] - self.y
        self.fresh = fresh

    def points(self, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = at / WHOLE
        return _whole((self.x[line] + t * self.rx[line]) * GRID), _whole((self.y[line] + t * self.ry[line]) * GRID)

    def boxes(self, box: tuple[float, float, float, float], margin: float) -> Iterator[tuple[np.ndarray, tuple[float, float, float, float]]]:
        """The box (west, south, east, north; in units of the grid) with its lines, or crowded ones in quarters, which only bounds what is held at once."""
        open_ = [(np.arange(len(self.x)), box, 0)]
        while open_:
            own, (west, south, east, north), deep = open_.pop()
            if len(own) > LEAF and deep < DEEP:
                mx, my = (west + east) / 2, (south + north) / 2
                quarters = [(w, s, e, n) for w, e in ((west, mx), (mx, east)) for s, n in ((south, my), (my, north))]
                parts = [own[self._pass(own, q, margin)] for q in quarters]
                # where nearly all lines lie together, quarters would repeat the work
                if max(map(len, parts)) < 0.9 * len(own):
                    open_ += [(p, q, deep + 1) for p, q in zip(parts, quarters) if len(p)]
                    continue
            yield own, (west, south, east, north)

    def _pass(self, own: np.ndarray, box: tuple[float, float, float, float], margin: float) -> np.ndarray:
        west, south, east, north = (v / GRID for v in box)
        cx, cy, hx, hy = (west + east) / 2, (south + north) / 2, (east - west) / 2 + margin, (north - south) / 2 + margin
        qx, qy, rx, ry = cx - self.x[own], cy - self.y[own], self.rx[own], self.ry[own]
        beside = (np.abs(qx - rx / 2) <= np.abs(rx) / 2 + hx) & (np.abs(qy - ry / 2) <= np.abs(ry) / 2 + hy)
        return beside & (np.abs(qx * ry - qy * rx) <= hx * np.abs(ry) + hy * np.abs(rx))

    def cuts(self, own: np.ndarray, box: tuple[float, float, float, float]) -> Iterator[tuple[np.ndarray, ...]]:
        """Lines, places and points (line, at, px, py) at which the lines ``own`` are cut within the box, some of them repeated; a crossing, a touching end and both ends of an overlap cut."""
        fresh = self.fresh[own]
        for p, q in ((own[fresh], own), (own[~fresh], own[fresh])):
            step = max(1, AT_ONCE // max(len(q), 1))
            for i in range(0, len(p) if len(q) else 0, step):
                row, t = self._met(p[i : i + step], q)
                line, at = p[i : i + step][row], np.floor(t * WHOLE + 0.5).astype(np.int64)
                px, py = self.points(line, at)
                here = np.flatnonzero(_within(px, py, box))
                yield line[here], at[here], px[here], py[here]

    def _met(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of lines in ``p`` and the places, as shares, where lines ``q`` meet them."""
        rx, ry, sx, sy = self.rx[p, None], self.ry[p, None], self.rx[q], self.ry[q]
        qx, qy = self.x[q] - self.x[p, None], self.y[q] - self.y[p, None]
        cross, aside = rx * sy - ry * sx, qx * ry - qy * rx
        with np.errstate(all="ignore"):
            t, u = (qx * sy - qy * sx) / cross, aside / cross
        hit = (cross != 0) & (u >= -END) & (u <= 1 + END) & (t >= END) & (t <= 1 - END)
        lines, places = [np.nonzero(hit)[0]], [t[hit]]
        row, b = np.nonzero((cross == 0) & (aside == 0))
        a, b = p[row], q[b]
        for ex, ey in ((self.x[b], self.y[b]), (self.x[b] + self.rx[b], self.y[b] + self.ry[b])):
            with np.errstate(all="ignore"):
                along = ((ex - self.x[a]) * self.rx[a] + (ey - self.y[a]) * self.ry[a]) / (self.rx[a] * self.rx[a] + self.ry[a] * self.ry[a])
            within = (along >= END) & (along <= 1 - END)
            lines.append(row[within])
            places.append(along[within])
        return np.concatenate(lines), np.concatenate(places)


def _read(key: tuple, table: pa.Table, cell: float):
    """The lines of a cell that differ, their ids in their order with where each line's begin, and the box of the cell."""
    ids, fresh = table.column("line_id").to_numpy(), table.column("fresh").to_numpy()
    ends = np.column_stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
    own, of = np.unique(np.column_stack([ends, fresh]), axis=0, return_inverse=True)
    of = of.ravel()
    ids, start = ids[np.argsort(of, kind="stable")], np.searchsorted(np.sort(of), np.arange(len(own) + 1))
    cx, cy = (k.as_py() for k in key)
    return _Lines(own[:, :4], own[:, 4] != 0), ids, start, (cx * cell * GRID, cy * cell * GRID, (cx + 1) * cell * GRID, (cy + 1) * cell * GRID)


def cuts_of_cell(cell: float, margin: float):
    """Rows (line_id, at) of a cell's lines (line_id, x1, y1, x2, y2, fresh): the places in billionths where each is cut there by others, of which one is fresh."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lines, ids, start, box = _read(key, table, cell)
        kind = table.schema.field("line_id").type
        out = [pa.table([pa.array([], kind), pa.array([], pa.list_(pa.int32()))], names=["line_id", "at"])]
        for own, part in lines.boxes(box, margin):
            codes = np.sort(np.concatenate([np.zeros(0, np.int64), *(line * (WHOLE + 1) + at for line, at, _, _ in lines.cuts(own, part))]))
            line, at = np.divmod(codes[np.append(True, codes[1:] != codes[:-1])[: len(codes)]], WHOLE + 1)
            cut, first = np.unique(line, return_index=True)
            each = pa.ListArray.from_arrays(pa.array(np.append(first, len(line)), pa.int32()), pa.array(at, pa.int32()))
            # copies of a line are cut where it is
            many = start[cut + 1] - start[cut]
            copy = np.repeat(np.arange(len(cut)), many)
            back = np.arange(len(copy)) - np.repeat(np.cumsum(many) - many, many)
            out.append(pa.table([pa.array(ids[start[cut][copy] + back], kind), each if len(copy) == len(cut) else each.take(pa.array(copy))], names=["line_id", "at"]))
        return pa.concat_tables(out)

    return run


def met_in_cell(cell: float, margin: float):
    """Rows (a, b): pairs of a cell's lines that tie all of those that share an end or a cut there, fewer than there are lines."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lines, ids, start, box = _read(key, table, cell)
        ties, number = [(np.zeros(0, np.int64),) * 2], np.zeros(len(start) - 1, np.int64)
        for own, part in lines.boxes(box, margin):
            both = np.concatenate([own, own])
            ends = lines.points(both, np.repeat([0, WHOLE], len(own)))
            here = _within(*ends, part)
            found = [(both[here], ends[0][here], ends[1][here]), *((line, px, py) for line, _, px, py in lines.cuts(own, part))]
            line, px, py = map(np.concatenate, zip(*found))
            order = _ordered(px, py)
            number[own] = np.arange(len(own))
            line, px, py = number[line[order]], px[order], py[order]
            same = (px[1:] == px[:-1]) & (py[1:] == py[:-1])
            a, b = _joined(line[1:][same], line[:-1][same], len(own))
            ties.append((own[a], own[b]))
        a, b = _joined(*map(np.concatenate, zip(*ties)), len(start) - 1)
        # copies of a line share its ends
        copies = np.delete(np.arange(len(ids)), start[:-1])
        lead = ids[start[:-1]]
        pairs = np.concatenate([lead[a], ids[copies]]), np.concatenate([lead[b], lead[np.searchsorted(start, copies, side="right") - 1]])
        return pa.table([pa.array(v, table.schema.field("line_id").type) for v in pairs], names=["a", "b"])

    return run
