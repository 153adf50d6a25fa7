"""Lines added to a network that is noded already: only lines near them are compared again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import ENDS, cells_of, cuts_within, near_lines, split_at
from .network import checkpointed


def cuts_of(lines: DataFrame, cell: float) -> DataFrame:
    """Rows (line_id, at): where the lines (line_id, x1, y1, x2, y2) cut each other, as ``cuts_within`` gives them. What a network keeps beside its pieces, for lines to come."""
    return cuts_within(cells_of(lines, cell), cell)


def renoded(lines: DataFrame, cuts: DataFrame, pieces: DataFrame | None, added: DataFrame, cell: float, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The cuts and pieces of all lines together, from ``lines`` with their ``cuts_of`` and pieces, and lines (line_id, ...) that come to them.

    Only lines that share a cell with an added line are compared, with the added ones alone, and only lines that one cuts are split again; the pieces of all others
    are passed on. Without ``pieces`` (none were kept) all are split from the cuts, which are kept. Pieces carry the columns ``keep`` of their line.
    Ids of added lines are new. Added lines are cut among each other, too. Cuts are places along the whole line, so the result is that of
    noding everything at once.
    """
    lines = lines.select("line_id", *keep, *ENDS)
    added = checkpointed(added.select(*lines.columns).dropna(subset=["line_id", *ENDS]))
    new_cells = checkpointed(cells_of(added, cell))
    near = cells_of(lines, cell, fresh=False).join(new_cells.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    fresh = checkpointed(cuts_within(near.select(*new_cells.columns).unionByName(new_cells), cell))
    every = cuts.select("line_id", "at").unionByName(fresh)
    if pieces is None:
        return every, split_at(lines.unionByName(added), every, keep)
    moved = checkpointed(fresh.select("line_id").unionByName(added.select("line_id")).distinct())
    again = lines.dropna(subset=["line_id", *ENDS]).unionByName(added).join(moved, "line_id", "left_semi")
    split = split_at(again, every.join(moved, "line_id", "left_semi"), keep)
    return every, pieces.select("line_id", "piece", *keep, *ENDS).join(moved, "line_id", "left_anti").unionByName(split)


def parents(pieces: DataFrame, lines: DataFrame, reach: float, tolerance: float) -> DataFrame:
    """Rows (line_id, piece, parent, covered): the line (line_id, ...) that each piece lies on, else the nearest one within ``reach`` of its middle; null beyond.

    A piece lies on a line if its middle does, to ``tolerance``; of several the smallest id counts, of nearest ones as well.
    """
    key = F.struct("line_id", "piece")
    middle = pieces.select(key.alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    near = near_lines(middle, lines, reach).withColumn("on", F.col("d2") <= tolerance * tolerance)
    best = near.groupBy("point_id").agg(F.min(F.struct((~F.col("on")).alias("off"), F.when(F.col("on"), F.lit(0.0)).otherwise(F.col("d2")).alias("d2"), "line_id")).alias("m"))
    found = pieces.select(key.alias("point_id")).join(best, "point_id", "left")
    return found.select("point_id.line_id", "point_id.piece", F.col("m.line_id").alias("parent"), F.coalesce(~F.col("m.off"), F.lit(False)).alias("covered"))
