"""Areas with holes as a table of rings, and the points that lie in them, by a cell index.

``rings(area, ring, xs, ys)`` hold the corners of closed rings in order, the first not repeated; all rings of an area count together by the even-odd rule,
so an area may have holes and several parts. The index has square cells. Those that a boundary passes carry its
sides there and whether their centre lies inside; a point in one is decided by the sides between it and the centre, which are that cell's own. Runs of cells
between boundaries lie wholly inside or outside; those inside are stored as aligned blocks of 2 ** level cells,
so a wide area costs a few rows for each row of cells, and points in them are decided without any test. A corner or side belongs to the
area on its lower left, as with a ray to the right that takes half-open sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import covered
from .network import checkpointed


def rings_of(areas: DataFrame, area: str, wkt: str) -> DataFrame:
    """Rings of ``POLYGON`` and ``MULTIPOLYGON`` texts; rows without a readable text give none. A closing corner is left out."""
    bodies = areas.select(F.col(area).alias("area"), F.posexplode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), 1)).alias("ring", "body"))
    corners = F.transform(F.split(F.trim("body"), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    axis = lambda i: F.transform("corners", lambda p: F.element_at(p, i).cast("double"))
    found = bodies.select("area", "ring", corners.alias("corners")).select("area", "ring", axis(1).alias("xs"), axis(2).alias("ys"))
    closed = (F.element_at("xs", 1) == F.element_at("xs", -1)) & (F.element_at("ys", 1) == F.element_at("ys", -1)) & (F.size("xs") > 1)
    n = F.size("xs") - F.when(closed, 1).otherwise(0)
    return found.select("area", "ring", F.slice("xs", F.lit(1), n).alias("xs"), F.slice("ys", F.lit(1), n).alias("ys"))


def wkt_of(rings: DataFrame) -> DataFrame:
    """Rows (area, wkt): the rings of an area as one ``POLYGON`` text, closed."""
    closed = lambda c: F.concat(c, F.slice(c, 1, 1))
    body = F.concat(F.lit("("), F.array_join(F.zip_with(closed("xs"), closed("ys"), lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))), ", "), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("ring", body.alias("body"))))
    return rings.groupBy("area").agg(ordered.alias("r")).select("area", F.concat(F.lit("POLYGON ("), F.array_join("r.body", ", "), F.lit(")")).alias("wkt"))


def sides_of(rings: DataFrame) -> DataFrame:
    """Rows (area, x1, y1, x2, y2): every side of every ring; rings with a null corner or fewer than three give none."""
    whole = rings.where("size(xs) >= 3 and size(xs) = size(ys) and not exists(xs, x -> x is null) and not exists(ys, y -> y is null)")
    turned = lambda c: F.concat(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, 1, 1))
    return whole.select("area", F.explode(F.arrays_zip(F.col("xs").alias("x1"), F.col("ys").alias("y1"), turned("xs").alias("x2"), turned("ys").alias("y2"))).alias("s")).select("area", "s.*")


def _crossings(sides: DataFrame, cell: float) -> DataFrame:
    """Rows (area, cy, x): where sides cross the middle line of each row of cells."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.floor(low / cell - 0.5), F.floor(high / cell + 0.5))
    y = (F.col("cy") + 0.5) * cell
    met = sides.withColumn("cy", F.explode(rows)).where((F.col("y1") > y) != (F.col("y2") > y))
    return met.select("area", "cy", ((y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))


def cell_index(rings: DataFrame, cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundary cells (area, cx, cy, inside: of the centre), their sides, and inner blocks (area, cy, level, block) of 2 ** level cells in a row."""
    sides = checkpointed(sides_of(rings))
    middle = (F.col("cx") + 0.5) * cell
    crossed = _crossings(sides, cell).withColumn("cx", F.floor(F.col("x") / cell))
    counts = crossed.groupBy("area", "cx", "cy").agg(F.count("*").alias("all"), F.count(F.when(F.col("x") > middle, 1)).alias("beyond"))
    held = checkpointed(covered(sides, cell))
    none = F.lit(0).cast("long")
    both = counts.unionByName(held.select("area", "cx", "cy", none.alias("all"), none.alias("beyond"))).groupBy("area", "cx", "cy").agg(F.sum("all").alias("all"), F.sum("beyond").alias("beyond"))
    row = Window.partitionBy("area", "cy").orderBy("cx")
    right = F.coalesce(F.sum("all").over(row.rowsBetween(1, Window.unboundedFollowing)), none)
    edges = checkpointed(both.withColumn("right", right).withColumn("next", F.lead("cx").over(row)))
    boundary = edges.select("area", "cx", "cy", ((F.col("right") + F.col("beyond")) % 2 == 1).alias("inside"))
    runs = edges.where("right % 2 = 1 and next > cx + 1").select("area", "cy", (F.col("cx") + 1).alias("first"), (F.col("next") - 1).alias("last"))
    return boundary, held, _blocks(runs)


def _blocks(runs: DataFrame) -> DataFrame:
    """Runs of cells cut into aligned blocks: at each level at most one at either end, as in a binary tree over the cells."""
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2((F.col("last") - F.col("first") + 1).cast("double"))).cast("int") + 1))
    at = runs.withColumn("level", F.explode(levels))
    # cells still open at a level, as half-open blocks of that level
    first, last = F.expr("-shiftright(-first, level)"), F.expr("shiftright(last + 1, level)")
    own = at.select("area", "cy", "level", first.alias("f"), last.alias("t")).where("f < t")
    # a block is taken at its level unless the one twice as wide that holds it lies in the run too
    ends = F.array_compact(F.array(F.when(F.col("f") % 2 != 0, F.col("f")), F.when((F.col("t") % 2 != 0), F.col("t") - 1)))
    return own.select("area", "cy", "level", F.explode(F.array_distinct(ends)).alias("block"))


def located(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """Rows (id, area) of the points (id, x, y) that lie in an area, one for each area that holds it; points without coordinates in none.

    Repeated rows of ``points`` count once. A point meets the sides of its own cell only, so ``cell`` is to be small enough that few sides share one.
    """
    boundary, held, inner = cell_index(rings, cell)
    inner = checkpointed(inner)
    levels = sorted(r["level"] for r in inner.select("level").distinct().collect())  # as many as a row of cells can be halved
    placed = points.select("id", "x", "y").dropna().distinct().withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    mx, my = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    near = placed.join(boundary, ["cx", "cy"]).join(held, ["area", "cx", "cy"], "left")
    # from the centre upright to the height of the point, then along to it: each leg turns inside to outside at every side it meets
    up = ((F.col("x1") > mx) != (F.col("x2") > mx)) & (_meets("x", "y", mx, my) != _meets("x", "y", mx, F.col("y")))
    along = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (_meets("y", "x", F.col("y"), mx) != _meets("y", "x", F.col("y"), F.col("x")))
    turns = F.count(F.when(up, 1)) + F.count(F.when(along, 1))
    decided = near.groupBy("id", "x", "y", "area", "inside").agg(turns.alias("turns")).where("inside <> (turns % 2 = 1)").select("id", "area")
    if not levels:
        return decided
    spread = placed.select("id", "cx", "cy", F.explode(F.array(*map(F.lit, levels))).alias("level")).select("id", "cy", "level", F.expr("shiftright(cx, level)").alias("block"))
    return decided.unionByName(spread.join(inner, ["cy", "level", "block"]).select("id", "area"))


def _meets(along: str, across: str, at: Column, limit: Column) -> Column:
    """Whether a side lies beyond ``limit`` where it passes ``at``."""
    a1, a2, c1, c2 = (F.col(f"{c}{i}") for c in (along, across) for i in (1, 2))
    return (at - a1) * (c2 - c1) / F.nullif(a2 - a1, F.lit(0.0)) + c1 > limit


def greatest_within(points: DataFrame, rings: DataFrame, values: DataFrame, cell: float) -> DataFrame:
    """Rows (id, n, most) for every point: how many areas hold it, and the greatest of their ``values(area, value)``, null outside all."""
    held = located(points, rings, cell).join(values, "area").groupBy("id").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return points.select("id").join(held, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "most")


def representative_points(rings: DataFrame) -> DataFrame:
    """Rows (area, x, y): a point inside each area, amid the widest stretch of it on the line half way up its widest ring; areas without a height have none.

    If a corner lies just on that line the half-open rule still pairs the crossings.
    """
    sides = checkpointed(sides_of(rings))
    spans = rings.select("area", "ring", F.array_min("ys").alias("low"), F.array_max("ys").alias("high"), ((F.array_max("xs") - F.array_min("xs")) * (F.array_max("ys") - F.array_min("ys"))).alias("box"))
    tall = spans.groupBy("area").agg(F.max(F.struct("box", (-F.col("ring")).alias("ring"), ((F.col("low") + F.col("high")) / 2).alias("y"))).alias("m")).select("area", "m.y")
    met = sides.join(tall, "area").where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    met = met.select("area", "y", ((F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    row = Window.partitionBy("area").orderBy("x")
    spans = met.withColumn("k", F.row_number().over(row)).withColumn("to", F.lead("x").over(row)).where("k % 2 = 1")
    widest = spans.groupBy("area").agg(F.max(F.struct((F.col("to") - F.col("x")).alias("wide"), (-F.col("x")).alias("left"), "x", "to", "y")).alias("m"))
    return widest.select("area", ((F.col("m.x") + F.col("m.to")) / 2).alias("x"), F.col("m.y").alias("y"))


def box_of(rings: DataFrame, pad: float = 0.0) -> tuple[float, float, float, float] | None:
    """West, south, east and north of all rings, ``pad`` further out; None without rings."""
    least, most = (lambda c: F.min(F.array_min(c))), (lambda c: F.max(F.array_max(c)))
    found = rings.agg(least("xs"), least("ys"), most("xs"), most("ys")).first()
    return None if found[0] is None else (found[0] - pad, found[1] - pad, found[2] + pad, found[3] + pad)


def top_cells(cells: DataFrame, rings: DataFrame, n: int, cell: float) -> DataFrame:
    """Rows (area, rank, row, col, x, y, value): the ``n`` greatest positive of ``cells(row, col, x, y, value)`` whose centre lies in each area.

    Ties go to the smaller row, then column; rows and columns tell cells apart.
    """
    own = checkpointed(cells.where("value > 0").withColumn("id", F.struct("row", "col")))
    inside = located(own.select("id", "x", "y"), rings, cell).join(own, "id")
    rank = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("value"), "row", "col")).cast("long")
    return inside.withColumn("rank", rank).where(F.col("rank") <= n).select("area", "rank", "row", "col", "x", "y", "value")
