"""Routing, noding, bridging, hazard and production analytics, each with the SQL that gives the same rows where SQL can.

Stand-ins, besides those of ``queries`` and ``accessibility``: a line starts at an embedding's point and runs along its next
two components; suppliers of the highest balance in a nation are its hub; an event's value over 1,000 is a flood depth in
metres, its value and id give wind components, and its user's number the direction of a road.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import geometry as G
from ..operators import network as N
from ..operators import ranks as K
from ..operators import relational as R
from ..operators import statistics as S
from ..sources import tables as T
from . import accessibility as A
from . import queries as Q

LINE_CELL, MISSING_REACH, BRIDGE_REACH, FIRST_REACH = 4.0, 2.0, 3.0, 1.0
CONNECTOR_KMH = 15.0
PRODUCTION_REGION = 0
STATION_BOX, STATION_FROM, STATION_TO, MOST_STATIONS = (-10.0, -10.0, 20.0, 20.0), "2024-01-05", "2024-01-12", 12


def surface_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of five tags that names a surface."""
    tags = [F.when(F.col("p_size") % m == 0, F.lit(word)) for m, word in ((7, "gravel"), (5, "PAVED"), (3, "unpaved"), (11, "Paved"), (2, "dirt"))]
    return Q._t(spark, sf_dir, "part").select("p_partkey", X.surface_group(*tags).alias("surface"))


def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = R.top_per_group(Q._t(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc_nulls_last("s_acctbal"), F.col("s_suppkey")], 1)
    return first.select(F.col("s_suppkey").alias("hub"))


def _hub_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip from each hub to those of lower numbers: one hub a nation, so both sides hold 25 rows at any scale."""
    hubs = _hubs(spark, sf_dir)
    return hubs.select(F.col("hub").alias("origin")).join(F.broadcast(hubs.select(F.col("hub").alias("dest"))), F.col("dest") < F.col("origin"))


def route_status(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    trips = _hub_trips(spark, sf_dir)
    costs = N.shortest_costs(trips.select("origin").distinct(), graph(spark, sf_dir)).select("origin", F.col("node").alias("dest"), "cost")
    return trips.join(costs, ["origin", "dest"], "left").select("origin", "dest", "cost", F.when(F.col("cost").isNull(), "unreachable").otherwise("ok").alias("status"))


def route_steps(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    trips, edges = _hub_trips(spark, sf_dir), N.checkpointed(graph(spark, sf_dir))
    costs = N.checkpointed(N.shortest_costs(trips.select("origin").distinct(), edges))
    return N.route_steps(trips, costs, edges)


def route_usage(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    """Steps and routes over each edge that a hub's route takes."""
    steps = route_steps(spark, sf_dir, graph)
    return steps.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("steps"), F.count_distinct("origin", "dest").alias("routes"))


def link_length_stats(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    """Length figures of the edges at each supplier."""
    edges = graph(spark, sf_dir)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "w")
    return ends.groupBy("node").agg(F.count("*").alias("links"), F.max("w").alias("longest"), F.round(F.percentile("w", F.lit(0.95)), 6).alias("p95"), F.count(F.when(F.col("w") > 25, 1)).alias("over_25"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda i: F.col("embedding")[i].cast("double")
    rows = Q._t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), "label", (c(0) * 100).alias("x1"), (c(1) * 100).alias("y1"), (c(2) * 20).alias("dx"), (c(3) * 20).alias("dy"))
    return rows.select("line_id", "label", "x1", "y1", (F.col("x1") + F.col("dx")).alias("x2"), (F.col("y1") + F.col("dy")).alias("y2"))


def noded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of lines cut at their crossings, with the label of their line."""
    lines = _lines(spark, sf_dir)
    return G.noded(lines, LINE_CELL, ("label",)).select("line_id", "piece", "label", *(Q._r(c, 5) for c in ("x1", "y1", "x2", "y2")))


def noding_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the component of each line before and after noding."""
    def sizes(links: DataFrame, name: str) -> DataFrame:
        found = N.components(own.select(F.col("line_id").alias("node")), links)
        return found.join(found.groupBy("component").agg(F.count("*").alias(name)), "component").select(F.col("node").alias("line_id"), name)

    lines = _lines(spark, sf_dir)
    own = N.checkpointed(lines.select("line_id", *G.ENDS).dropna())
    ends = own.select("line_id", F.explode(F.array(G.node_key(F.col("x1"), F.col("y1")), G.node_key(F.col("x2"), F.col("y2")))).alias("key"))
    first = ends.groupBy("key").agg(F.min("line_id").alias("b"))
    shared = ends.join(first, "key").select(F.col("line_id").alias("a"), "b")
    return sizes(shared, "lines_before").join(sizes(G.meeting(own, LINE_CELL), "lines_after"), "line_id")


def missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of odd labels whose middle lies further than MISSING_REACH from every line of an even label."""
    lines = _lines(spark, sf_dir)
    middle = lines.where("label % 2 = 1").select(F.col("line_id").alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    close = G.near_lines(middle, lines.where("label % 2 = 0"), MISSING_REACH)
    return middle.join(close, "point_id", "left_anti").select(F.col("point_id").alias("line_id"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A._points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y", F.col("label").cast("long").alias("component"))


def bridge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors of components to better ranked ones as edges whose ids follow the nodes'."""
    nodes = _nodes(spark, sf_dir)
    top = nodes.agg(F.max("id").alias("top"))
    length = F.round(F.sqrt("d2"), 6)
    found = G.bridges_to_better(nodes, BRIDGE_REACH).crossJoin(F.broadcast(top))  # one row
    return found.select((F.col("top") + 1 + F.col("component")).alias("link_id"), "component", "source", "target", length.alias("length"), F.round(length / CONNECTOR_KMH, 6).alias("cost"), F.lit("component_connector").alias("kind"))


def origin_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest node of label 0 to each node of labels 5 and above, however far."""
    nodes = _nodes(spark, sf_dir)
    found = G.nearest(nodes.where("component >= 5"), nodes.where("component = 0"), FIRST_REACH)
    return found.select(F.col("id").alias("origin"), "target", F.round(F.sqrt("d2"), 6).alias("length"))


def component_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest links that join all labels; an iteration, so without SQL."""
    return G.linking_forest(_nodes(spark, sf_dir), FIRST_REACH).select("a", "b", F.round(F.sqrt("d2"), 6).alias("length"))


def wind_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind speed and the largest crosswind of a road each week."""
    rows = Q._t(spark, sf_dir, "events").select("user_id", X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR).alias("week_start"), (F.col("value") / 10).alias("u"), (F.col("event_id") % 7 - 3).cast("double").alias("v"),
                                                (F.col("user_id") % 5 - 2).cast("double").alias("dx"), (F.col("user_id") % 3 - 1).cast("double").alias("dy"))
    ux, uy = X.unit_vector(F.col("dx"), F.col("dy"))
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    across = X.crosswind(F.col("u"), F.col("v"), ux, uy)
    return rows.groupBy("user_id", "week_start").agg(F.round(F.avg(speed), 6).alias("mean_speed"), F.round(F.max(speed), 6).alias("max_speed"), F.round(F.max(across), 6).alias("max_crosswind"))


def flood_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest depth of each week with its severity and effect; weeks without a reading have none."""
    rows = Q._t(spark, sf_dir, "events").select("user_id", X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR).alias("week_start"), F.when(F.col("event_type") != "click", F.col("value") / 1000).alias("depth"))
    weekly = rows.groupBy("user_id", "week_start").agg(F.max("depth").alias("depth"))
    level = X.severity(F.col("depth"), X.FLOOD_METRES)
    effect = lambda i: F.coalesce(*(F.when(level == name, values[i]) for name, values in X.SEVERITY_EFFECTS.items()))
    return weekly.select("user_id", "week_start", Q._r("depth"), F.col("depth").isNotNull().cast("int").alias("has_data"), level.alias("severity"), effect(0).cast("double").alias("penalty"), effect(1).cast("long").alias("closed_days"))


def _produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Q._t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("tonnes"))
    made = lines.join(Q._t(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(Q._t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return made.groupBy(F.col("p_type").alias("product"), F.col("s_nationkey").alias("nation")).agg(F.sum("tonnes").alias("tonnes"))


def production_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected nations' share of each product's total, and of all products'."""
    nations = Q._t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") == PRODUCTION_REGION).alias("chosen"))
    rows = _produced(spark, sf_dir).join(nations, "nation")
    found = rows.rollup("product").agg(F.sum("tonnes").alias("world"), F.coalesce(F.sum(F.when(F.col("chosen"), F.col("tonnes"))), F.lit(0.0)).alias("selected"), F.grouping("product").alias("g"))
    return found.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("product")).alias("product"), "world", "selected", F.round(100 * F.col("selected") / F.nullif(F.col("world"), F.lit(0.0)), 6).alias("share_pct"))


def production_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonnes and share of every pair of a product and a selected nation, 0 where it makes none."""
    made = _produced(spark, sf_dir)
    world = made.groupBy("product").agg(F.sum("tonnes").alias("world"))
    chosen = Q._t(spark, sf_dir, "nation").where(F.col("n_regionkey") == PRODUCTION_REGION).select(F.col("n_nationkey").alias("nation"))
    every = world.crossJoin(F.broadcast(chosen))  # products by the nations of one region
    found = every.join(made, ["product", "nation"], "left").withColumn("tonnes", F.coalesce("tonnes", F.lit(0.0)))
    return found.select("product", "nation", "tonnes", F.round(100 * F.col("tonnes") / F.nullif(F.col("world"), F.lit(0.0)), 6).alias("share_pct"))


def wettest_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week of June to August with the largest median rain in each nation, and its damaged roads."""
    rain = Q._road_weeks(spark, sf_dir).where(F.month("week_start").between(6, 8)).join(Q._t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    by = ["s_nationkey", "week_start"]
    counts = K.running(K.counted(rain.withColumn("mm", F.col("l_quantity") * 7), by, "mm"), by, "mm")
    weekly = counts.groupBy(*by).agg(*K.quantile_columns({"median": 0.5}, "mm"), F.sum(F.when(F.col("mm") >= 300, F.col("count")).otherwise(0)).alias("damaged")).select(*by, F.round("median", 6).alias("median_mm"), "damaged")
    return R.top_per_group(weekly, ["s_nationkey"], [F.desc("median_mm"), F.col("week_start")], 1).drop("rank")


def positive_delay_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, count and median of the positive delays of each week and destination type."""
    above = F.when(F.col("delta") > 0, F.col("delta"))
    cells = A._cells(spark, sf_dir).withColumn("v", F.round(above * 2000000))
    by = ["c_mktsegment", "week_start"]
    counts = cells.groupBy(*by, "v").agg(F.count("v").alias("count"), F.sum(F.round(F.greatest("delta", F.lit(0.0)) * 2000000).cast("long")).alias("whole"))
    found = K.running(counts, by, "v").groupBy(*by).agg((F.sum("whole") / 2000000).alias("total"), F.sum("count").alias("positive"), *K.quantile_columns({"m": 0.5}, "v"))
    return found.select(*by, "total", "positive", (F.col("m") / 2000000).alias("median_positive"))


def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden, affected weeks and peak of each country and type, scaled to 0 to 1 within the type; 0 where all agree."""
    by = Window.partitionBy("c_mktsegment")
    scaled = lambda c: F.round(F.coalesce((F.col(c) - F.min(c).over(by)) / F.nullif((F.max(c).over(by) - F.min(c).over(by)).cast("double"), F.lit(0.0)), F.lit(0.0)), 6).alias(c)
    return A.damage_matrix(spark, sf_dir).select("c_nationkey", "c_mktsegment", *map(scaled, ("burden", "affected_weeks", "peak")))


def route_surface_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface shares of orders whose totals count each order once."""
    long = Q._t(spark, sf_dir, "lineitem").select("l_orderkey", Q._surface().alias("surface"), "l_quantity").groupBy("l_orderkey", "surface").agg(F.sum("l_quantity").alias("km"))
    whole = long.groupBy("l_orderkey").agg(F.sum("km").alias("route_km"))
    per = long.groupBy("surface").agg(F.sum("km").alias("km"), F.count("*").alias("routes"))
    total = whole.agg(F.sum("route_km").alias("all_km"))
    return per.crossJoin(F.broadcast(total)).select("surface", "routes", "km", F.round(F.col("km") / F.nullif(F.col("all_km"), F.lit(0.0)), 6).alias("share"))  # one row


def ols_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity, discount and tax, each surface apart."""
    rows = Q._t(spark, sf_dir, "lineitem").withColumn("surface", Q._surface())
    fit = S.standardised_ols_of(rows, ["surface"], "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return fit.select("surface", "n", *(Q._r(c) for c in ("beta_1", "beta_2", "beta_3", "r_squared", "adjusted")))


def bootstrap_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws rest on a hash that SQL engines do not share, so without SQL."""
    rows = Q._t(spark, sf_dir, "lineitem").select(Q._surface().alias("surface"), F.xxhash64("l_orderkey", "l_linenumber").alias("id"), "l_extendedprice", "l_quantity", "l_discount")
    return S.bootstrap_coefficients(rows, ["surface"], "id", "l_extendedprice", "l_quantity", "l_discount", 50)


def tile_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-degree tiles over the extent of each label's points."""
    boxes = A._points(spark, sf_dir).groupBy("label").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
    return T.tiles_over(boxes).select("label", "tile")


def station_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of a box that were active in a period, the first by number."""
    active = Q._t(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("begin"), F.to_date(F.max("ts")).alias("end"))
    stations = active.join(A._points(spark, sf_dir), F.col("user_id") == F.col("vec_id")).select(F.col("user_id").alias("station_id"), F.col("x").alias("lon"), F.col("y").alias("lat"), "begin", "end", F.col("label").cast("string").alias("country"))
    return T.select_stations(stations, STATION_BOX, STATION_FROM, STATION_TO, MOST_STATIONS).select("station_id", "country")


QUERIES = {f.__name__: f for f in (
    surface_classify, route_status, route_steps, route_usage, link_length_stats, noded_pieces, noding_reach, missing_lines, bridge_links, origin_bridges, component_links, wind_week, flood_severity,
    production_shares, production_by_country, wettest_week, positive_delay_weeks, min_max_scaled, route_surface_share, ols_three, bootstrap_signs, tile_codes, station_selection)}

_HUBS = "h AS (SELECT s_suppkey AS hub FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS k FROM supplier) WHERE k = 1)"
_TRIPS = "trips AS (SELECT o.hub AS origin, d.hub AS dest FROM h o JOIN h d ON d.hub < o.hub)"
_COSTS = f"""WITH RECURSIVE {Q._EDGES}, {_HUBS}, {_TRIPS}, r(origin, node, cost) USING KEY (origin, node) AS (SELECT DISTINCT origin, origin, CAST(0 AS DOUBLE) FROM trips UNION SELECT r.origin, b.t, min(r.cost + b.w) FROM r JOIN b ON b.s = r.node
LEFT JOIN recurring.r old ON old.origin = r.origin AND old.node = b.t WHERE old.cost IS NULL OR r.cost + b.w < old.cost GROUP BY r.origin, b.t)"""
_WALK = _COSTS + """, prev AS (SELECT r.origin, r.node AS b, min(x.s) AS a, arg_min(x.w, x.s) AS w FROM r JOIN b x ON x.t = r.node JOIN r near ON near.origin = r.origin AND near.node = x.s WHERE near.cost + x.w = r.cost GROUP BY ALL),
walk(origin, dest, a, b, w, back) AS (SELECT t.origin, t.dest, p.a, p.b, p.w, 0 FROM trips t JOIN prev p ON p.origin = t.origin AND p.b = t.dest UNION ALL SELECT k.origin, k.dest, p.a, p.b, p.w, back + 1 FROM walk k JOIN prev p ON p.origin = k.origin AND p.b = k.a),
steps AS (SELECT origin, dest, CAST(max(back) OVER (PARTITION BY origin, dest) - back + 1 AS BIGINT) AS step, a, b, w FROM walk)"""
_LINES = """l AS (SELECT *, x1 + dx AS x2, y1 + dy AS y2 FROM (SELECT vec_id AS line_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x1, CAST(embedding[2] AS DOUBLE) * 100 AS y1, CAST(embedding[3] AS DOUBLE) * 20 AS dx, CAST(embedding[4] AS DOUBLE) * 20 AS dy FROM embeddings))"""
_PIECES = _LINES + """, m AS (SELECT p.line_id, (p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1) AS d, (q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1) AS tn, (q.x1 - p.x1) * (p.y2 - p.y1) - (q.y1 - p.y1) * (p.x2 - p.x1) AS un FROM l p JOIN l q ON p.line_id <> q.line_id),
cut AS (SELECT line_id, round(tn / d, 9) AS t FROM m WHERE d <> 0 AND un / d BETWEEN -1e-9 AND 1 + 1e-9 AND tn / d BETWEEN 1e-9 AND 1 - 1e-9 UNION SELECT line_id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM l),
span AS (SELECT * FROM (SELECT line_id, t, lead(t) OVER o AS u, row_number() OVER o - 1 AS piece FROM cut WINDOW o AS (PARTITION BY line_id ORDER BY t)) WHERE u IS NOT NULL),
piece AS (SELECT line_id, piece, label, l.x1 + t * (l.x2 - l.x1) AS x1, l.y1 + t * (l.y2 - l.y1) AS y1, l.x1 + u * (l.x2 - l.x1) AS x2, l.y1 + u * (l.y2 - l.y1) AS y2 FROM span JOIN l USING (line_id))"""
_KEY = "CAST(round({0}x{1} * 100000) AS BIGINT) * 1000000000 + CAST(round({0}y{1} * 100000) AS BIGINT)"
_NODES = "n AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(label AS BIGINT) AS component FROM embeddings)"
_MADE = "made AS (SELECT p_type AS product, s_nationkey AS nation, sum(l_quantity) AS tonnes FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
_SCALED = ", ".join(f"round(coalesce(({c} - min({c}) OVER g) / nullif(CAST(max({c}) OVER g - min({c}) OVER g AS DOUBLE), 0), 0), 6) AS {c}" for c in ("burden", "affected_weeks", "peak"))
_LEVEL = "CASE " + " ".join(f"WHEN depth >= {m} THEN '{name}'" for name, m in reversed(list(X.FLOOD_METRES.items()))) + " END"
_WEST, _SOUTH, _EAST, _NORTH = STATION_BOX
_DETERMINANT = "(1 + 2 * a * b * c - a * a - b * b - c * c)"

ORACLE_SQL = {
    "surface_classify": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'paved' WHEN p_size % 3 = 0 THEN 'unpaved' WHEN p_size % 11 = 0 THEN 'paved' ELSE 'unknown' END AS surface FROM part",
    "route_status": f"{_COSTS} SELECT t.origin, dest, cost, CASE WHEN cost IS NULL THEN 'unreachable' ELSE 'ok' END AS status FROM trips t LEFT JOIN r ON r.origin = t.origin AND r.node = dest",
    "route_steps": f"{_WALK} SELECT * FROM steps",
    "route_usage": f"{_WALK} SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS steps, count(DISTINCT (origin, dest)) AS routes FROM steps GROUP BY least(a, b), greatest(a, b)",
    "link_length_stats": f"WITH {Q._EDGES} SELECT s AS node, count(*) AS links, max(w) AS longest, round(quantile_cont(w, 0.95), 6) AS p95, count(*) FILTER (w > 25) AS over_25 FROM b GROUP BY ALL",
    "noded_pieces": f"WITH {_PIECES} SELECT line_id, piece, label, round(x1, 5) + 0.0 AS x1, round(y1, 5) + 0.0 AS y1, round(x2, 5) + 0.0 AS x2, round(y2, 5) + 0.0 AS y2 FROM piece",
    "noding_reach": f"""WITH RECURSIVE {_PIECES}, e AS (SELECT line_id, {_KEY.format('', 1)} AS s, {_KEY.format('', 2)} AS t FROM piece), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
r(node, c) USING KEY (node) AS (SELECT DISTINCT s, s FROM b UNION SELECT b.t, min(r.c) FROM r JOIN b ON b.s = r.node JOIN recurring.r old ON old.node = b.t WHERE r.c < old.c GROUP BY b.t),
k AS (SELECT DISTINCT line_id, c FROM e JOIN r ON r.node = e.s), z AS (SELECT c, count(*) AS lines_after FROM k GROUP BY ALL) SELECT line_id, CAST(1 AS BIGINT) AS lines_before, lines_after FROM k JOIN z USING (c)""",
    "missing_lines": f"WITH {_LINES}, c AS (SELECT line_id, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py FROM l WHERE label % 2 = 1) SELECT line_id FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE label % 2 = 0 AND {G.SEGMENT_D2.replace('0D', '0').replace('1D', '1')} <= {MISSING_REACH**2})",
    "bridge_links": f"""WITH {_NODES}, z AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM n GROUP BY component),
p AS (SELECT a.component, a.id AS source, b.id AS target, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS d2 FROM n a JOIN z za ON za.component = a.component JOIN z zb ON zb.rank < za.rank JOIN n b ON b.component = zb.component),
f AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY d2, source, target) AS k FROM p WHERE d2 > 0 AND d2 <= {BRIDGE_REACH**2})
SELECT (SELECT max(id) FROM n) + 1 + component AS link_id, component, source, target, round(sqrt(d2), 6) AS length, round(round(sqrt(d2), 6) / {CONNECTOR_KMH}, 6) AS cost, 'component_connector' AS kind FROM f WHERE k = 1""",
    "origin_bridges": f"WITH {_NODES}, f AS (SELECT a.id AS origin, b.id AS target, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS d2 FROM n a JOIN n b ON a.component >= 5 AND b.component = 0) SELECT origin, target, round(sqrt(d2), 6) AS length FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY d2, target) AS k FROM f) WHERE k = 1",
    "wind_week": f"""WITH w AS (SELECT user_id, {Q._SQL_EVENT_WEEK} AS week_start, value / 10 AS u, CAST(event_id % 7 - 3 AS DOUBLE) AS v, CAST(user_id % 5 - 2 AS DOUBLE) AS dx, CAST(user_id % 3 - 1 AS DOUBLE) AS dy FROM events),
d AS (SELECT *, coalesce(dx / nullif(sqrt(dx * dx + dy * dy), 0), 0) AS ux, coalesce(dy / nullif(sqrt(dx * dx + dy * dy), 0), 1) AS uy FROM w)
SELECT user_id, week_start, round(avg(sqrt(u * u + v * v)), 6) AS mean_speed, round(max(sqrt(u * u + v * v)), 6) AS max_speed, round(max(abs(v * ux - u * uy)), 6) AS max_crosswind FROM d GROUP BY ALL""",
    "flood_severity": f"""WITH w AS (SELECT user_id, {Q._SQL_EVENT_WEEK} AS week_start, max(value / 1000) FILTER (event_type <> 'click') AS depth FROM events GROUP BY ALL), s AS (SELECT *, {_LEVEL} AS severity FROM w)
SELECT user_id, week_start, round(depth, 6) + 0.0 AS depth, CAST(depth IS NOT NULL AS INT) AS has_data, severity, CAST(CASE severity {' '.join(f"WHEN '{k}' THEN {v[0]}" for k, v in X.SEVERITY_EFFECTS.items())} END AS DOUBLE) AS penalty,
CAST(CASE severity {' '.join(f"WHEN '{k}' THEN {v[1]}" for k, v in X.SEVERITY_EFFECTS.items())} END AS BIGINT) AS closed_days FROM s""",
    "production_shares": f"WITH {_MADE} SELECT CASE WHEN grouping(product) = 1 THEN 'ALL' ELSE product END AS product, sum(tonnes) AS world, coalesce(sum(tonnes) FILTER (n_regionkey = {PRODUCTION_REGION}), 0) AS selected, round(100 * coalesce(sum(tonnes) FILTER (n_regionkey = {PRODUCTION_REGION}), 0) / sum(tonnes), 6) AS share_pct FROM made JOIN nation ON nation = n_nationkey GROUP BY ROLLUP (made.product)",
    "production_by_country": f"WITH {_MADE}, w AS (SELECT product, sum(tonnes) AS world FROM made GROUP BY ALL) SELECT w.product, n_nationkey AS nation, coalesce(tonnes, 0) AS tonnes, round(100 * coalesce(tonnes, 0) / nullif(world, 0), 6) AS share_pct FROM w CROSS JOIN nation LEFT JOIN made ON made.product = w.product AND made.nation = n_nationkey WHERE n_regionkey = {PRODUCTION_REGION}",
    "wettest_week": f"""WITH w AS (SELECT l_suppkey, l_quantity * 7 AS mm, {Q._SQL_WEEK} AS week_start FROM lineitem), m AS (SELECT s_nationkey, week_start, round(quantile_cont(mm, 0.5), 6) AS median_mm, count(*) FILTER (mm >= 300) AS damaged FROM w JOIN supplier ON l_suppkey = s_suppkey WHERE month(week_start) BETWEEN 6 AND 8 GROUP BY ALL)
SELECT s_nationkey, week_start, median_mm, damaged FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY median_mm DESC, week_start) AS k FROM m) WHERE k = 1""",
    "positive_delay_weeks": f"WITH {A._CELLS} SELECT c_mktsegment, week_start, sum(CAST(round(greatest(delta, 0) * 2000000) AS BIGINT)) / 2000000 AS total, count(*) FILTER (delta > 0) AS positive, quantile_cont(round(delta * 2000000), 0.5) FILTER (delta > 0) / 2000000 AS median_positive FROM d GROUP BY ALL",
    "min_max_scaled": f"WITH {A._CELLS}, x AS (SELECT c_nationkey, c_mktsegment, sum(CAST(round({A._BURDEN} * 2000000) AS BIGINT)) / 2000000 AS burden, count(*) FILTER (delta >= 3) AS affected_weeks, max(delta) AS peak FROM d GROUP BY ALL) SELECT c_nationkey, c_mktsegment, {_SCALED} FROM x WINDOW g AS (PARTITION BY c_mktsegment)",
    "route_surface_share": f"WITH k AS (SELECT l_orderkey, {Q._SQL_SURFACE} AS surface, sum(l_quantity) AS km FROM lineitem GROUP BY ALL) SELECT surface, count(*) AS routes, sum(km) AS km, round(sum(km) / (SELECT sum(km) FROM k), 6) AS share FROM k GROUP BY surface",
    "ols_three": f"""WITH s AS (SELECT {Q._SQL_SURFACE} AS surface, count(*) AS n, corr(l_extendedprice, l_quantity) AS p, corr(l_extendedprice, l_discount) AS q, corr(l_extendedprice, l_tax) AS r, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem GROUP BY ALL),
f AS (SELECT *, (p * (1 - c * c) + q * (b * c - a) + r * (a * c - b)) / {_DETERMINANT} AS x, (p * (b * c - a) + q * (1 - b * b) + r * (a * b - c)) / {_DETERMINANT} AS y, (p * (a * c - b) + q * (a * b - c) + r * (1 - a * a)) / {_DETERMINANT} AS z FROM s)
SELECT surface, n, round(x, 6) + 0.0 AS beta_1, round(y, 6) + 0.0 AS beta_2, round(z, 6) + 0.0 AS beta_3, round(x * p + y * q + z * r, 6) + 0.0 AS r_squared, round(1 - (1 - (x * p + y * q + z * r)) * (n - 1) / (n - 4), 6) + 0.0 AS adjusted FROM f""",
    "tile_codes": f"""WITH {A._POINTS}, b AS (SELECT label, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM p GROUP BY ALL),
t AS (SELECT label, north, south, unnest(generate_series(CAST(floor(west / 3) * 3 AS BIGINT), CAST(floor((east - 1e-9) / 3) * 3 AS BIGINT), 3)) AS lon FROM b), u AS (SELECT label, lon, unnest(generate_series(CAST(floor(south / 3) * 3 AS BIGINT), CAST(floor((north - 1e-9) / 3) * 3 AS BIGINT), 3)) AS lat FROM t)
SELECT label, printf('%s%02d%s%03d', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lat), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END, abs(lon)) AS tile FROM u""",
    "station_selection": f"""WITH {A._POINTS}, a AS (SELECT user_id AS station_id, CAST(min(ts) AS DATE) AS begin_, CAST(max(ts) AS DATE) AS end_ FROM events GROUP BY ALL)
SELECT station_id, CAST(label AS VARCHAR) AS country FROM a JOIN p ON vec_id = station_id WHERE x BETWEEN {_WEST} AND {_EAST} AND y BETWEEN {_SOUTH} AND {_NORTH} AND begin_ <= DATE '{STATION_TO}' AND end_ >= DATE '{STATION_FROM}' ORDER BY station_id LIMIT {MOST_STATIONS}""",
}
