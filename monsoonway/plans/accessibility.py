"""Accessibility analytics over the driver's tables, each with the SQL that gives the same rows.

Stand-ins, besides those of ``queries``: an order is a trip from its customer's nation (country) to a
destination type (market segment) of o_totalprice / 10,000 hours in the week of its date. A cell is a
country and a destination type.
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
from ..streaming import counts as C
from . import queries as Q

SEVERE_HOURS, LONG_HOURS = 3.0, 6.0
KNN_REACH = 5.0
# Outlines of three areas, as (x, y) corners.
AREAS = {
    "square": [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0)],
    "wedge": [(0.0, 0.0), (40.0, 5.0), (15.0, 35.0)],
    "notch": [(-40.0, -40.0), (0.0, -40.0), (0.0, 0.0), (-20.0, -20.0), (-40.0, 0.0)],
}


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = Q._t(spark, sf_dir, "orders").join(Q._t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return trips.select("c_nationkey", "c_mktsegment", X.anchored_week(F.col("o_orderdate"), Q.ROAD_ANCHOR).alias("week_start"), (F.col("o_totalprice") / 10000).alias("hours"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median hours of a cell and week, and their excess over the cell's best week, from whole millionths, so that no median is a rounding tie."""
    weekly = K.quantiles(_trips(spark, sf_dir).withColumn("v", F.round(F.col("hours") * 1000000)), ["c_nationkey", "c_mktsegment", "week_start"], "v", {"micro": 0.5})
    best = F.min("micro").over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    return weekly.select("c_nationkey", "c_mktsegment", "week_start", "n", (F.col("micro") / 1000000).alias("med"), ((F.col("micro") - best) / 1000000).alias("delta"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i, c: (F.col("embedding")[i].cast("double") * 100).alias(c)
    return Q._t(spark, sf_dir, "embeddings").select("vec_id", "label", at(0, "x"), at(1, "y"))


def _severe():
    return F.greatest(F.col("delta") - SEVERE_HOURS, F.lit(0.0))


def _burden():
    """Severe hours, summed in whole half-millionths: the same in any order."""
    return F.sum(F.round(_severe() * 2000000).cast("long")) / 2000000


def access_weekly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.five_numbers(_trips(spark, sf_dir), ["week_start", "c_mktsegment"], "hours")
    return found.select("week_start", "c_mktsegment", "n", *(Q._r(c, 9) for c in Q._FIVE))  # quartiles of 6 decimals have 8


def access_country_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("weeks"), F.min("med").alias("best"), F.round(F.percentile("delta", F.lit(0.5)), 5).alias("median_delta"), F.max("delta").alias("max_delta"))


def cells_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("c_nationkey", X.damage_class(F.col("delta") * 60).alias("damage")).agg(F.count("*").alias("cell_weeks"), F.round(F.avg("delta"), 4).alias("mean_delta"))


def annual_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe hours a year of each country, at its worst destination type each week."""
    worst = _cells(spark, sf_dir).groupBy("c_nationkey", "week_start").agg(F.max("delta").alias("delta"))
    return worst.groupBy("c_nationkey", F.year("week_start").alias("year")).agg(_burden().alias("burden"), F.count(F.when(F.col("delta") >= SEVERE_HOURS, 1)).alias("severe_weeks"))


def annual_points_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all types, weighted by trips."""
    return _cells(spark, sf_dir).groupBy("c_nationkey", F.year("week_start").alias("year")).agg(F.round(F.sum(_severe() * F.col("n")) / F.sum("n"), 4).alias("burden"), F.sum("n").alias("trips"))


def annual_points_by_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("c_mktsegment", F.year("week_start").alias("year")).agg(_burden().alias("burden"), F.count_distinct("c_nationkey").alias("countries"))


def damage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("c_nationkey", "c_mktsegment").agg(_burden().alias("burden"), F.count(F.when(F.col("delta") >= SEVERE_HOURS, 1)).alias("affected_weeks"), F.max("delta").alias("peak"))


def bubble_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = lambda h: F.count(F.when(F.col("delta") >= h, 1))
    return _cells(spark, sf_dir).groupBy("week_start").agg(over(SEVERE_HOURS).alias("severe"), over(LONG_HOURS).alias("long"), F.round(F.avg(F.when(F.col("delta") >= SEVERE_HOURS, F.col("delta"))), 4).alias("mean_affected"))


def clean_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("c_mktsegment").agg(F.round(F.avg(F.when(F.col("delta") < SEVERE_HOURS, 1.0).otherwise(0.0)), 6).alias("clean"), F.count("*").alias("cell_weeks"))


def diagnostic_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week of the largest total excess of each country."""
    weekly = _cells(spark, sf_dir).groupBy("c_nationkey", "week_start").agg(F.round(F.sum("delta"), 4).alias("total"), F.max("delta").alias("peak"))
    return R.top_per_group(weekly, ["c_nationkey"], [F.desc("total"), F.col("week_start")], 1).drop("rank")


def contrast_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wettest and the driest week of each supplier by mean rain."""
    weekly = Q._road_weeks(spark, sf_dir).groupBy("l_suppkey", "week_start").agg(F.round(F.avg(F.col("l_quantity") * 7), 4).alias("mm"))
    first = lambda kind, by: R.top_per_group(weekly, ["l_suppkey"], [by, F.col("week_start")], 1).drop("rank").withColumn("kind", F.lit(kind))
    return first("wettest", F.desc("mm")).unionByName(first("driest", F.asc("mm")))


def max_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).orderBy(F.desc("delta"), "c_nationkey", "c_mktsegment", "week_start").limit(1)


def rain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rain = Q._road_weeks(spark, sf_dir).join(Q._t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("mm", F.col("l_quantity") * 7)
    return rain.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("mm"), 4).alias("mean_mm"), F.max("mm").alias("max_mm"), F.count(F.when(F.col("mm") >= 300, 1)).alias("closed"))


def surface_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each surface in the length of a supplier's roads."""
    long = Q._road_weeks(spark, sf_dir).groupBy("l_suppkey", "surface").agg(F.sum("l_quantity").alias("km"))
    return long.select("l_suppkey", "surface", F.round(F.col("km") / F.nullif(F.sum("km").over(Window.partitionBy("l_suppkey")), F.lit(0.0)), 6).alias("share"))


def scope_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = F.filter(F.array(F.lit("all"), F.when(F.col("effective").isin("paved", "unpaved"), F.col("effective"))), lambda s: s.isNotNull())
    return Q._scenarios(Q._road_weeks(spark, sf_dir)).withColumn("scope", F.explode(scopes)).groupBy("scenario", "scope").agg(F.count("*").alias("n"))


def cell_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._scenarios(Q._road_weeks(spark, sf_dir))
    return rows.groupBy("scenario", "effective", "week_start").agg(F.count("*").alias("road_count"), F.round(F.avg("l_quantity"), 6).alias("mm"))


def od_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of each country: its three richest customers and its richest supplier."""
    city = R.top_per_group(Q._t(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 3)
    port = R.top_per_group(Q._t(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc_nulls_last("s_acctbal"), F.col("s_suppkey")], 1)
    return city.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("dest_id"), F.lit("city").alias("dest_type"), "rank").unionByName(
        port.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("dest_id"), F.lit("port").alias("dest_type"), "rank"))


def distinct_on_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest road of each supplier."""
    longest = F.max(F.struct("l_quantity", (-F.col("l_orderkey")).alias("o"), (-F.col("l_partkey")).alias("p")))
    return Q._t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(longest.alias("m")).select("l_suppkey", F.col("m.l_quantity").alias("l_quantity"), (-F.col("m.o")).alias("l_orderkey"), (-F.col("m.p")).alias("l_partkey"))


def weeks_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks without rows between the first and the last week of each part."""
    weeks = Q._road_weeks(spark, sf_dir).select("l_partkey", "week_start").distinct()
    span = weeks.groupBy("l_partkey").agg(F.min("week_start").alias("a"), F.max("week_start").alias("z"))
    calendar = span.select("l_partkey", F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("week_start"))
    return calendar.join(weeks, ["l_partkey", "week_start"], "left_anti").groupBy("l_partkey").agg(F.count("*").alias("missing"), F.min("week_start").alias("first_missing"))


def multiscale_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a cell's representative, its smallest part, on every part of the cell."""
    w = Window.partitionBy("p_size", "p_brand").orderBy("p_partkey")
    return Q._t(spark, sf_dir, "part").select("p_partkey", F.first("p_partkey").over(w).alias("representative"), F.first("p_retailprice").over(w).alias("value"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    hits = F.array_compact(F.array(*(F.when(X.in_polygon(F.col("x"), F.col("y"), corners), name) for name, corners in AREAS.items())))
    return p.select("vec_id", F.explode(hits).alias("area"))


def knn_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return G.k_nearest(p, p, None, 3, most=KNN_REACH, digits=6).select(F.col("id").alias("origin"), F.col("rank").cast("long").alias("rank"), F.col("target").alias("vec_id"), "d2")


def _k_nearest(spark: SparkSession, sf_dir: str, k: int, same: tuple[str, ...] = (), only: str = "true") -> DataFrame:
    p = _points(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return G.k_nearest(p, p, None, k, same=same, only=only).select(F.col("id").alias("origin"), "rank", F.col("target").alias("vec_id"), F.round("d2", 6).alias("d2"))


def knn_same_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other point of the same label, however far."""
    return _k_nearest(spark, sf_dir, 1, ("label",)).drop("rank")


def ols_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = S.standardised_ols(Q._t(spark, sf_dir, "part").withColumn("key", F.col("p_partkey").cast("double")), ["p_type"], "p_retailprice", "p_size", "key")
    return fit.select("p_type", "n", *(Q._r(c, 5) for c in ("beta1", "beta2", "r_squared")))


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = "p_retailprice", "p_size"
    return Q._t(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def edge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.successive(spark, sf_dir).groupBy("s", "t").agg(F.count("*").alias("steps"), F.count_distinct("l_orderkey").alias("routes"))


def reachability(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    """Ordered pairs that reach each other in each component, from its size alone."""
    return Q.component_summary(spark, sf_dir, graph).select("component", "nodes", (F.col("nodes") * (F.col("nodes") - 1)).alias("pairs"))


def mst_links(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    return N.spanning_links(graph(spark, sf_dir))


def week_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Q._t(spark, sf_dir, "events").groupBy(X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR).alias("week_start"), "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("week_start").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("stats"))


def schema_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = {"name": "string", "parent": "int", "kind": "string"}
    n = Q._t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("PARENT"), F.lit("nation").alias("kind"))
    r = Q._t(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    return T.with_columns_of(n, shape).unionByName(T.with_columns_of(r, shape))


def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.coalesce(F.length(F.trim("text")) == 0, F.lit(True))
    return Q._t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count(F.when(blank, 1)).alias("missing"), F.sum("n_chars").alias("chars"))


def case_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one normalised address are one case."""
    p = Q._t(spark, sf_dir, "pages").withColumn("address", X.normalised_url(F.col("url")))
    return p.groupBy("address").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages")).withColumn("case_id", F.substring(F.md5("address"), 1, 12))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = Q.ranked_parts(spark, sf_dir)
    return S.bootstrap_correlation(ranked, ["p_type"], "p_partkey", "x", "y")


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weighted_clusters(_points(spark, sf_dir).withColumn("area", F.lit(1.0) + F.col("label")), "vec_id", "x", "y", "area")


def stream_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stream_weekly_counts(spark, f"{sf_dir}/events.parquet", Q.EVENT_ANCHOR).select("week_start", "event_type", "n", F.round("value_sum", 4).alias("value_sum"))


def calendar_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchored weeks that the events span; the last one ends with the last day."""
    span = Q._t(spark, sf_dir, "events").agg(F.min(X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR)).alias("a"), F.max(F.to_date("ts")).alias("z"))
    weeks = span.select(F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("week_start"), "z")
    return weeks.select("week_start", F.least(F.date_add("week_start", 6), "z").alias("week_end"))


def grid_meta_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, step and columns of the grid, from the gaps between its distinct coordinates."""
    lons = Q.grid_snap(spark, sf_dir).select(F.round("cell_lon", 4).alias("lon")).distinct()
    gaps = lons.withColumn("gap", F.col("lon") - F.lag("lon").over(Window.partitionBy().orderBy("lon")))  # one row for each grid column
    return gaps.agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.round(F.min("gap"), 4).alias("step"), F.count("*").alias("columns"))


def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest station, a point of label 0, however far."""
    return _k_nearest(spark, sf_dir, 1, only="label = 0").drop("rank")


def node_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("nodes"), (F.min("l_suppkey") == F.max("l_suppkey")).alias("stable"))


def od_route_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's route and the one without roads that rain of 300 mm a week closes."""
    rows = Q._t(spark, sf_dir, "lineitem").withColumn("open", F.col("l_quantity") * 7 < 300)
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "open")))
    signature = lambda s: F.md5(F.array_join(F.transform(s, lambda x: x["l_suppkey"].cast("string")), ","))
    routes = rows.groupBy("l_orderkey").agg(steps.alias("s")).withColumn("o", F.filter("s", lambda x: x["open"]))
    named = routes.select("l_orderkey", signature(F.col("s")).alias("dry_route"), F.when(F.size("o") > 0, signature(F.col("o"))).alias("wet_route"), (F.size("s") - F.size("o")).cast("long").alias("closed"))
    return named.withColumn("changed", ~F.col("dry_route").eqNullSafe(F.col("wet_route")))


def crop_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Q._t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    found = od_route_change(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("routes"), F.count(F.when(F.col("changed"), 1)).alias("changed"), F.count(F.when(F.col("wet_route").isNull(), 1)).alias("cut_off"), F.sum("closed").alias("closed"))


def surface_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added cost of rain by surface, as a share of the dry cost."""
    dry = F.col("l_extendedprice") / 1000
    rows = Q._road_weeks(spark, sf_dir).select((F.col("l_quantity") * 7).alias("mm"), dry.alias("dry"), F.when(F.col("surface") == "paved", "paved").otherwise("unpaved").alias("road_type"))
    costs = R.with_rain_multiplier(rows, "road_type", "mm").withColumn("wet", X.penalised(F.col("dry"), F.col("multiplier")))
    return costs.groupBy("road_type").agg(F.count("*").alias("n"), F.round(F.sum("wet") / F.sum("dry") - 1, 6).alias("added"), F.count(F.when(F.col("multiplier") <= 0.05, 1)).alias("closed"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of unit cells: their key and mean place."""
    key = F.md5(F.concat_ws(":", F.floor("x").cast("string"), F.floor("y").cast("string")))
    return _points(spark, sf_dir).groupBy(key.alias("node_key")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def connected_rank(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    """The three richest suppliers of each nation that lie in the largest component."""
    labels = Q.connected_components(spark, sf_dir, graph)
    largest = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = labels.join(F.broadcast(largest), "component", "left_semi")  # one row
    rows = Q._t(spark, sf_dir, "supplier").join(inside, F.col("s_suppkey") == F.col("node"), "left_semi")
    return R.top_per_group(rows.select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.desc_nulls_last("s_acctbal"), F.col("s_suppkey")], 3)


QUERIES = {f.__name__: f for f in (
    access_weekly_summary, access_country_crop, cells_damage, annual_points, annual_points_weighted, annual_points_by_dest, damage_matrix, bubble_timeline, clean_share, diagnostic_weeks, contrast_weeks, max_case,
    rain_summary, surface_mix, scope_mask_counts, cell_overlay, od_union, distinct_on_longest, weeks_missing, multiscale_expand, point_in_polygon, knn_capped, knn_same_component, ols_standardised, linear_fit, edge_usage,
    reachability, mst_links, week_stats_json, schema_fill, catalog_status, case_dedupe, bootstrap_ci, kmeans_clusters, stream_weekly_counts, calendar_weeks,
    grid_meta_lag, nearest_station, node_stability, od_route_change, crop_change_summary, surface_penalty, graph_nodes, connected_rank)}

_WEEK = Q._SQL_WEEK.replace("l_shipdate", "o_orderdate")
_TRIPS = f"trips AS (SELECT c_nationkey, c_mktsegment, {_WEEK} AS week_start, o_totalprice / 10000 AS v FROM orders JOIN customer ON o_custkey = c_custkey)"
_CELLS = f"""{_TRIPS}, m AS (SELECT c_nationkey, c_mktsegment, week_start, count(*) AS n, quantile_cont(round(v * 1000000), 0.5) AS micro FROM trips GROUP BY ALL),
d AS (SELECT *, micro / 1000000 AS med, (micro - min(micro) OVER (PARTITION BY c_nationkey, c_mktsegment)) / 1000000 AS delta FROM m)"""
_MINUTES = "CAST((delta * 60 >= 180)::INT + (delta * 60 >= 360)::INT + (delta * 60 >= 540)::INT + (delta * 60 >= 720)::INT + (delta * 60 >= 1440)::INT AS INT)"
_POINTS = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)"
_BURDEN = "greatest(delta - 3, 0)"
_FIRST = "SELECT l_suppkey, week_start, mm, '{0}' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY mm {1}, week_start) AS k FROM w) WHERE k = 1"


def _crossings(corners: list[tuple[float, float]]) -> str:
    sides = zip(corners, corners[1:] + corners[:1])
    return " + ".join(f"(CASE WHEN (({y1} > y) <> ({y2} > y)) AND x < (y - CAST({y1} AS DOUBLE)) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1} THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in sides if y1 != y2)


def _pairs(extra: str, most: int, columns: str) -> str:
    return f"""WITH {_POINTS}, n AS (SELECT q.vec_id AS origin, p.vec_id, round((p.x - q.x) ** 2 + (p.y - q.y) ** 2, 6) AS d2 FROM p q JOIN p ON p.vec_id <> q.vec_id AND {extra})
SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY d2, vec_id) AS rank FROM n WHERE d2 <= 25) WHERE rank <= {most}"""


def _uncapped(extra: str, most: int, columns: str) -> str:
    return f"""WITH {_POINTS}, n AS (SELECT q.vec_id AS origin, p.vec_id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS far FROM p q JOIN p ON p.vec_id <> q.vec_id AND {extra})
SELECT {columns}, round(far, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY far, vec_id) AS rank FROM n) WHERE rank <= {most}"""


_LINE_ORDER = "ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity"
_ROUTES = f"""o AS (SELECT l_orderkey, md5(string_agg(CAST(l_suppkey AS VARCHAR), ',' {_LINE_ORDER})) AS dry_route,
md5(string_agg(CAST(l_suppkey AS VARCHAR), ',' {_LINE_ORDER}) FILTER (l_quantity * 7 < 300)) AS wet_route, count(*) FILTER (l_quantity * 7 >= 300) AS closed FROM lineitem GROUP BY ALL),
r AS (SELECT *, dry_route IS DISTINCT FROM wet_route AS changed FROM o)"""

ORACLE_SQL = {
    "access_weekly_summary": f"WITH {_TRIPS} SELECT week_start, c_mktsegment, {Q._SQL_FIVE.replace(', 6)', ', 9)')} FROM trips GROUP BY ALL",
    "access_country_crop": f"WITH {_CELLS} SELECT c_nationkey, c_mktsegment, count(*) AS weeks, min(med) AS best, round(quantile_cont(delta, 0.5), 5) AS median_delta, max(delta) AS max_delta FROM d GROUP BY ALL",
    "cells_damage": f"WITH {_CELLS} SELECT c_nationkey, {_MINUTES} AS damage, count(*) AS cell_weeks, round(avg(delta), 4) AS mean_delta FROM d GROUP BY ALL",
    "annual_points": f"WITH {_CELLS}, w AS (SELECT c_nationkey, week_start, max(delta) AS delta FROM d GROUP BY ALL) SELECT c_nationkey, CAST(year(week_start) AS INT) AS year, sum(CAST(round({_BURDEN} * 2000000) AS BIGINT)) / 2000000 AS burden, count(*) FILTER (delta >= 3) AS severe_weeks FROM w GROUP BY ALL",
    "annual_points_weighted": f"WITH {_CELLS} SELECT c_nationkey, CAST(year(week_start) AS INT) AS year, round(sum({_BURDEN} * n) / sum(n), 4) AS burden, CAST(sum(n) AS BIGINT) AS trips FROM d GROUP BY ALL",
    "annual_points_by_dest": f"WITH {_CELLS} SELECT c_mktsegment, CAST(year(week_start) AS INT) AS year, sum(CAST(round({_BURDEN} * 2000000) AS BIGINT)) / 2000000 AS burden, count(DISTINCT c_nationkey) AS countries FROM d GROUP BY ALL",
    "damage_matrix": f"WITH {_CELLS} SELECT c_nationkey, c_mktsegment, sum(CAST(round({_BURDEN} * 2000000) AS BIGINT)) / 2000000 AS burden, count(*) FILTER (delta >= 3) AS affected_weeks, max(delta) AS peak FROM d GROUP BY ALL",
    "bubble_timeline": f"WITH {_CELLS} SELECT week_start, count(*) FILTER (delta >= 3) AS severe, count(*) FILTER (delta >= 6) AS long, round(avg(delta) FILTER (delta >= 3), 4) AS mean_affected FROM d GROUP BY ALL",
    "clean_share": f"WITH {_CELLS} SELECT c_mktsegment, round(avg(CASE WHEN delta < 3 THEN 1.0 ELSE 0.0 END), 6) AS clean, count(*) AS cell_weeks FROM d GROUP BY ALL",
    "diagnostic_weeks": f"WITH {_CELLS}, w AS (SELECT c_nationkey, week_start, round(sum(delta), 4) AS total, max(delta) AS peak FROM d GROUP BY ALL) SELECT c_nationkey, week_start, total, peak FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, week_start) AS k FROM w) WHERE k = 1",
    "contrast_weeks": f"WITH {Q._ROADS}, w AS (SELECT l_suppkey, week_start, round(avg(l_quantity * 7), 4) AS mm FROM roads GROUP BY ALL) {_FIRST.format('wettest', 'DESC')} UNION ALL {_FIRST.format('driest', 'ASC')}",
    "max_case": f"WITH {_CELLS} SELECT c_nationkey, c_mktsegment, week_start, n, med, delta FROM d ORDER BY delta DESC, c_nationkey, c_mktsegment, week_start LIMIT 1",
    "rain_summary": "SELECT s_nationkey, count(*) AS n, round(avg(l_quantity * 7), 4) AS mean_mm, max(l_quantity * 7) AS max_mm, count(*) FILTER (l_quantity * 7 >= 300) AS closed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "surface_mix": f"WITH {Q._ROADS}, k AS (SELECT l_suppkey, surface, sum(l_quantity) AS km FROM roads GROUP BY ALL) SELECT l_suppkey, surface, round(km / nullif(sum(km) OVER (PARTITION BY l_suppkey), 0), 6) AS share FROM k",
    "scope_mask_counts": f"WITH {Q._ROADS}, f AS (SELECT scenario, {Q._SQL_EFFECTIVE} AS e FROM roads CROSS JOIN {Q._SQL_SCENARIOS}) SELECT scenario, scope, count(*) AS n FROM (SELECT scenario, 'all' AS scope FROM f UNION ALL SELECT scenario, e FROM f WHERE e <> 'unknown') GROUP BY ALL",
    "cell_overlay": f"WITH {Q._ROADS}, f AS (SELECT *, {Q._SQL_EFFECTIVE} AS effective FROM roads CROSS JOIN {Q._SQL_SCENARIOS}) SELECT scenario, effective, week_start, count(*) AS road_count, round(avg(l_quantity), 6) AS mm FROM f GROUP BY ALL",
    "od_union": "SELECT c_nationkey AS nation, c_custkey AS dest_id, 'city' AS dest_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer) WHERE rank <= 3 UNION ALL SELECT s_nationkey, s_suppkey, 'port', rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS rank FROM supplier) WHERE rank <= 1",
    "distinct_on_longest": "SELECT DISTINCT ON (l_suppkey) l_suppkey, l_quantity, l_orderkey, l_partkey FROM lineitem ORDER BY l_suppkey, l_quantity DESC, l_orderkey, l_partkey",
    "weeks_missing": f"WITH {Q._ROADS}, w AS (SELECT DISTINCT l_partkey, week_start FROM roads), c AS (SELECT l_partkey, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS date) AS week_start FROM w GROUP BY l_partkey) SELECT l_partkey, count(*) AS missing, min(week_start) AS first_missing FROM c ANTI JOIN w USING (l_partkey, week_start) GROUP BY ALL",
    "multiscale_expand": "SELECT p_partkey, first_value(p_partkey) OVER c AS representative, first_value(p_retailprice) OVER c AS value FROM part WINDOW c AS (PARTITION BY p_size, p_brand ORDER BY p_partkey)",
    "point_in_polygon": f"WITH {_POINTS} " + " UNION ALL ".join(f"SELECT vec_id, '{name}' AS area FROM p WHERE ({_crossings(corners)}) % 2 = 1" for name, corners in AREAS.items()),
    "knn_capped": _pairs("true", 3, "origin, rank, vec_id, d2"),
    "ols_standardised": "WITH r AS (SELECT p_type, count(*) AS n, corr(p_retailprice, p_size) AS r1, corr(p_retailprice, p_partkey) AS r2, corr(p_size, p_partkey) AS r12 FROM part GROUP BY ALL), b AS (SELECT *, (r1 - r2 * r12) / (1 - r12 * r12) AS b1, (r2 - r1 * r12) / (1 - r12 * r12) AS b2 FROM r) SELECT p_type, n, round(b1, 5) + 0.0 AS beta1, round(b2, 5) + 0.0 AS beta2, round(b1 * r1 + b2 * r2, 5) + 0.0 AS r_squared FROM b",
    "linear_fit": "SELECT p_type, round(regr_slope(p_retailprice, p_size), 5) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part GROUP BY ALL",
    "edge_usage": f"WITH {Q._STEPS} SELECT s, t, count(*) AS steps, count(DISTINCT l_orderkey) AS routes FROM p GROUP BY ALL",
    "reachability": f"{Q._COMPONENTS} SELECT c AS component, count(*) AS nodes, count(*) * (count(*) - 1) AS pairs FROM r GROUP BY ALL",
    "week_stats_json": f"SELECT week_start, '{{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}}' AS stats FROM (SELECT {Q._SQL_EVENT_WEEK} AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL",
    "schema_fill": "SELECT n_name AS name, n_regionkey AS parent, 'nation' AS kind FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region",
    "catalog_status": "SELECT source, count(*) AS files, count(*) FILTER (text IS NULL OR trim(text, ' ') = '') AS missing, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL",
    "case_dedupe": r"WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), '[?#].*$', ''), '/+$', '') AS address FROM pages) SELECT address, min(page_id) AS first_page, count(*) AS pages, substr(md5(address), 1, 12) AS case_id FROM a GROUP BY ALL",
    "stream_weekly_counts": f"SELECT {Q._SQL_EVENT_WEEK} AS week_start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY ALL",
    "calendar_weeks": f"WITH e AS (SELECT min({Q._SQL_EVENT_WEEK}) AS a, max(CAST(ts AS date)) AS z FROM events), w AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS date) AS week_start, z FROM e) SELECT week_start, least(week_start + 6, z) AS week_end FROM w",
    "grid_meta_lag": f"WITH {_POINTS}, l AS (SELECT DISTINCT round(floor(x / 0.25 + 0.5) * 0.25 + 0.0, 4) AS lon FROM p), g AS (SELECT lon, lon - lag(lon) OVER (ORDER BY lon) AS gap FROM l) SELECT min(lon) AS lon_min, max(lon) AS lon_max, round(min(gap), 4) AS step, count(*) AS columns FROM g",
    "knn_same_component": _uncapped("p.label = q.label", 1, "origin, vec_id"),
    "nearest_station": _uncapped("p.label = 0", 1, "origin, vec_id"),
    "node_stability": "SELECT l_partkey, count(DISTINCT l_suppkey) AS nodes, min(l_suppkey) = max(l_suppkey) AS stable FROM lineitem GROUP BY ALL",
    "od_route_change": f"WITH {_ROUTES} SELECT l_orderkey, dry_route, wet_route, closed, changed FROM r",
    "crop_change_summary": f"WITH {_ROUTES} SELECT o_orderpriority, count(*) AS routes, count(*) FILTER (changed) AS changed, count(*) FILTER (wet_route IS NULL) AS cut_off, CAST(sum(closed) AS BIGINT) AS closed FROM r JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "surface_penalty": f"WITH {Q._ROADS}, w AS ({Q._WET}) SELECT road_type, count(*) AS n, round(sum(dry / greatest(CAST(m AS DOUBLE), 0.01)) / sum(dry) - 1, 6) AS added, count(*) FILTER (m <= 0.05) AS closed FROM w GROUP BY ALL",
    "graph_nodes": f"WITH {_POINTS} SELECT md5(CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(y) AS BIGINT) AS VARCHAR)) AS node_key, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p GROUP BY ALL",
    "connected_rank": f"{Q._COMPONENTS}, g AS (SELECT c FROM r GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), s AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS rank FROM supplier WHERE s_suppkey IN (SELECT node FROM r WHERE c IN (SELECT c FROM g))) SELECT s_nationkey, s_suppkey, s_acctbal, rank FROM s WHERE rank <= 3",
}
