"""Analytic queries over the driver's tables, each with the SQL that gives the same rows.

Stand-ins: line items are road-weeks (return flag A paved, N unpaved, R unknown), their quantity times 7 is
weekly rain in mm, suppliers are graph nodes, events are hourly accumulations of a cell (user), embeddings are
points, orders are trips and parts are crops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import geometry as G
from ..operators import network as N
from ..operators import ranks as K
from ..operators import relational as R
from ..operators.network import checkpointed

ROAD_ANCHOR, EVENT_ANCHOR = "1995-01-02", "2024-01-01"
SCENARIOS = ("actual_unpaved", "unknown_as_paved", "unknown_as_unpaved")
SURFACES = ("paved", "unpaved", "unknown")
#: The surfaces that count as one in a scenario.
SCENARIO_SURFACES = [("actual_unpaved", s, (s,)) for s in SURFACES] + [
    ("unknown_as_paved", "paved", ("paved", "unknown")), ("unknown_as_paved", "unpaved", ("unpaved",)), ("unknown_as_unpaved", "paved", ("paved",)), ("unknown_as_unpaved", "unpaved", ("unpaved", "unknown"))]
_SQL_SURFACE = "CASE l_returnflag WHEN 'A' THEN 'paved' WHEN 'N' THEN 'unpaved' ELSE 'unknown' END"
_SQL_WEEK = "date '1995-01-02' + CAST(7 * floor(date_diff('day', date '1995-01-02', CAST(l_shipdate AS date)) / 7) AS INT)"
_SQL_EVENT_WEEK = "date '2024-01-01' + CAST(7 * floor(date_diff('day', date '2024-01-01', CAST(ts AS date)) / 7) AS INT)"
_SQL_SCENARIOS = "(VALUES ('actual_unpaved'), ('unknown_as_paved'), ('unknown_as_unpaved')) s(scenario)"
_SQL_EFFECTIVE = "CASE WHEN scenario = 'unknown_as_paved' AND surface = 'unknown' THEN 'paved' WHEN scenario = 'unknown_as_unpaved' AND surface = 'unknown' THEN 'unpaved' ELSE surface END"
_SQL_FIVE = "count(v) AS n, round(min(v), 6) AS v_min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS v_max, round(avg(v), 6) AS v_mean"
_SQL_RULES = "(VALUES " + ", ".join(f"('{t}', {a}, {'NULL' if b is None else b}, {m})" for t, a, b, m in X.RAIN_RULES) + ") r(t, lo, hi, m)"
_FIVE = ("v_min", "q25", "q50", "q75", "v_max", "v_mean")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(name: str, digits: int = 6):
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


def _surface():
    return F.when(F.col("l_returnflag") == "A", "paved").when(F.col("l_returnflag") == "N", "unpaved").otherwise("unknown")


def _road_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", X.anchored_week(F.col("l_shipdate"), ROAD_ANCHOR).alias("week_start"), _surface().alias("surface"))


def _scenarios(rows: DataFrame) -> DataFrame:
    fanned = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS))))
    return fanned.withColumn("effective", X.scenario_surface(F.col("surface"), F.col("scenario")))


def boxplot_stats_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are counted and sorted once for each surface; the surfaces of a scenario are sums of those, so nothing fans out."""
    long = _road_weeks(spark, sf_dir).select("week_start", "surface", F.expr("stack(2, 'quantity', l_quantity, 'price', l_extendedprice) as (metric, v)"))
    counts = R.histogram(long, ["week_start", "surface", "metric"], "v")
    return R.five_numbers_each(counts, ["week_start", "metric"], "v", SURFACES, SCENARIO_SURFACES).select("week_start", "scenario", "effective", "metric", "n", *map(_r, _FIVE))


def boxplot_stats_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _road_weeks(spark, sf_dir).groupBy("l_suppkey", "week_start").agg(F.avg("l_quantity").alias("v"))
    return R.five_numbers(cells, ["week_start"], "v").select("week_start", "n", *map(_r, _FIVE))


def cell_surface_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("surface") == s, 1)).alias(f"{s}_roads")
    return _road_weeks(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("roads"), n("paved"), n("unpaved"), n("unknown"), F.bool_or(F.col("surface") == "unpaved").alias("has_unpaved"))


def base_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, [*X.HIGHWAY_SPEEDS, "track"]))
    highway = F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int"))
    rows = _t(spark, sf_dir, "lineitem").select(highway.alias("highway"), _surface().alias("surface"))
    return rows.groupBy("highway", "surface").agg(F.count("*").alias("n")).withColumn("kmh", F.round(X.base_speed(F.col("highway"), F.col("surface")), 6))


def rain_penalty_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _road_weeks(spark, sf_dir).select((F.col("l_quantity") * 7).alias("mm"), F.when(F.col("surface") == "paved", "paved").otherwise("unpaved").alias("road_type"))
    return R.with_rain_multiplier(rows, "road_type", "mm").groupBy("road_type", "multiplier").agg(F.count("*").alias("n"), F.min("mm").alias("mm_min"), F.max("mm").alias("mm_max"))


def penalised_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _road_weeks(spark, sf_dir).select("week_start", "l_extendedprice", (F.col("l_quantity") * 7).alias("mm"), F.when(F.col("surface") == "paved", "paved").otherwise("unpaved").alias("road_type"))
    wet = R.with_rain_multiplier(rows, "road_type", "mm").withColumn("wet", X.penalised(F.col("l_extendedprice") / 1000, F.col("multiplier")))
    return wet.groupBy("week_start", "road_type").agg(F.count("*").alias("n"), F.round(F.sum("wet"), 1).alias("wet_cost"), F.round(F.sum(F.col("l_extendedprice") / 1000), 1).alias("dry_cost"))


def hourly_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("week_start", X.anchored_week(F.col("ts"), EVENT_ANCHOR))
    return R.increments(rows, ["user_id", "week_start"], ["ts", "event_id"], "value", "mm").select("event_id", "week_start", _r("mm"))


def weekly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("week_start", X.anchored_week(F.col("ts"), EVENT_ANCHOR))
    return R.increments(rows, ["user_id", "week_start"], ["ts", "event_id"], "value", "mm").groupBy("user_id", "week_start").agg(F.count("*").alias("hours"), F.round(F.sum("mm"), 6).alias("mm"))


def daily_sum_weekly_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("mm"))
    return days.groupBy("user_id", X.anchored_week(F.col("day"), EVENT_ANCHOR).alias("week_start")).agg(F.round(F.max("mm"), 6).alias("wettest_day_mm"), F.count("*").alias("days"))


def mercator_cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select((F.col("embedding")[0].cast("double") * 100).alias("lon"), (F.col("embedding")[1].cast("double") * 100).alias("lat"))
    return e.groupBy(X.mercator_cell(F.col("lon"), F.col("lat"), 250000.0).alias("cell")).agg(F.count("*").alias("n"))


def grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("lon"), (F.col("embedding")[1].cast("double") * 100).alias("lat"))
    snap = lambda c: (F.floor(F.col(c) / 0.25 + 0.5) * 0.25 + 0.0).alias(f"cell_{c}")
    return e.select("vec_id", snap("lon"), snap("lat"))


def local_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    return K.with_percentile(p, ["p_type"], "p_retailprice", "pct").select("p_partkey", F.round("pct", 6).alias("pct"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(_road_weeks(spark, sf_dir), ["surface"], "l_quantity")


def weighted_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_rank(value_histogram(spark, sf_dir), ["surface"], "l_quantity", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def cdf_percentile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.histogram(_road_weeks(spark, sf_dir), [], "l_quantity")
    share = (F.col("before") + F.col("count")) / F.col("total") * 100
    return K.running(counts, [], "l_quantity").select("l_quantity", F.col("count").alias("n"), F.round(share, 6).alias("pct"))


def damage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(X.damage_class(F.col("value") * 4).alias("damage")).agg(F.count("*").alias("n"))


def delay_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("band", X.delay_band(F.col("value") / 6)).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") / 6), 6).alias("hours"))


def effect_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.round(X.interpolated(F.col("value"), [(10.0, 0.1), (100.0, 0.4), (300.0, 0.9)]), 6).alias("effect"))


def transport_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _road_weeks(spark, sf_dir).withColumn("loss", X.transport_loss(F.lit(0.02), F.col("l_quantity"), F.col("surface"), 0.08))
    return rows.groupBy("surface").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


def origin_rank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(_t(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice"), ["p_type"], [F.desc_nulls_last("p_retailprice"), F.col("p_partkey")], 5)


def unvisited_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    c = _t(spark, sf_dir, "customer")
    return c.join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def connected_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    return _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def node_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.format_string("%.5f", F.round(F.col("embedding")[c].cast("double"), 5) + 0.0)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.md5(F.concat_ws(":", d(0), d(1))).alias("node_key"))


def graph_edges(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    return graph(spark, sf_dir)


def connected_components(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    edges = checkpointed(graph_edges(spark, sf_dir, graph).select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return N.components(nodes, edges)


def component_summary(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    return connected_components(spark, sf_dir, graph).groupBy("component").agg(F.count("*").alias("nodes"))


def sssp_costs(spark: SparkSession, sf_dir: str, graph=N.order_graph) -> DataFrame:
    """From the supplier of the highest balance in each nation."""
    first = R.top_per_group(_t(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc_nulls_last("s_acctbal"), F.col("s_suppkey")], 1)
    return N.shortest_costs(first.select(F.col("s_suppkey").alias("origin")), graph(spark, sf_dir))


def access_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _t(spark, sf_dir, "orders").withColumn("best", F.min("o_totalprice").over(Window.partitionBy("o_custkey")))
    counts = trips.select("o_orderpriority", (F.col("o_totalprice") - F.col("best")).alias("extra"), (F.col("o_totalprice") / F.col("best")).alias("ratio")).groupBy("o_orderpriority", "extra").agg(F.count("*").alias("count"), F.max("ratio").alias("ratio"))
    found = K.running(counts, ["o_orderpriority"], "extra").groupBy("o_orderpriority").agg(F.sum("count").alias("n"), *K.quantile_columns({"median": 0.5}, "extra"), F.max("ratio").alias("ratio"))
    return found.select("o_orderpriority", "n", F.round("median", 6).alias("median_extra"), F.round("ratio", 6).alias("max_ratio"))


def regimes_cumshare(spark: SparkSession, sf_dir: str) -> DataFrame:
    burden = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(F.greatest(F.col("o_totalprice") - 100000, F.lit(0.0))).alias("burden"))
    return R.cumulative_share(burden, "burden", "c_nationkey", []).select("c_nationkey", "rank", F.round("cum_share", 6).alias("cum_share"))


def burden_rank_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("rain"), F.count("*").alias("burden"))
    per = checkpointed(per)
    ranked = K.with_dense_rank(K.with_dense_rank(per, "rain", "by_rain"), "burden", "by_burden")
    return ranked.select("l_suppkey", (F.col("by_rain") - F.col("by_burden")).alias("gap"))


def ranked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the percentile ranks of their size, x, and price, y, among those of their type."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return K.with_percentile(K.with_percentile(p, ["p_type"], "p_size", "x"), ["p_type"], "p_retailprice", "y")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_parts(spark, sf_dir)
    return ranked.groupBy("p_type").agg(F.round(F.corr("x", "y"), 6).alias("rho"))


def surface_mix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _road_weeks(spark, sf_dir).groupBy("week_start").pivot("surface", ["paved", "unpaved", "unknown"]).agg(F.sum("l_quantity")).fillna(0.0)
    return wide.select("week_start", *(_r(c) for c in ("paved", "unpaved", "unknown")))


def completeness_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _road_weeks(spark, sf_dir).groupBy("week_start").agg(F.count_distinct("l_suppkey").alias("cells"), F.count("*").alias("n"))
    return weeks.where("cells >= 5")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = o.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.lit(0.0))
    return R.upsert(o, changed, ["o_orderkey"])


def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"))


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.greatest(F.coalesce("l_quantity", F.lit(1.0)), F.lit(1.0))
    return _road_weeks(spark, sf_dir).groupBy("surface").agg(F.round(F.sum(w * F.col("l_extendedprice")) / F.nullif(F.sum(w), F.lit(0.0)), 4).alias("mean_price"))


def path_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")))
    paths = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(steps.alias("s"))
    return paths.select("l_orderkey", F.md5(F.array_join(F.transform("s", lambda x: x["l_suppkey"].cast("string")), ",")).alias("signature"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other points, however far."""
    p = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    return G.k_nearest(p, p, None, 3).select(F.col("id").alias("origin"), "rank", F.col("target").alias("vec_id"), F.round("d2", 6).alias("d2"))


QUERIES = {f.__name__: f for f in (
    boxplot_stats_roads, boxplot_stats_cells, cell_surface_summary, base_speed, rain_penalty_lookup, penalised_cost, hourly_increment, weekly_grid, daily_sum_weekly_max, mercator_cell_key, grid_snap, local_percentile,
    value_histogram, weighted_nearest_rank, cdf_percentile_map, damage_class, delay_bands, effect_interpolation, transport_loss, origin_rank_topn, unvisited_customers, connected_customers, node_key_md5, graph_edges,
    connected_components, component_summary, sssp_costs, access_delta, regimes_cumshare, burden_rank_gap, spearman, surface_mix_pivot, completeness_having, upsert_latest, event_props_json, weighted_mean, path_signature, knn_topk)}

_ROADS = f"roads AS (SELECT l_suppkey, l_partkey, l_quantity, l_extendedprice, {_SQL_WEEK} AS week_start, {_SQL_SURFACE} AS surface FROM lineitem)"
_STEPS = f"""p AS (SELECT * FROM (SELECT l_orderkey, l_suppkey AS s, lead(l_suppkey) OVER o AS t, l_quantity AS w, {_SQL_WEEK} AS week, lead({_SQL_WEEK}) OVER o AS t_week
FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) WHERE t IS NOT NULL AND s <> t)"""
_EDGES = _STEPS + """,
e AS (SELECT least(s, t) AS a, greatest(s, t) AS b, min(w) AS w FROM p GROUP BY ALL),
b AS (SELECT a AS s, b AS t, w FROM e UNION ALL SELECT b, a, w FROM e)"""
_COMPONENTS = f"WITH RECURSIVE {_EDGES}, r(node, c) USING KEY (node) AS (SELECT DISTINCT s, s FROM b UNION SELECT b.t, min(r.c) FROM r JOIN b ON b.s = r.node JOIN recurring.r old ON old.node = b.t WHERE r.c < old.c GROUP BY b.t)"
_INCREMENTS = f"""i AS (SELECT *, CASE WHEN p IS NULL OR value - p < -0.01 THEN greatest(value, 0) ELSE greatest(value - p, 0) END AS mm FROM (SELECT event_id, user_id, value, {_SQL_EVENT_WEEK} AS week_start,
lag(value) OVER (PARTITION BY user_id, {_SQL_EVENT_WEEK} ORDER BY ts, event_id) AS p FROM events))"""
_PCT = "(rank() OVER (PARTITION BY p_type ORDER BY {0}) + (count(*) OVER (PARTITION BY p_type, {0}) - 1) / 2.0) / count(*) OVER (PARTITION BY p_type) * 100"
_WET = f"SELECT week_start, road_type, mm, m, l_extendedprice / 1000 AS dry FROM (SELECT *, l_quantity * 7 AS mm, CASE WHEN surface = 'paved' THEN 'paved' ELSE 'unpaved' END AS road_type FROM roads) x JOIN {_SQL_RULES} ON t = road_type AND mm >= lo AND (hi IS NULL OR mm < hi)"

ORACLE_SQL = {
    "boxplot_stats_roads": f"WITH {_ROADS}, l AS (SELECT week_start, scenario, {_SQL_EFFECTIVE} AS effective, metric, CASE metric WHEN 'quantity' THEN l_quantity ELSE l_extendedprice END AS v FROM roads CROSS JOIN {_SQL_SCENARIOS} CROSS JOIN (VALUES ('quantity'), ('price')) m(metric)) SELECT week_start, scenario, effective, metric, {_SQL_FIVE} FROM l GROUP BY ALL",
    "boxplot_stats_cells": f"WITH {_ROADS}, c AS (SELECT l_suppkey, week_start, avg(l_quantity) AS v FROM roads GROUP BY ALL) SELECT week_start, {_SQL_FIVE} FROM c GROUP BY ALL",
    "cell_surface_summary": f"WITH {_ROADS} SELECT l_suppkey, count(*) AS roads, count(*) FILTER (surface = 'paved') AS paved_roads, count(*) FILTER (surface = 'unpaved') AS unpaved_roads, count(*) FILTER (surface = 'unknown') AS unknown_roads, bool_or(surface = 'unpaved') AS has_unpaved FROM roads GROUP BY ALL",
    "base_speed": f"WITH x AS (SELECT (['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'residential', 'track'])[CAST(l_partkey % 7 + 1 AS INT)] AS highway, {_SQL_SURFACE} AS surface FROM lineitem) SELECT highway, surface, count(*) AS n, round(CAST((CASE highway WHEN 'motorway' THEN 100 WHEN 'trunk' THEN 80 WHEN 'primary' THEN 65 WHEN 'secondary' THEN 50 WHEN 'tertiary' THEN 40 WHEN 'residential' THEN 25 ELSE 30 END) AS DOUBLE) * (CASE surface WHEN 'unpaved' THEN 0.75 WHEN 'unknown' THEN 0.85 ELSE 1.0 END), 6) AS kmh FROM x GROUP BY ALL",
    "rain_penalty_lookup": f"WITH {_ROADS}, w AS ({_WET}) SELECT road_type, CAST(m AS DOUBLE) AS multiplier, count(*) AS n, min(mm) AS mm_min, max(mm) AS mm_max FROM w GROUP BY ALL",
    "penalised_cost": f"WITH {_ROADS}, w AS ({_WET}) SELECT week_start, road_type, count(*) AS n, round(sum(dry / greatest(CAST(m AS DOUBLE), 0.01)), 1) AS wet_cost, round(sum(dry), 1) AS dry_cost FROM w GROUP BY ALL",
    "hourly_increment": f"WITH {_INCREMENTS} SELECT event_id, week_start, round(mm, 6) + 0.0 AS mm FROM i",
    "weekly_grid": f"WITH {_INCREMENTS} SELECT user_id, week_start, count(*) AS hours, round(sum(mm), 6) AS mm FROM i GROUP BY ALL",
    "daily_sum_weekly_max": "WITH d AS (SELECT user_id, CAST(ts AS date) AS ts, sum(value) AS mm FROM events GROUP BY ALL) SELECT user_id, " + _SQL_EVENT_WEEK + " AS week_start, round(max(mm), 6) AS wettest_day_mm, count(*) AS days FROM d GROUP BY ALL",
    "mercator_cell_key": "SELECT CAST(CAST(floor(radians(CAST(embedding[1] AS DOUBLE) * 100) * 6378137.0 / 250000.0) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(ln(tan(radians(CAST(embedding[2] AS DOUBLE) * 100) / 2 + pi() / 4)) * 6378137.0 / 250000.0) AS BIGINT) AS VARCHAR) AS cell, count(*) AS n FROM embeddings GROUP BY ALL",
    "grid_snap": "SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 100 / 0.25 + 0.5) * 0.25 + 0.0 AS cell_lon, floor(CAST(embedding[2] AS DOUBLE) * 100 / 0.25 + 0.5) * 0.25 + 0.0 AS cell_lat FROM embeddings",
    "local_percentile": f"SELECT p_partkey, round({_PCT.format('p_retailprice')}, 6) AS pct FROM part",
    "value_histogram": f"WITH {_ROADS} SELECT surface, l_quantity, count(*) AS count FROM roads GROUP BY ALL",
    "weighted_nearest_rank": f"WITH {_ROADS}, h AS (SELECT surface, l_quantity AS v, count(*) AS c FROM roads GROUP BY ALL), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY surface ORDER BY v) AS BIGINT) AS cum, CAST(sum(c) OVER (PARTITION BY surface) AS BIGINT) AS n FROM h) SELECT surface, max(n) AS n, min(v) FILTER (cum >= ceil(n * 0.25)) AS q25, min(v) FILTER (cum >= ceil(n * 0.5)) AS q50, min(v) FILTER (cum >= ceil(n * 0.75)) AS q75 FROM r GROUP BY ALL",
    "cdf_percentile_map": f"WITH {_ROADS}, h AS (SELECT l_quantity, count(*) AS n FROM roads GROUP BY ALL) SELECT l_quantity, n, round(CAST(sum(n) OVER (ORDER BY l_quantity) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS pct FROM h",
    "damage_class": "SELECT CAST(CASE WHEN value IS NULL THEN -1 ELSE (value * 4 >= 180)::INT + (value * 4 >= 360)::INT + (value * 4 >= 540)::INT + (value * 4 >= 720)::INT + (value * 4 >= 1440)::INT END AS INT) AS damage, count(*) AS n FROM events GROUP BY ALL",
    "delay_bands": "SELECT CASE WHEN value / 6 < 3 THEN '0-3h' WHEN value / 6 < 6 THEN '3-6h' WHEN value / 6 < 12 THEN '6-12h' WHEN value / 6 < 24 THEN '12-24h' ELSE '24-80h' END AS band, count(*) AS n, round(avg(value / 6), 6) AS hours FROM events WHERE value >= 0 AND value / 6 < 80 GROUP BY ALL",
    "effect_interpolation": "SELECT event_id, round(CASE WHEN value < 10 THEN 0.0 WHEN value < 100 THEN 0.1 + (value - 10) * (CAST(0.4 AS DOUBLE) - CAST(0.1 AS DOUBLE)) / 90 WHEN value < 300 THEN 0.4 + (value - 100) * (CAST(0.9 AS DOUBLE) - CAST(0.4 AS DOUBLE)) / 200 ELSE 0.9 END, 6) AS effect FROM events",
    "transport_loss": f"WITH {_ROADS} SELECT surface, round(avg(least(CAST(0.08 AS DOUBLE), CASE WHEN surface = 'paved' THEN CAST(0.02 AS DOUBLE) / 3 ELSE CAST(0.02 AS DOUBLE) END * l_quantity / 10)), 6) AS loss, count(*) AS n FROM roads GROUP BY ALL",
    "origin_rank_topn": "SELECT * FROM (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 5",
    "unvisited_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY ALL",
    "connected_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY ALL",
    "node_key_md5": "SELECT vec_id, md5(printf('%.5f', round(CAST(embedding[1] AS DOUBLE), 5) + 0.0) || ':' || printf('%.5f', round(CAST(embedding[2] AS DOUBLE), 5) + 0.0)) AS node_key FROM embeddings",
    "graph_edges": f"WITH {_EDGES} SELECT a, b, w FROM e",
    "connected_components": f"{_COMPONENTS} SELECT node, c AS component FROM r",
    "component_summary": f"{_COMPONENTS} SELECT c AS component, count(*) AS nodes FROM r GROUP BY ALL",
    "sssp_costs": f"WITH RECURSIVE {_EDGES}, r(origin, node, cost) USING KEY (origin, node) AS (SELECT s_suppkey, s_suppkey, CAST(0 AS DOUBLE) FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS k FROM supplier) WHERE k = 1 UNION SELECT r.origin, b.t, min(r.cost + b.w) FROM r JOIN b ON b.s = r.node LEFT JOIN recurring.r old ON old.origin = r.origin AND old.node = b.t WHERE old.cost IS NULL OR r.cost + b.w < old.cost GROUP BY r.origin, b.t) SELECT origin, node, cost FROM r",
    "access_delta": "WITH t AS (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders) SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice - best, 0.5), 6) AS median_extra, round(max(o_totalprice / best), 6) AS max_ratio FROM t GROUP BY ALL",
    "regimes_cumshare": "WITH u AS (SELECT c_nationkey, sum(greatest(o_totalprice - 100000, 0.0)) AS burden FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_nationkey, row_number() OVER o AS rank, round(sum(burden) OVER (ORDER BY burden DESC, c_nationkey ROWS UNBOUNDED PRECEDING) / sum(burden) OVER (), 6) AS cum_share FROM u WINDOW o AS (ORDER BY burden DESC, c_nationkey)",
    "burden_rank_gap": "WITH u AS (SELECT l_suppkey, sum(l_quantity) AS rain, count(*) AS burden FROM lineitem GROUP BY ALL) SELECT l_suppkey, dense_rank() OVER (ORDER BY rain DESC) - dense_rank() OVER (ORDER BY burden DESC) AS gap FROM u",
    "spearman": f"WITH x AS (SELECT p_type, {_PCT.format('p_size')} AS x, {_PCT.format('p_retailprice')} AS y FROM part) SELECT p_type, round(corr(x, y), 6) AS rho FROM x GROUP BY ALL",
    "surface_mix_pivot": f"WITH {_ROADS} SELECT week_start, round(coalesce(sum(l_quantity) FILTER (surface = 'paved'), 0), 6) AS paved, round(coalesce(sum(l_quantity) FILTER (surface = 'unpaved'), 0), 6) AS unpaved, round(coalesce(sum(l_quantity) FILTER (surface = 'unknown'), 0), 6) AS unknown FROM roads GROUP BY ALL",
    "completeness_having": f"WITH {_ROADS} SELECT week_start, count(DISTINCT l_suppkey) AS cells, count(*) AS n FROM roads GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 5",
    "upsert_latest": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders",
    "event_props_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL",
    "weighted_mean": f"WITH {_ROADS} SELECT surface, round(sum(greatest(l_quantity, 1) * l_extendedprice) / sum(greatest(l_quantity, 1)), 4) AS mean_price FROM roads GROUP BY ALL",
    "path_signature": "SELECT l_orderkey, md5(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity)) AS signature FROM lineitem GROUP BY ALL",
    "knn_topk": "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings) SELECT origin, rank, vec_id, round(far, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY far, vec_id) AS rank FROM (SELECT q.vec_id AS origin, p.vec_id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS far FROM p q JOIN p ON p.vec_id <> q.vec_id)) WHERE rank <= 3",
}
