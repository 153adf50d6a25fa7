"""Weekly access, factor distributions and the smaller measures, each with the SQL that gives the same rows.

Stand-ins are those of ``queries``; a link between suppliers a and b is paved, unpaved or of unknown surface by (a + b) mod 3,
and the rain on it is that of the cell (user) of a.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import factors as W
from ..operators import geometry as G
from ..operators import network as N
from ..operators import ranks as K
from ..operators import relational as R
from . import queries as Q
from .accessibility import _POINTS, _points

SCOPES = ("all", "paved", "unpaved")
#: Rings of areas by name: corners in order.
RINGS = {"north": [(-20.0, 0.0), (20.0, 0.0), (0.0, 25.0)], "south": [(-20.0, 0.0), (-5.0, -20.0), (15.0, -18.0), (20.0, 0.0)], "centre": [(-6.0, -6.0), (6.0, -6.0), (6.0, 6.0), (-6.0, 6.0)]}
LINK_REACH, CAP = 3.0, 2.5
#: Fixed rules of this plan: factor, scope, direction and levels.
RULES = W.parsed_rules([
    {"factor": "quantity", "scope": "unpaved", "direction": "gte", "minor": 10, "moderate": 25, "severe": 40}, {"factor": "quantity", "scope": "paved", "direction": "gte", "minor": 30, "severe": 45},
    {"factor": "price", "scope": "all", "direction": "lte", "minor": 20000, "severe": 5000}])


def _origins(spark: SparkSession, sf_dir: str) -> list[int]:
    first = R.top_per_group(Q._t(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc_nulls_last("s_acctbal"), F.col("s_suppkey")], 1)
    return [r["s_suppkey"] for r in first.collect()]  # one for each nation


def weekly_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (week_start, scenario, a, b, w): every link in every week and scenario at the speed that rain leaves it."""
    rain = N.checkpointed(Q.weekly_grid(spark, sf_dir).select("week_start", F.col("user_id").alias("a"), "mm"))
    weeks = [r["week_start"] for r in rain.select("week_start").distinct().collect()]  # as few as the weeks of the events
    of_cell = rain.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("week_start", "mm"))).alias("by_week"))
    links = N.order_graph(spark, sf_dir).withColumn("surface", F.element_at(F.array(*map(F.lit, ("paved", "unpaved", "unknown"))), ((F.col("a") + F.col("b")) % 3 + 1).cast("int")))
    links = N.checkpointed(links.join(of_cell, "a", "left"))
    # as many rows as weeks times links, which the weekly run asks for; they come from one row of a link and are not written
    each = F.explode(F.array(*map(F.lit, weeks)).cast("array<date>"))
    weekly = Q._scenarios(links.withColumn("week_start", each).withColumn("mm", F.col("by_week")[F.col("week_start")]).drop("by_week"))
    typed = weekly.withColumn("mm", F.coalesce("mm", F.lit(0.0))).withColumn("road_type", F.when(F.col("effective") == "paved", "paved").otherwise("unpaved"))
    return R.with_rain_multiplier(typed, "road_type", "mm").select("week_start", "scenario", "a", "b", X.penalised(F.col("w"), F.col("multiplier")).alias("w"))


def weekly_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain, multiplier, re-weighted graph, costs and status of each week, scenario and origin."""
    costs = N.graph_costs(_origins(spark, sf_dir), weekly_links(spark, sf_dir), ["week_start", "scenario"])
    per = costs.where("node <> origin").groupBy("week_start", "scenario", "origin").agg(F.count("*").alias("reached"), F.round(F.max("cost"), 6).alias("farthest"), F.round(F.min("cost"), 6).alias("nearest"))
    return per.withColumn("status", F.when((F.col("reached") > 0) & (F.col("nearest") > 0), "ok").otherwise("no_cost"))


def _long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._road_weeks(spark, sf_dir).select("week_start", "surface", F.expr("stack(2, 'quantity', l_quantity, 'price', l_extendedprice) as (factor, v)"))


def factor_boxplots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of factor values among all roads of the week, boxed for each scenario and scope."""
    counts = R.histogram(_long_values(spark, sf_dir), ["week_start", "surface", "factor"], "v")
    scopes = [(scenario, scope) for scenario in Q.SCENARIOS for scope in SCOPES]
    boxes = W.scope_boxplots(counts, ["week_start", "factor"], "v", ("paved", "unpaved", "unknown"), scopes)
    return boxes.select("week_start", "factor", "scenario", "scope", "n", *(Q._r(c) for c in ("v_min", "q25", "q50", "q75", "v_max")))


def rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest level of each road-week's factor under the rule of its scope."""
    rows = _long_values(spark, sf_dir)
    held = [F.when((F.col("factor") == r["factor"]) & W.in_scope(F.col("surface"), r["scope"], "actual_unpaved"), X.severity(F.col("v"), r["levels"], r["direction"] == "gte")) for r in RULES]
    return rows.withColumn("severity", F.coalesce(*held, F.lit("none"))).groupBy("week_start", "factor", "severity").agg(F.count("*").alias("n"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._t(spark, sf_dir, "events").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR"))


def weekly_increment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, mean, median and greatest hour of the increments of a week, each counted for the hour before its stamp."""
    rows = _shifted(spark, sf_dir).withColumn("week_start", X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR))
    mm = R.increments(rows, ["user_id", "week_start"], ["ts", "event_id"], "value", "mm")
    return mm.groupBy("user_id", "week_start").agg(F.count("mm").alias("hours"), F.round(F.sum("mm"), 4).alias("mm"), (F.round(F.sum("mm"), 2) / F.count("mm")).alias("mean_mm"), F.round(F.percentile("mm", F.lit(0.5)), 4).alias("median_mm"), F.round(F.max("mm"), 4).alias("hour_mm"))


def wettest_day_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wettest day of a week, from the increments of each day by itself."""
    rows = _shifted(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = R.increments(rows, ["user_id", "day"], ["ts", "event_id"], "value", "mm").groupBy("user_id", "day").agg(F.sum("mm").alias("mm"))
    return days.groupBy("user_id", X.anchored_week(F.col("day"), Q.EVENT_ANCHOR).alias("week_start")).agg(F.round(F.max("mm"), 4).alias("day_mm"))


def knn_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with its nearest other of label 0 within CAP; points without one stay, with nulls."""
    p = _points(spark, sf_dir).withColumnRenamed("vec_id", "id")
    best = G.within(p, p, CAP).where("id <> r_id and r_label = 0").groupBy("id").agg(F.min(F.struct("d2", "r_id")).alias("m"))
    return p.select("id").join(best, "id", "left").select(F.col("id").alias("origin"), F.col("m.r_id").alias("station"), F.round("m.d2", 6).alias("d2"))


def area_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside the rings of a table of areas, and outside all."""
    sides = [(name, *a, *b) for name, ring in RINGS.items() for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]]
    table = spark.createDataFrame(sides, "area string, x1 double, y1 double, x2 double, y2 double")
    crossed = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    p = _points(spark, sf_dir)
    inside = p.join(F.broadcast(table), crossed).groupBy("vec_id", "area").agg(F.count("*").alias("n")).where("n % 2 = 1").select("vec_id", "area")  # the sides are a fixed few
    return p.select("vec_id").join(inside, "vec_id", "left").select("vec_id", F.coalesce("area", F.lit("none")).alias("area"))


def conditional_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity over unpaved lines; null where a supplier has none."""
    on = F.col("surface") == "unpaved"
    w = F.when(on, F.greatest("l_quantity", F.lit(1.0)))
    return Q._road_weeks(spark, sf_dir).groupBy("l_suppkey").agg(F.round(F.sum(w * F.col("l_extendedprice")) / F.nullif(F.sum(w), F.lit(0.0)), 3).alias("mean_price"), F.count(w).alias("n"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ranges of numeric columns, one row each."""
    o = Q._t(spark, sf_dir, "supplier").select(F.expr("stack(2, 's_acctbal', s_acctbal, 's_nationkey', cast(s_nationkey as double)) as (name, v)"))
    return o.groupBy("name").agg(F.count("*").alias("n_total"), F.count("v").alias("n_with_value"), F.count(F.when(F.col("v") > 0, 1)).alias("n_positive"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.round(F.avg("v"), 4).alias("v_mean"))


def _point_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.point_components(_points(spark, sf_dir).withColumnRenamed("vec_id", "id"), LINK_REACH)


def point_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of points that lie within LINK_REACH of each other: many, of all sizes."""
    return _point_components(spark, sf_dir)


def component_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by size, then number, with their share of all nodes."""
    sizes = _point_components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("nodes"))
    whole = sizes.agg(F.sum("nodes").alias("total"))
    # ranks go by the few distinct sizes first, so no task sorts all components
    bigger = sizes.groupBy("nodes").agg(F.count("*").alias("k")).withColumn("above", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("nodes")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("nodes").orderBy("component"))
    return sizes.withColumn("nth", nth).join(bigger, "nodes").join(whole).select("component", "nodes", (F.col("above") + F.col("nth")).cast("long").alias("rank"), F.round(F.col("nodes") / F.col("total"), 6).alias("share"))


def closest_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of each cell nearest to its mean value; ties to the earlier one."""
    e = Q._t(spark, sf_dir, "events")
    mean = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    far = F.round(F.abs(F.col("value") - F.col("mean")), 6)
    return R.top_per_group(e.join(mean, "user_id").withColumn("far", far), ["user_id"], [F.col("far"), F.col("ts"), F.col("event_id")], 1).select("user_id", "event_id", "far")


def country_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by region, falling number of customers, name and key."""
    n = Q._t(spark, sf_dir, "nation")
    c = Q._t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("customers", F.coalesce("customers", F.lit(0)))
    place = F.row_number().over(Window.orderBy("n_regionkey", F.desc("customers"), "n_name", "n_nationkey"))  # the countries of the world at most
    return rows.select("n_nationkey", "customers", place.cast("long").alias("place"))


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their five-decimal key with mean coordinates: ends that agree so far are one node."""
    p = _points(spark, sf_dir)
    ends = p.select("vec_id", "x", "y").unionByName(p.select("vec_id", (F.col("x") + 0.000001).alias("x"), "y"))
    part = lambda c: F.format_string("%.5f", F.round(F.col(c), 5) + 0.0)
    return ends.groupBy(F.md5(F.concat_ws(":", part("x"), part("y"))).alias("node")).agg(F.count("*").alias("ends"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))


def nearest_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each origin the cheapest supplier of another country to reach."""
    s = Q._t(spark, sf_dir, "supplier")
    costs = N.graph_costs(_origins(spark, sf_dir), N.order_graph(spark, sf_dir), [])
    here, there = s.select(F.col("s_suppkey").alias("origin"), F.col("s_nationkey").alias("own")), s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("other"))
    return R.top_per_group(costs.join(here, "origin").join(there, "node").where("own <> other"), ["origin"], [F.col("cost"), F.col("node")], 1).select("origin", F.col("node").alias("city"), "cost")


def haversine_to_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle km from each point, its coordinates as degrees, to (0, 0)."""
    return _points(spark, sf_dir).select("vec_id", F.round(X.haversine_km(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)), 4).alias("km"))


def delay_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, p90, p95 and greatest value by kind of event."""
    counts = K.running(K.counted(Q._t(spark, sf_dir, "events"), ["event_type"], "value"), ["event_type"], "value")
    shares = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    return counts.groupBy("event_type").agg(*K.quantile_columns(shares, "value"), F.max("value").alias("most")).select("event_type", *(F.round(c, 6).alias(c) for c in shares), "most")


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of all pairs of part columns, ranks shared by ties; ranks come from counts of values."""
    p = Q._t(spark, sf_dir, "part").select("p_partkey", F.expr("stack(3, 'key', cast(p_partkey as double), 'price', p_retailprice, 'size', cast(p_size as double)) as (name, v)"))
    counts = p.groupBy("name", "v").agg(F.count("*").alias("k"))
    ranked = K.running(counts, ["name"], "v", "k").select("name", "v", (F.col("before") + (F.col("k") + 1) / 2).alias("rank"))
    ranks = p.join(ranked, ["name", "v"]).groupBy("p_partkey").pivot("name", ["key", "price", "size"]).agg(F.first("rank"))
    names = ("key", "price", "size")
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a in names for b in names))
    return ranks.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.round(F.corr("p.x", "p.y"), 6).alias("rho"))


def affected_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of a cell with any value over 150, and the mean excess in them: 0 where no week has one."""
    weekly = Q._t(spark, sf_dir, "events").groupBy("user_id", X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR).alias("week_start")).agg(F.max("value").alias("v"))
    hit = F.col("v") > 150
    return weekly.groupBy("user_id").agg(F.count(F.when(hit, 1)).alias("weeks"), F.round(F.coalesce(F.avg(F.when(hit, F.col("v") - 150)), F.lit(0.0)), 6).alias("mean_excess"))


def static_weekly_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static balances of cells with the weekly rain beside them; a weekly value overrides the static one of its name."""
    static = Q._t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("mm"))
    weekly = Q.weekly_grid(spark, sf_dir).select(F.col("user_id").alias("cell"), "week_start", F.col("mm").alias("weekly_mm"))
    return static.join(weekly, "cell", "left").select("cell", "week_start", F.round(F.coalesce("weekly_mm", "mm"), 6).alias("mm"))


def routable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose class is routable and known, by class, at a cost of at least 1e-6."""
    kinds = F.array(*map(F.lit, ("motorway", "Footway", "primary", "steps", "tertiary", "cycleway", "track")))
    rows = Q._t(spark, sf_dir, "lineitem").select(F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int")).alias("highway"), F.greatest(F.col("l_discount") * 10, F.lit(1e-6)).alias("cost"))
    return rows.where(X.routable(F.col("highway"))).groupBy("highway").agg(F.count("*").alias("n"), F.min("cost").alias("least"), F.max("cost").alias("most"))


QUERIES = {f.__name__: f for f in (
    weekly_access, factor_boxplots, rule_severity, weekly_increment_stats, wettest_day_increments, knn_left, area_points, conditional_weighted_mean, column_stats, point_components, component_ranks, closest_to_mean, country_queue, node_table,
    nearest_city, haversine_to_origin, delay_quantiles, spearman_matrix, affected_mean, static_weekly_merge, routable_links)}

_FIRST = "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS k FROM supplier) WHERE k = 1"
_LONG = f"{Q._ROADS}, l AS (SELECT week_start, surface, 'quantity' AS factor, l_quantity AS v FROM roads UNION ALL SELECT week_start, surface, 'price', l_extendedprice FROM roads)"
_SHIFTED_WEEK = Q._SQL_EVENT_WEEK.replace("CAST(ts AS date)", "CAST(ts - INTERVAL 1 HOUR AS date)")
_RISE = "CASE WHEN p IS NULL OR value - p < -0.01 THEN greatest(value, 0) ELSE greatest(value - p, 0) END"
_SIDES = "(VALUES " + ", ".join(f"('{n}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for n, ring in RINGS.items() for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]) + ") s(area, x1, y1, x2, y2)"
_LINKED = f"""WITH RECURSIVE {_POINTS}, b AS (SELECT q.vec_id AS s, p.vec_id AS t FROM p q JOIN p ON p.vec_id <> q.vec_id AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= {LINK_REACH ** 2}),
r(node, c) USING KEY (node) AS (SELECT vec_id, vec_id FROM p UNION SELECT b.t, min(r.c) FROM r JOIN b ON b.s = r.node JOIN recurring.r old ON old.node = b.t WHERE r.c < old.c GROUP BY b.t)"""

ORACLE_SQL = {
    "weekly_access": f"""WITH RECURSIVE {Q._EDGES}, {Q._INCREMENTS}, rain AS (SELECT user_id, week_start, round(sum(mm), 6) AS mm FROM i GROUP BY ALL),
g AS (SELECT week_start, scenario, a, b, w, (['paved', 'unpaved', 'unknown'])[CAST((a + b) % 3 + 1 AS INT)] AS surface FROM e CROSS JOIN (SELECT DISTINCT week_start FROM rain) CROSS JOIN {Q._SQL_SCENARIOS}),
t AS (SELECT g.*, coalesce(mm, 0.0) AS mm, CASE WHEN {Q._SQL_EFFECTIVE} = 'paved' THEN 'paved' ELSE 'unpaved' END AS road_type FROM g LEFT JOIN rain ON rain.week_start = g.week_start AND user_id = a),
c AS (SELECT week_start, scenario, a, b, w / greatest(CAST(m AS DOUBLE), 0.01) AS w FROM t LEFT JOIN {Q._SQL_RULES} ON r.t = road_type AND mm >= lo AND (hi IS NULL OR mm < hi)),
d AS (SELECT week_start, scenario, a AS s, b AS t, w FROM c UNION ALL SELECT week_start, scenario, b, a, w FROM c),
x(week_start, scenario, origin, node, cost) USING KEY (week_start, scenario, origin, node) AS (SELECT week_start, scenario, s_suppkey, s_suppkey, CAST(0 AS DOUBLE) FROM ({_FIRST}) CROSS JOIN (SELECT DISTINCT week_start, scenario FROM c)
UNION SELECT x.week_start, x.scenario, x.origin, d.t, min(x.cost + d.w) FROM x JOIN d ON d.s = x.node AND d.week_start = x.week_start AND d.scenario = x.scenario LEFT JOIN recurring.x old ON old.origin = x.origin AND old.node = d.t AND old.week_start = x.week_start AND old.scenario = x.scenario WHERE old.cost IS NULL OR x.cost + d.w < old.cost GROUP BY ALL)
SELECT week_start, scenario, origin, count(*) AS reached, round(max(cost), 6) AS farthest, round(min(cost), 6) AS nearest, CASE WHEN min(cost) > 0 THEN 'ok' ELSE 'no_cost' END AS status FROM x WHERE node <> origin GROUP BY week_start, scenario, origin""",
    "factor_boxplots": f"""WITH {_LONG}, h AS (SELECT week_start, factor, surface, v, count(*) AS c FROM l GROUP BY ALL),
f AS (SELECT week_start, factor, v, CAST(sum(sum(c)) OVER (PARTITION BY week_start, factor ORDER BY v) AS DOUBLE) / CAST(sum(sum(c)) OVER (PARTITION BY week_start, factor) AS DOUBLE) * 100 AS pct FROM h GROUP BY week_start, factor, v),
k AS (SELECT week_start, factor, scenario, scope, pct, sum(c) AS c FROM h JOIN f USING (week_start, factor, v) CROSS JOIN {Q._SQL_SCENARIOS} CROSS JOIN (VALUES ('all'), ('paved'), ('unpaved')) z(scope) WHERE scope = 'all' OR {Q._SQL_EFFECTIVE} = scope GROUP BY ALL),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY week_start, factor, scenario, scope ORDER BY pct) AS BIGINT) AS cum, CAST(sum(c) OVER (PARTITION BY week_start, factor, scenario, scope) AS BIGINT) AS n FROM k)
SELECT week_start, factor, scenario, scope, max(n) AS n, round(min(pct), 6) AS v_min, round(min(pct) FILTER (cum >= ceil(n * 0.25)), 6) AS q25, round(min(pct) FILTER (cum >= ceil(n * 0.5)), 6) AS q50, round(min(pct) FILTER (cum >= ceil(n * 0.75)), 6) AS q75, round(max(pct), 6) AS v_max FROM r GROUP BY ALL""",
    "rule_severity": f"""WITH {_LONG} SELECT week_start, factor, CASE WHEN factor = 'price' THEN CASE WHEN v <= 5000 THEN 'severe' WHEN v <= 20000 THEN 'minor' ELSE 'none' END
WHEN surface = 'unpaved' THEN CASE WHEN v >= 40 THEN 'severe' WHEN v >= 25 THEN 'moderate' WHEN v >= 10 THEN 'minor' ELSE 'none' END WHEN surface = 'paved' THEN CASE WHEN v >= 45 THEN 'severe' WHEN v >= 30 THEN 'minor' ELSE 'none' END ELSE 'none' END AS severity, count(*) AS n FROM l GROUP BY ALL""",
    "weekly_increment_stats": f"""WITH j AS (SELECT user_id, value, {_SHIFTED_WEEK} AS week_start, lag(value) OVER (PARTITION BY user_id, {_SHIFTED_WEEK} ORDER BY ts, event_id) AS p FROM events), m AS (SELECT user_id, week_start, {_RISE} AS mm FROM j)
SELECT user_id, week_start, count(mm) AS hours, round(sum(mm), 4) AS mm, round(sum(mm), 2) / count(mm) AS mean_mm, round(quantile_cont(mm, 0.5), 4) AS median_mm, round(max(mm), 4) AS hour_mm FROM m GROUP BY ALL""",
    "wettest_day_increments": f"""WITH j AS (SELECT user_id, value, CAST(ts - INTERVAL 1 HOUR AS date) AS ts, lag(value) OVER (PARTITION BY user_id, CAST(ts - INTERVAL 1 HOUR AS date) ORDER BY ts, event_id) AS p FROM events), m AS (SELECT user_id, ts, sum({_RISE}) AS mm FROM j GROUP BY ALL)
SELECT user_id, {Q._SQL_EVENT_WEEK} AS week_start, round(max(mm), 4) AS day_mm FROM m GROUP BY ALL""",
    "knn_left": f"""WITH {_POINTS}, n AS (SELECT q.vec_id AS origin, p.vec_id AS station, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS far FROM p q JOIN p ON p.vec_id <> q.vec_id AND p.label = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY far, station) AS i FROM n WHERE far <= {CAP ** 2}) WHERE i = 1) SELECT p.vec_id AS origin, station, round(far, 6) AS d2 FROM p LEFT JOIN k ON k.origin = p.vec_id""",
    "area_points": f"""WITH {_POINTS}, i AS (SELECT vec_id, area FROM p JOIN {_SIDES} ON ((y1 > y) <> (y2 > y)) AND x < (y - y1) * (x2 - x1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) SELECT p.vec_id, coalesce(area, 'none') AS area FROM p LEFT JOIN i USING (vec_id)""",
    "conditional_weighted_mean": f"WITH {Q._ROADS} SELECT l_suppkey, round(sum(greatest(l_quantity, 1) * l_extendedprice) FILTER (surface = 'unpaved') / sum(greatest(l_quantity, 1)) FILTER (surface = 'unpaved'), 3) AS mean_price, count(*) FILTER (surface = 'unpaved') AS n FROM roads GROUP BY ALL",
    "column_stats": "WITH u AS (SELECT 's_acctbal' AS name, s_acctbal AS v FROM supplier UNION ALL SELECT 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier) SELECT name, count(*) AS n_total, count(v) AS n_with_value, count(*) FILTER (v > 0) AS n_positive, min(v) AS v_min, max(v) AS v_max, round(avg(v), 4) AS v_mean FROM u GROUP BY ALL",
    "point_components": f"{_LINKED} SELECT node, c AS component FROM r",
    "component_ranks": f"{_LINKED} SELECT c AS component, count(*) AS nodes, row_number() OVER (ORDER BY count(*) DESC, c) AS rank, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM r GROUP BY c",
    "closest_to_mean": "WITH m AS (SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY ALL) SELECT user_id, event_id, far FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY far, ts, event_id) AS k FROM (SELECT e.*, round(abs(value - mean), 6) AS far FROM events e JOIN m USING (user_id))) WHERE k = 1",
    "country_queue": "SELECT n_nationkey, count(c_custkey) AS customers, row_number() OVER (ORDER BY n_regionkey, count(c_custkey) DESC, n_name, n_nationkey) AS place FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey, n_name",
    "node_table": f"WITH {_POINTS}, u AS (SELECT x, y FROM p UNION ALL SELECT x + 0.000001, y FROM p) SELECT md5(printf('%.5f', round(x, 5) + 0.0) || ':' || printf('%.5f', round(y, 5) + 0.0)) AS node, count(*) AS ends, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM u GROUP BY 1",
    "nearest_city": f"WITH RECURSIVE {Q._EDGES}, " + Q.ORACLE_SQL["sssp_costs"].partition("r(origin, node, cost)")[1] + Q.ORACLE_SQL["sssp_costs"].partition("r(origin, node, cost)")[2].rpartition(" SELECT origin")[0]
    + ", k AS (SELECT origin, node AS city, cost, row_number() OVER (PARTITION BY origin ORDER BY cost, node) AS i FROM r JOIN supplier h ON h.s_suppkey = origin JOIN supplier t ON t.s_suppkey = node WHERE h.s_nationkey <> t.s_nationkey) SELECT origin, city, cost FROM k WHERE i = 1",
    "haversine_to_origin": f"WITH {_POINTS} SELECT vec_id, round(2 * {X.EARTH_KM} * asin(sqrt(least(1.0, sin(radians(y) / 2) ** 2 + cos(radians(y)) * sin(radians(x) / 2) ** 2))), 4) AS km FROM p",
    "delay_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY ALL",
    "spearman_matrix": "WITH u AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {n}" for n, c in (("key", "p_partkey"), ("price", "p_retailprice"), ("size", "p_size"))) + " FROM part) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM u" for a in ("key", "price", "size") for b in ("key", "price", "size")),
    "affected_mean": f"WITH w AS (SELECT user_id, {Q._SQL_EVENT_WEEK} AS week_start, max(value) AS v FROM events GROUP BY ALL) SELECT user_id, count(*) FILTER (v > 150) AS weeks, round(coalesce(avg(v - 150) FILTER (v > 150), 0), 6) AS mean_excess FROM w GROUP BY ALL",
    "static_weekly_merge": f"WITH {Q._INCREMENTS}, g AS (SELECT user_id, week_start, round(sum(mm), 6) AS mm FROM i GROUP BY ALL) SELECT s_suppkey AS cell, week_start, round(coalesce(mm, s_acctbal), 6) AS mm FROM supplier LEFT JOIN g ON user_id = s_suppkey",
    "routable_links": "WITH x AS (SELECT (['motorway', 'Footway', 'primary', 'steps', 'tertiary', 'cycleway', 'track'])[CAST(l_partkey % 7 + 1 AS INT)] AS highway, greatest(l_discount * 10, 1e-6) AS cost FROM lineitem) SELECT highway, count(*) AS n, min(cost) AS least, max(cost) AS most FROM x WHERE highway IN ('motorway', 'primary', 'tertiary', 'track') GROUP BY ALL",
}
