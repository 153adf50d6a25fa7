"""The overlay of rain on cells of roads in full, the mechanism behind delays, and parity with stored figures, each with the SQL that gives the same rows.

Stand-ins: suppliers are cells and their lines roads; users of the same number give a cell's hourly rain; orders are routes from the customer's country and
crop (market segment) to the group of destinations that their priority names, and their lines the stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import mechanism as M
from ..operators import relational as R
from . import queries as Q

#: Hours of a route, from its price, that are no burden; how far stored figures may lie off.
FREE_HOURS, TOLERANCE = 15.0, 0.005
_FACTORS = ("sum_mm", "mean_mm", "median_mm", "max_mm")
_KEYS = ["nation", "week_start", "scenario", "scope", "crop", "candidate", "dest_type", "dest_rank", "dest_id"]


def overlay_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's weekly rain for each of nine scenarios and scopes that has roads in it."""
    tally = lambda s: F.count(F.when(F.col("surface") == s, 1)).alias(s)
    summary = Q._road_weeks(spark, sf_dir).groupBy(F.col("l_suppkey").alias("cell")).agg(*map(tally, ("paved", "unpaved", "unknown")))
    events = Q._t(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), X.anchored_week(F.col("ts"), Q.EVENT_ANCHOR).alias("week_start"), "value")
    # a cell has as many values a week as it has hours
    weekly = events.groupBy("cell", "week_start").agg(F.sum("value").alias("sum_mm"), F.avg("value").alias("mean_mm"), F.median("value").alias("median_mm"), F.max("value").alias("max_mm"))
    return M.overlay_scopes(summary, "cell").join(weekly, "cell").select("cell", "week_start", "scenario", "scope", "roads", *(F.round(c, 6).alias(c) for c in _FACTORS))


def overlay_boxplots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of four factors of rain over the cells of each week, scenario and scope."""
    long = overlay_scopes(spark, sf_dir).unpivot(["week_start", "scenario", "scope"], list(_FACTORS), "factor", "v")
    keys = ["week_start", "scenario", "scope", "factor"]
    found = R.five_numbers_of(R.histogram(long, keys, "v"), keys, "v")
    return found.select(*keys, "n", *map(Q._r, ("v_min", "q25", "q50", "q75", "v_max")))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = Q._t(spark, sf_dir, "orders"), Q._t(spark, sf_dir, "customer")
    week = X.anchored_week(F.col("o_orderdate"), Q.ROAD_ANCHOR)
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("crop"), F.col("o_orderpriority").alias("dest_type"), F.col("o_orderkey").alias("route"), week.alias("week_start"),
        F.col("o_custkey").alias("candidate"), F.col("o_orderstatus").alias("scenario"), F.greatest(F.col("o_totalprice") / 10000 - FREE_HOURS, F.lit(0.0)).alias("burden"))


def mechanism_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden, mix of surfaces and impact of rain thresholds by country and crop, with logarithms."""
    keys, routes = ["nation", "crop"], _routes(spark, sf_dir)
    hit = F.col("burden") > 0
    burden = routes.groupBy(*keys).agg(F.round(F.sum("burden"), 6).alias("burden_h"), F.max("burden").alias("peak_h"), F.count_distinct("dest_type").alias("dest_groups"),
                                       F.count("*").alias("weight"), F.count(F.when(hit, 1)).alias("affected_weight"), F.count_distinct(F.when(hit, F.col("week_start"))).alias("affected_weeks"))
    lines = Q._t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), Q._surface().alias("surface"), F.col("l_quantity").alias("h"))
    stretches = lines.groupBy("route", "surface").agg(F.sum("h").alias("h"))
    whole = stretches.groupBy("route").agg(F.sum("h").alias("hours"))
    steps = routes.join(stretches, "route").join(whole, "route").withColumn("share", 100 * F.col("h") / F.col("hours")).withColumn("cells", F.when(F.col("route") % 7 != 0, F.col("route") % 5 + 1))
    mix = M.route_mix(steps, keys, ["route"], "surface", "share", "hours", "cells")
    wet = R.with_rain_multiplier(lines.withColumn("mm", F.col("h") * 7).withColumn("road_type", F.when(F.col("surface") == "paved", "paved").otherwise("unpaved")), "road_type", "mm")
    group = ["week_start", "dest_type"]
    classes = wet.join(routes.select("route", *keys, *group), "route").groupBy(*keys, *group, "surface", "multiplier").agg(F.sum("h").alias("h"))
    base = classes.groupBy(*keys, *group, "surface").agg(F.sum("h").alias("base"))
    penalty = M._joined(classes, base, [*keys, *group, "surface"]).withColumn("wet", X.penalised(F.col("h"), F.col("multiplier"))).withColumn("affected", F.when(F.col("multiplier") < 1, F.col("h")).otherwise(0.0))
    impact = M.threshold_impact(penalty, keys, group, "surface", "wet", "base", "affected", "base")
    found = M.mechanism_frame(burden, mix, impact, keys)
    return found.select(*keys, "burden_h", F.round("peak_h", 6).alias("peak_h"), "dest_groups", "weight", "affected_weight", "affected_weeks", "routes",
                        *(Q._r(c, 4) for c in ("hours", "paved_share", "unpaved_share", "unknown_share", "synthetic_share", "increase_h", "base_h", "affected_km", "impact_ratio", "affected_share", "log_burden", "log_impact", "log_remoteness")))


def stored_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes whose hours were found anew beside the stored ones, by country and outcome: how many, and the greatest difference."""
    routes = _routes(spark, sf_dir)
    new = Q._t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.sum("l_quantity").alias("hours"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("kept"))
    keyed = routes.join(new, "route").withColumn("scope", F.lit("all")).withColumn("dest_rank", F.col("route") % 3).withColumn("dest_id", F.col("route"))
    stored = keyed.where("kept is not null").select(*_KEYS, F.col("kept").alias("hours"))
    found = M.stored_parity(keyed.select(*_KEYS, "hours"), stored, _KEYS, "hours", TOLERANCE)
    return found.groupBy("nation", "parity").agg(F.count("*").alias("n"), F.max(F.abs("difference")).alias("most"))


QUERIES = {f.__name__: f for f in (overlay_scopes, overlay_boxplots, mechanism_crops, stored_weeks)}

_OVERLAY = f"""{Q._ROADS}, c AS (SELECT l_suppkey AS cell, count(*) AS a, count(*) FILTER (surface = 'paved') AS p, count(*) FILTER (surface = 'unpaved') AS u, count(*) FILTER (surface = 'unknown') AS x FROM roads GROUP BY ALL),
s AS (SELECT cell, unnest(['actual_unpaved', 'actual_unpaved', 'actual_unpaved', 'unknown_as_paved', 'unknown_as_paved', 'unknown_as_paved', 'unknown_as_unpaved', 'unknown_as_unpaved', 'unknown_as_unpaved']) AS scenario,
unnest(['all', 'paved', 'unpaved', 'all', 'paved', 'unpaved', 'all', 'paved', 'unpaved']) AS scope, unnest([a, p, u, a, p + x, u, a, p, u + x]) AS roads FROM c),
g AS (SELECT user_id AS cell, {Q._SQL_EVENT_WEEK} AS week_start, round(sum(value), 6) AS sum_mm, round(avg(value), 6) AS mean_mm, round(quantile_cont(value, 0.5), 6) AS median_mm, round(max(value), 6) AS max_mm FROM events GROUP BY ALL),
o AS (SELECT cell, week_start, scenario, scope, roads, sum_mm, mean_mm, median_mm, max_mm FROM s JOIN g USING (cell) WHERE scope = 'all' OR roads > 0)"""
_SQL_ROUTES = f"""r AS (SELECT c_nationkey AS nation, c_mktsegment AS crop, o_orderpriority AS dest_type, o_orderkey AS route, date '1995-01-02' + CAST(7 * floor(date_diff('day', date '1995-01-02', CAST(o_orderdate AS date)) / 7) AS INT) AS week_start,
greatest(o_totalprice / 10000 - {FREE_HOURS}, 0.0) AS burden FROM orders JOIN customer ON o_custkey = c_custkey)"""

ORACLE_SQL = {
    "overlay_scopes": f"WITH {_OVERLAY} SELECT * FROM o",
    "overlay_boxplots": f"WITH {_OVERLAY}, f AS (SELECT week_start, scenario, scope, unnest(['sum_mm', 'mean_mm', 'median_mm', 'max_mm']) AS factor, unnest([sum_mm, mean_mm, median_mm, max_mm]) AS v FROM o) SELECT week_start, scenario, scope, factor, {Q._SQL_FIVE.partition(', round(avg')[0]} FROM f WHERE v IS NOT NULL GROUP BY ALL",
    "mechanism_crops": f"""WITH {_SQL_ROUTES}, b AS (SELECT nation, crop, round(sum(burden), 6) AS burden_h, round(max(burden), 6) AS peak_h, count(DISTINCT dest_type) AS dest_groups, count(*) AS weight, count(*) FILTER (burden > 0) AS affected_weight, count(DISTINCT week_start) FILTER (burden > 0) AS affected_weeks FROM r GROUP BY ALL),
l AS (SELECT l_orderkey AS route, {Q._SQL_SURFACE} AS surface, l_quantity AS h FROM lineitem), t AS (SELECT route, sum(h) AS hours, 100 * sum(h) FILTER (surface = 'paved') / sum(h) AS p, 100 * sum(h) FILTER (surface = 'unpaved') / sum(h) AS u, 100 * sum(h) FILTER (surface = 'unknown') / sum(h) AS x,
CASE WHEN route % 7 <> 0 THEN route % 5 + 1 END AS w FROM l GROUP BY ALL), m AS (SELECT nation, crop, count(*) AS routes, coalesce(sum(hours * w) / sum(w), 0) AS hours, coalesce(sum(coalesce(p, 0) * w) / sum(w), 0) AS paved_share, coalesce(sum(coalesce(u, 0) * w) / sum(w), 0) AS unpaved_share, coalesce(sum(coalesce(x, 0) * w) / sum(w), 0) AS unknown_share FROM r JOIN t USING (route) GROUP BY ALL),
a AS (SELECT nation, crop, week_start, dest_type, surface, sum(h) AS base, sum(h / greatest(CAST(m AS DOUBLE), 0.01)) AS wet, sum(CASE WHEN m < 1 THEN h ELSE 0 END) AS km FROM r JOIN l USING (route) JOIN {Q._SQL_RULES} ON t = CASE WHEN surface = 'paved' THEN 'paved' ELSE 'unpaved' END AND h * 7 >= lo AND (hi IS NULL OR h * 7 < hi) WHERE surface <> 'unknown' GROUP BY ALL),
i AS (SELECT nation, crop, sum(greatest(wet - base, 0.0)) AS increase_h, sum(base) AS base_h, sum(km) AS affected_km FROM a GROUP BY ALL)
SELECT nation, crop, burden_h, peak_h, dest_groups, weight, affected_weight, affected_weeks, routes, round(hours, 4) AS hours, round(paved_share, 4) AS paved_share, round(coalesce(unpaved_share, 0), 4) AS unpaved_share, round(unknown_share, 4) AS unknown_share, CASE WHEN routes IS NULL THEN NULL ELSE CAST(0 AS DOUBLE) END AS synthetic_share,
round(increase_h, 4) AS increase_h, round(base_h, 4) AS base_h, round(affected_km, 4) AS affected_km, round(coalesce(increase_h / base_h, 0), 4) AS impact_ratio, round(affected_km / base_h, 4) AS affected_share, round(ln(1 + burden_h), 4) AS log_burden, round(ln(1 + coalesce(increase_h / base_h, 0)), 4) AS log_impact, round(ln(1 + hours), 4) AS log_remoteness
FROM b LEFT JOIN m ON m.nation IS NOT DISTINCT FROM b.nation AND m.crop IS NOT DISTINCT FROM b.crop LEFT JOIN i ON i.nation IS NOT DISTINCT FROM b.nation AND i.crop IS NOT DISTINCT FROM b.crop""".replace("SELECT nation, crop, burden_h", "SELECT b.nation, b.crop, burden_h"),
    "stored_weeks": f"""WITH {_SQL_ROUTES}, n AS (SELECT nation, sum(l_quantity) AS hours, sum(l_quantity) FILTER (l_linestatus = 'F') AS kept FROM r JOIN lineitem ON l_orderkey = route GROUP BY nation, route)
SELECT nation, CASE WHEN kept IS NULL THEN 'missing' WHEN abs(hours - kept) <= {TOLERANCE} THEN 'equal' ELSE 'differs' END AS parity, count(*) AS n, max(abs(hours - kept)) AS most FROM n GROUP BY ALL""",
}
