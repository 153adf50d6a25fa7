"""Why routes lose time: the mix of surfaces along routes, what rain thresholds take, and both beside the burden; and new figures beside stored ones.

Every frame is aggregated by keys that may hold nulls, which group together. Means are weighted over rows with a value and a weight, and 0 where these
weights sum to nothing; ratios over nothing are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Surfaces and scopes of the overlay, by scenario: what unknown roads count as.
SCOPES = ("all", "paved", "unpaved")
UNKNOWN_AS = {"actual_unpaved": None, "unknown_as_paved": "paved", "unknown_as_unpaved": "unpaved"}
EQUAL, DIFFERS, MISSING = "equal", "differs", "missing"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet null keys, as groups do."""
    met = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return left.alias("l").join(right.alias("r"), met, "left").select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in keys))


def overlay_scopes(summary: DataFrame, cell: str) -> DataFrame:
    """Rows (cell, scenario, scope, roads): of ``summary(cell, paved, unpaved, unknown)``, counts of roads, every scope of a scenario that has roads there.

    The nine combinations are an array of a row, so nothing is joined. A scope ``all`` stays even without roads. Null counts are 0.
    """
    n = {s: F.coalesce(F.col(s), F.lit(0)).cast("long") for s in ("paved", "unpaved", "unknown")}
    each = []
    for scenario, taken in UNKNOWN_AS.items():
        for scope in SCOPES:
            roads = n["paved"] + n["unpaved"] + n["unknown"] if scope == "all" else n[scope] + (n["unknown"] if scope == taken else F.lit(0))
            each.append(F.struct(F.lit(scenario).alias("scenario"), F.lit(scope).alias("scope"), roads.alias("roads")))
    kept = F.filter(F.array(*each), lambda s: (s["scope"] == "all") | (s["roads"] > 0))
    return summary.select(cell, F.explode(kept).alias("s")).select(cell, "s.*")


def route_mix(steps: DataFrame, keys: list[str], route: list[str], surface: str, share: str, hours: str, weight: str) -> DataFrame:
    """Rows (keys, routes, hours, and a weighted mean share of each surface) of ``steps``, one row for each route and surface.

    ``hours`` and ``weight`` are a route's, repeated in its rows, and count once. A surface whose name holds "synthetic" counts as synthetic.
    """
    named = {"paved": F.col(surface) == "paved", "unpaved": F.col(surface) == "unpaved", "unknown": F.col(surface) == "unknown", "synthetic": F.col(surface).contains("synthetic")}
    shares = [F.sum(F.when(test, F.col(share)).otherwise(0.0)).alias(f"{s}_share") for s, test in named.items()]
    routes = steps.groupBy(*dict.fromkeys([*keys, *route])).agg(F.max(hours).alias("hours"), F.max(weight).alias("weight"), *shares)
    held = lambda c: F.col(c).isNotNull() & F.col("weight").isNotNull()
    mean = lambda c: F.coalesce(F.sum(F.when(held(c), F.col(c) * F.col("weight"))) / F.nullif(F.sum(F.when(held(c), F.col("weight"))).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    return routes.groupBy(*keys).agg(F.count("*").alias("routes"), *(mean(c) for c in ("hours", *(f"{s}_share" for s in named))))


def threshold_impact(rows: DataFrame, keys: list[str], group: list[str], surface: str, wet: str, base: str, affected: str, length: str) -> DataFrame:
    """Rows (keys, increase_h, base_h, affected_km, base_km, impact_ratio, affected_share) of paved and unpaved ``rows``.

    Within a group (keys, ``group``, surface) wet hours and affected lengths add up; ``base`` and ``length`` are the group's, repeated in its rows, and
    count once. A group that wet weather makes faster adds no increase.
    """
    per = rows.where(F.col(surface).isin("paved", "unpaved")).groupBy(*dict.fromkeys([*keys, *group, surface])).agg(F.sum(wet).alias("wet"), F.max(base).alias("base"), F.sum(affected).alias("km"), F.max(length).alias("all_km"))
    rise = F.greatest(F.col("wet") - F.col("base"), F.lit(0.0))
    # a group without a base has no increase
    rise = F.when(F.col("wet").isNotNull() & F.col("base").isNotNull(), rise)
    summed = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    found = per.groupBy(*keys).agg(summed(rise, "increase_h"), summed("base", "base_h"), summed("km", "affected_km"), summed("all_km", "base_km"))
    return found.withColumn("impact_ratio", _ratio(F.col("increase_h"), F.col("base_h"))).withColumn("affected_share", _ratio(F.col("affected_km"), F.col("base_km")))


def mechanism_frame(burden: DataFrame, mix: DataFrame, impact: DataFrame, keys: list[str]) -> DataFrame:
    """``burden(keys, burden_h, ...)`` with the mix and the impact of its keys and logarithms of burden, impact and remoteness.

    Keys without routes have no mix, and 0 as share of unpaved time; keys without thresholds an impact of 0.
    """
    found = _joined(_joined(burden, mix, keys), impact, keys).fillna(0.0, ["impact_ratio", "unpaved_share"])
    return found.withColumns({"log_burden": F.log1p("burden_h"), "log_impact": F.log1p("impact_ratio"), "log_remoteness": F.log1p("hours")})


def stored_parity(rows: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Every row of ``rows`` with ``stored_value``, the difference, and whether it is equal, differs or is missing.

    ``stored(keys, value)`` joins by all keys; a null key meets none, as in SQL, and so is missing. Two stored rows of one key give two rows. Null values differ from all but null.
    """
    kept = stored.select(*keys, F.col(value).alias("stored_value"), F.lit(True).alias("found"))
    found = rows.join(kept, keys, "left").withColumn("difference", F.col(value) - F.col("stored_value"))
    same = (F.abs("difference") <= tolerance) | (F.col(value).isNull() & F.col("stored_value").isNull())
    return found.withColumn("parity", F.when(F.col("found").isNull(), MISSING).when(same, EQUAL).otherwise(DIFFERS)).drop("found")
