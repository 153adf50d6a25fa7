"""DataFrame operators of the analytics: penalties, weekly series, distributions, ranks and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import ranks as K


def with_rain_multiplier(rows: DataFrame, road_type: str, mm: str) -> DataFrame:
    """Look the speed multiplier up by half-open rain ranges.

    The ten rules are a fixed table, broadcast as such; each row meets one rule, so nothing fans out.
    """
    rules = rows.sparkSession.createDataFrame(list(X.RAIN_RULES), "rule_type string, rule_min double, rule_max double, multiplier double")
    hit = (F.col(road_type) == F.col("rule_type")) & (F.col(mm) >= F.col("rule_min")) & (F.col("rule_max").isNull() | (F.col(mm) < F.col("rule_max")))
    return rows.join(F.broadcast(rules), hit, "left").drop("rule_type", "rule_min", "rule_max")


#: A fall of an accumulating series by more than this is a reset; a smaller one is noise.
RESET_MM = 0.01


def increments(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, scale: float = 1.0) -> DataFrame:
    """First differences of an accumulating series in its window, its values times ``scale`` (1000 from metres to mm).

    The first value counts itself, and so does one after a reset; a smaller fall counts 0. A null value, and the one after it, give null.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.col(value) * scale
    rise = now - F.lag(now).over(w)
    step = F.when((F.row_number().over(w) == 1) | (rise < -RESET_MM), now).otherwise(F.when(rise.isNotNull(), F.greatest(rise, F.lit(0.0))))
    return rows.withColumn(name, F.when(step < 0, 0.0).otherwise(step))


_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def five_numbers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, minimum, quartiles, maximum and mean of each group."""
    counts = K.running(K.counted(rows, keys, value), keys, value)
    mean = F.sum(F.col(value) * F.col("count")) / F.nullif(F.sum("count"), F.lit(0))
    return counts.groupBy(*keys).agg(F.sum("count").alias("n"), F.min(value).alias("v_min"), *K.quantile_columns(_QUARTILES, value), F.max(value).alias("v_max"), mean.alias("v_mean"))


def five_numbers_of(counts: DataFrame, keys: list[str], value: str, n: str = "count") -> DataFrame:
    """``five_numbers`` of a histogram, whose rows (keys, value, n) may repeat; the mean is exact in millionths."""
    merged = K.running(counts.groupBy(*keys, value).agg(F.sum(n).alias(n)), keys, value, n)
    mean = F.round(F.sum((F.col(value) * F.col(n)).cast("decimal(38,6)")).cast("decimal(28,6)") / F.sum(n), 6).cast("double")
    return merged.groupBy(*keys).agg(F.sum(n).alias("n"), F.min(value).alias("v_min"), *K.quantile_columns(_QUARTILES, value, n), F.max(value).alias("v_max"), mean.alias("v_mean"))


def five_numbers_each(counts: DataFrame, keys: list[str], value: str, parts: tuple[str, ...], groups: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """``five_numbers_of`` for groups that are unions of parts: rows (keys, scenario, effective, n, v_min, ..., v_mean) of those that have rows.

    ``counts`` are (keys, surface, value, count), ``parts`` all their surfaces, and ``groups`` (scenario, effective, surfaces). Each value is sorted once, with a count for each part.
    """
    each = counts.groupBy(*keys, value).agg(*(F.coalesce(F.sum(F.when(F.col("surface") == s, F.col("count"))), F.lit(0)).alias(s) for s in parts))
    run = K.running_each(each, keys, value, list(parts))
    plus = lambda prefix, which: sum((F.col(f"{prefix}{s}") for s in which[1:]), F.col(f"{prefix}{which[0]}"))
    at = {which: i for i, which in enumerate(dict.fromkeys(g[2] for g in groups))}
    boxes = []
    for which, i in at.items():
        n, before, total = plus("", which), plus("before_", which), plus("total_", which)
        here = F.when(n > 0, F.col(value))
        mean = F.round(F.sum((F.col(value) * n).cast("decimal(38,6)")).cast("decimal(28,6)") / F.nullif(F.sum(n), F.lit(0)), 6).cast("double")
        quartiles = K.quantile_columns_of(_QUARTILES, value, n, before, total)
        boxes.append(F.struct(F.sum(n).alias("n"), F.min(here).alias("v_min"), *quartiles, F.max(here).alias("v_max"), mean.alias("v_mean")).alias(f"__b{i}"))
    out = F.array(*(F.struct(F.lit(scenario).alias("scenario"), F.lit(effective).alias("effective"), F.col(f"__b{at[which]}").alias("b")) for scenario, effective, which in groups))
    return run.groupBy(*keys).agg(*boxes).select(*keys, F.explode(out).alias("o")).select(*keys, "o.scenario", "o.effective", "o.b.*").where("n > 0")


def histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable counts of each value: the union of two is merged by a sum."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"))


def nearest_rank(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles of a histogram: the smallest value whose running count reaches ceil(q * n)."""
    run = K.running(counts, keys, value)
    reached = lambda q: F.col("before") + F.col("count") >= F.ceil(F.col("total") * q)
    return run.groupBy(*keys).agg(F.max("total").alias("n"), *(F.min(F.when(reached(q), F.col(value))).alias(name) for name, q in shares.items()))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only those from each partition before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` in place of those with the same keys."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def cumulative_share(rows: DataFrame, value: str, tie: str, by: list[str]) -> DataFrame:
    """Rank by falling value and running share of the total."""
    down = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(down).cast("long")).withColumn(
        "cum_share", F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy(*by)))
