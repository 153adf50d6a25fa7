"""Running counts over sorted values in ranges, and the ranks, percentiles and quantiles that follow from them.

Values are counted first, where each task has them. The counts are range-partitioned by group and value into runs; what comes before a run follows from one
sum for each run, and inside a run from a window over that run alone. So a group of any number of distinct values is spread over as many tasks as it needs, a single group
as well as many, and a quantile is the one row whose counts enclose its place. Nothing keeps a group's values in one buffer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import checkpointed


def _same(left: str, right: str, names: list[str]) -> Column:
    """Equality of columns in which null equals null."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names))


def running(counts: DataFrame, keys: list[str], value: str, n: str = "count") -> DataFrame:
    """``counts`` (one row for each group and value, and more columns) with ``before``, the counts of smaller values, and ``total``, those of the group.

    Null sorts first and NaN last. A null in ``keys`` is a group of its own. A count may be 0.
    """
    dealt = counts.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    runs = checkpointed(dealt.withColumn("__run", F.spark_partition_id()))
    of_group = Window.partitionBy(*keys)
    ahead = of_group.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group in each run that it reaches into
    per = runs.groupBy(*keys, "__run").agg(F.sum(n).alias("__n"))
    per = per.select(*keys, "__run", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__n").over(of_group).alias("total"))
    in_run = Window.partitionBy(*keys, "__run").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = runs.withColumn("__in", F.coalesce(F.sum(n).over(in_run), F.lit(0)))
    joined = within.alias("l").join(per.alias("r"), _same("l", "r", [*keys, "__run"]))
    return joined.select(*(F.col(f"l.{c}") for c in counts.columns), (F.col("r.__ahead") + F.col("l.__in")).cast("long").alias("before"), F.col("r.total").cast("long").alias("total"))


def running_each(counts: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """``counts`` with ``before_<name>`` and ``total_<name>`` for each count of ``names``, as ``running`` gives them for one; all from one sort."""
    dealt = counts.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    runs = checkpointed(dealt.withColumn("__run", F.spark_partition_id()))
    of_group = Window.partitionBy(*keys)
    ahead = of_group.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    per = runs.groupBy(*keys, "__run").agg(*(F.sum(n).alias(n) for n in names))
    per = per.select(*keys, "__run", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__ahead_{n}") for n in names), *(F.sum(n).over(of_group).cast("long").alias(f"total_{n}") for n in names))
    in_run = Window.partitionBy(*keys, "__run").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = runs.withColumns({f"__in_{n}": F.coalesce(F.sum(n).over(in_run), F.lit(0)) for n in names})
    joined = within.alias("l").join(per.alias("r"), _same("l", "r", [*keys, "__run"]))
    return joined.select(*(F.col(f"l.{c}") for c in counts.columns), *((F.col(f"r.__ahead_{n}") + F.col(f"l.__in_{n}")).cast("long").alias(f"before_{n}") for n in names), *(F.col(f"r.total_{n}") for n in names))


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, value, count); null values stay with a count of 0, so that their group does."""
    return rows.groupBy(*keys, value).agg(F.count(value).alias("count"))


def quantile_columns_of(shares: dict[str, float], value: str, n: Column, before: Column, total: Column) -> list[Column]:
    """Aggregates over rows with their count ``n``, the count ``before`` and the ``total`` of their group: quantiles that interpolate between the two values about ``share * (total - 1)``."""
    held = lambda place: F.max(F.when((before <= place) & (place < before + n), F.col(value)))  # noqa: E731  the value at a place, counted from 0
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.max(total) - 1)
        at = F.lit(share) * (total - 1)
        low, high = F.floor(place), F.ceil(place)
        under, over = held(F.floor(at)), held(F.ceil(at))
        out.append(F.when(low == high, under).otherwise((high - place) * under + (place - low) * over).alias(name))
    return out


def quantile_columns(shares: dict[str, float], value: str, n: str = "count") -> list[Column]:
    """``quantile_columns_of`` over ``running`` rows."""
    return quantile_columns_of(shares, value, F.col(n), F.col("before"), F.col("total"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Rows (keys, n, a column for each of ``shares``): exact quantiles of the values that are not null; null for a group without any."""
    return running(counted(rows, keys, value), keys, value).groupBy(*keys).agg(F.sum("count").alias("n"), *quantile_columns(shares, value))


def with_percentile(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the average percentile rank of ``value`` in its group, above 0 to 100, ties sharing theirs; null for null."""
    counts = running(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count")), keys, value)
    rank = F.col("before") + (F.col("count") + 1) / 2
    found = counts.select(*keys, value, (rank / F.col("total") * 100).alias("__pct"))
    joined = rows.alias("l").join(found.alias("r"), _same("l", "r", [*keys, value]), "left")
    return joined.select(*(F.col(f"l.{c}") for c in rows.columns), F.col("r.__pct").alias(name))


def with_dense_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the number of distinct values from the largest down to its own; null has none."""
    distinct = running(rows.where(F.col(value).isNotNull()).select(value).distinct().withColumn("count", F.lit(1).cast("long")), [], value)
    return rows.join(distinct.select(value, (F.col("total") - F.col("before")).alias(name)), value, "left").select(*rows.columns, name)
