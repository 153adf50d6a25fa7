"""Rule-driven factor statistics: which rules apply, what they need, and distributions of factor values by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks as K
from . import relational as R

LEVELS = ("minor", "moderate", "severe", "catastrophic", "closure")
SCOPES = ("all", "paved", "unpaved")


def parsed_rules(rows: list[dict]) -> list[dict]:
    """Threshold rules, the first of each (factor, scope): direction gte or lte, a number or None for each level."""

    def number(text) -> float | None:
        try:
            value = float(text)
        except (TypeError, ValueError):
            return None
        return value if value == value else None

    out: dict[tuple[str, str], dict] = {}
    for r in rows:
        key = (str(r["factor"]).strip().lower(), str(r.get("scope") or "all").strip().lower())
        direction = str(r.get("direction") or "gte").strip().lower()
        if direction not in ("gte", "lte"):
            raise ValueError(f"direction of {key} is {direction}, not gte or lte")
        out.setdefault(key, {"factor": key[0], "scope": key[1], "direction": direction, "levels": {n: number(r.get(n)) for n in LEVELS}})
    return list(out.values())


def needed_factors(rules: list[dict], suffix: str = "_percentile") -> list[str]:
    """Factors that must be read: a percentile rule needs its base factor."""
    return sorted({r["factor"].removesuffix(suffix) for r in rules})


def routed(rules: list[dict], sources: dict[str, str], flood: bool = True) -> dict[str, list[str]]:
    """Factors by the source that holds them; those of floods fall away where floods are switched off."""
    out: dict[str, list[str]] = {}
    for name in needed_factors(rules):
        source = sources.get(name)
        if source and (flood or not source.startswith("flood")):
            out.setdefault(source, []).append(name)
    return out


def in_scope(surface: Column, scope: str, scenario: str) -> Column:
    """Whether a road of ``surface`` is in a scope: all (also any, both, \\*), a surface under the scenario (also effective_...), or actual_... as mapped."""
    scope = scope.lower().removeprefix("effective_")
    if scope in ("all", "any", "both", "*", ""):
        return F.lit(True)
    known = F.coalesce(F.lower(surface), F.lit("unknown"))
    if scope.startswith("actual_"):
        return known == scope.removeprefix("actual_")
    taken = scenario in ("unknown_as_paved", "unknown_as_unpaved") and scenario.removeprefix("unknown_as_") == scope
    return (known == scope) | (known == "unknown") if taken else known == scope


def merged_histograms(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Histograms of chunks as one: counts of equal values add up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys, value).agg(F.sum("count").alias("count"))


def cdf_percentiles(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, value, pct): the share of a histogram's values at or below each, of 100."""
    run = K.running(counts, keys, value)
    return run.select(*keys, value, ((F.col("before") + F.col("count")) / F.col("total") * 100).alias("pct"))


def scoped_percentiles(raw: DataFrame, scoped: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, pct, count): the histogram ``scoped`` with each value as its percentile among those of ``raw``."""
    mapped = scoped.join(cdf_percentiles(raw, keys, value), [*keys, value])
    by = [c for c in scoped.columns if c not in (value, "count")]
    return mapped.groupBy(*by, "pct").agg(F.sum("count").alias("count"))


def boxplots(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, least, nearest-rank quartiles and greatest of each histogram."""
    ends = counts.groupBy(*keys).agg(F.min(value).alias("v_min"), F.max(value).alias("v_max"))
    return R.nearest_rank(counts, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).join(ends, keys)


def scope_boxplots(counts: DataFrame, keys: list[str], value: str, surfaces: tuple[str, ...], scopes: list[tuple[str, str]]) -> DataFrame:
    """Boxes (keys, scenario, scope, n, v_min, q25, q50, q75, v_max) of percentiles among all values of ``counts(keys, surface, value, count)``, for each (scenario, scope) that has rows.

    As ``boxplots`` of ``scoped_percentiles``, but each value is sorted once, with a count for each of ``surfaces``, which are all there are: a scope's counts are sums
    of those, and percentiles rise with the value, so nothing is expanded by scope or joined by value.
    """
    each = counts.groupBy(*keys, value).agg(*(F.coalesce(F.sum(F.when(F.col("surface") == s, F.col("count"))), F.lit(0)).alias(s) for s in surfaces))
    run = K.running_each(each, keys, value, list(surfaces))
    plus = lambda prefix, which: sum((F.col(f"{prefix}{s}") for s in which), F.lit(0).cast("long"))
    inside = lambda scope, scenario: [F.when(in_scope(F.lit(s), scope, scenario), F.lit(1)).otherwise(F.lit(0)) for s in surfaces]
    names = [f"__{i}" for i in range(len(scopes))]
    spark = counts.sparkSession
    held = spark.range(1).select(*(F.array(*inside(scope, scenario)).alias(n) for n, (scenario, scope) in zip(names, scopes))).first()  # one row of flags
    sets = {n: tuple(s for s, on in zip(surfaces, held[n]) if on) for n in names}
    run = run.withColumn("__pct", (plus("before_", surfaces) + plus("", surfaces)) / plus("total_", surfaces) * 100)
    boxes, at = [], {}
    for which in dict.fromkeys(sets.values()):
        own, total = plus("", which), plus("total_", which)
        upto = plus("before_", which) + own
        at[which] = f"__b{len(at)}"
        here = F.when(own > 0, F.col("__pct"))
        quartiles = [F.min(F.when(upto >= F.ceil(total * q), F.col("__pct"))).alias(name) for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        boxes.append(F.struct(F.max(total).alias("n"), F.min(here).alias("v_min"), *quartiles, F.max(here).alias("v_max")).alias(at[which]))
    found = run.groupBy(*keys).agg(*boxes)
    out = F.array(*(F.struct(F.lit(scenario).alias("scenario"), F.lit(scope).alias("scope"), F.col(at[sets[n]]).alias("b")) for n, (scenario, scope) in zip(names, scopes)))
    return found.select(*keys, F.explode(out).alias("o")).select(*keys, "o.scenario", "o.scope", "o.b.*").where("n > 0")
