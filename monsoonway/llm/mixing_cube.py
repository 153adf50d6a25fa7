"""Mixing sources to target weights by the cube method.

A source's target asks for ``rate = target / source_size`` times its words. Each document is taken
``floor(rate)`` times, and once more with probability ``rate - floor(rate)``. Which ones is decided
by the cube method (Deville and Tille 2004): the vector of inclusion probabilities moves through the
null space of two constraints, the words and the documents taken, until each move has fixed at least one
document at 0 or 1. A move goes to either end of its segment by a draw that keeps every document's probability; ``seed``
chooses another set of draws. Flights run over blocks of at most about ``BLOCK`` documents of one source; the two
or fewer documents that each block leaves open meet in further flights until a source is one block,
where the landing picks the subset of the last two nearest to the balance. All but that landing
keeps words and documents exactly in balance, and a hot source is spread over many blocks.

Rows. Null text has size 0; a null source is a source, the last one. Repeated rows and null ids take
part as rows of their own. A source without words has target 0. Sizes, targets and draws depend on the
rows and the seed alone, so reruns agree. An empty table gives an empty one; a very long text is one document of its size.
Other columns are ignored by ``mix``; ``apply_mix`` returns them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import WORD, cut

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK = 2048
#: Flights tried for a landing, and how near to the words and documents asked for ends the trials.
FLIGHTS, NEAR = 48, 0.001
_STATE = "doc_id long, source string, size long, source_size long, target double, base int, tie long, blocks long, pi double"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Rows (source, source_size, rows, target): shares of all words by weight, at most ``repeats`` times a source.

    Handing the excess of capped sources to the others by weight ends at
    min(repeats * size, level * weight) for one level, found here from running sums over the
    sources by falling cap per weight. The windows run over one short row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    weighed = totals.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return leveled.select("source", "source_size", "rows", F.least("cap", chosen * F.col("w")).alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, land: bool, draws: np.random.Generator) -> np.ndarray:
    """Move ``pi`` to 0 or 1, keeping sum(pi) and sum(pi * size), until two or fewer stay open.

    With ``land`` those go to the nearest subset by words, then by documents.
    """
    pi = pi.copy()
    eps = 1e-9
    active: list[int] = []
    goal = [float(pi.sum()), float((pi * size).sum())]
    for nxt in [*np.flatnonzero((pi > eps) & (pi < 1 - eps)).tolist(), -1]:
        if nxt >= 0:
            active.append(nxt)
        if len(active) < 3:
            continue
        i, j, k = active
        a, b, c = float(size[i]), float(size[j]), float(size[k])
        u = (b - c, c - a, a - b)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        p = (float(pi[i]), float(pi[j]), float(pi[k]))
        # the farther end of the segment is less likely, so that each probability stays as it is on average
        up = min((1 - x) / y if y > 0 else -x / y for x, y in zip(p, u) if y)
        down = min(x / y if y > 0 else (x - 1) / y for x, y in zip(p, u) if y)
        move = up if draws.random() < down / (up + down) else -down
        for t, x, y in zip(active, p, u):
            v = x + move * y
            pi[t] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
        active = [t for t in active if 0.0 < pi[t] < 1.0]
    if land and active:
        fixed = np.ones(len(pi), bool)
        fixed[active] = False
        rest = (goal[1] - float((pi[fixed] * size[fixed]).sum()), goal[0] - float(pi[fixed].sum()))
        options = [[(m >> i) & 1 for i in range(len(active))] for m in range(1 << len(active))]
        best = min(options, key=lambda o: (abs(sum(x * float(size[t]) for x, t in zip(o, active)) - rest[0]), abs(sum(o) - rest[1]), o))
        for x, t in zip(best, active):
            pi[t] = float(x)
    return pi


def _fly(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Large documents fly first, so that small ones are left for the landing.

        A large one may stay open to the end all the same; the flights that land are repeated with other draws, at most
        ``FLIGHTS`` times, until words and documents are near the balance; the nearest by words, then by documents, counts.
        """
        pdf = pdf.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable")
        size, pi, land = pdf["size"].to_numpy(float), pdf["pi"].to_numpy(float), bool(pdf["blocks"].iloc[0] <= 1)
        own = [seed, len(pdf), *(int(t) & 0xFFFFFFFF for t in pdf["tie"].iloc[:4])]  # draws of this block
        if not land:
            return pdf.assign(pi=flight(size, pi, False, np.random.default_rng(own)))
        words, rows, best = float((size * pi).sum()), float(pi.sum()), None
        for attempt in range(FLIGHTS):
            draws = np.random.default_rng([*own, attempt])
            order = draws.permutation(len(size)) if attempt else np.arange(len(size))
            landed = np.empty(len(size))
            landed[order] = flight(size[order], pi[order], True, draws)
            off = max(abs(float((size * landed).sum()) - words) - NEAR * words, 0.0), max(abs(float(landed.sum()) - rows) - 1.0, 0.0)
            if best is None or off < best[0]:
                best = (off, landed)
            if off == (0.0, 0.0):
                break
        return pdf.assign(pi=best[1])

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, times, taken) for every row of ``docs``."""
    if block < 4:
        raise ValueError("a block must hold 4 documents at least, or the open ones never get fewer")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("text", "doc_id").alias("tie")))
    targets = source_targets(sized, weights, repeats)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = sized.join(targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).withColumn("rate", rate)
    state = state.withColumn("base", F.floor("rate").cast("int")).withColumn("pi", F.col("rate") - F.col("base")).withColumn("blocks", F.ceil(F.col("rows") / block))
    state = state.select("doc_id", "source", "size", "source_size", "target", "base", "tie", "blocks", "pi")
    done = None
    while True:
        place = F.pmod(F.xxhash64(F.lit("block"), "tie", "doc_id", "blocks"), F.col("blocks"))
        state = cut(state.groupBy("source", place.alias("block")).applyInPandas(_fly(seed), _STATE))
        closed = state.where("pi in (0, 1)")
        done = closed if done is None else done.unionByName(closed)
        open_ = state.where("pi not in (0, 1)")
        if open_.isEmpty():
            break
        state = open_.withColumn("blocks", F.ceil(F.col("blocks") * 2 / block))
    times = (F.col("base") + F.col("pi").cast("int")).alias("times")
    return done.select("doc_id", "source", "size", "source_size", "target", times, (F.col("size") * (F.col("base") + F.col("pi").cast("long"))).cast("long").alias("taken"), "tie")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it.

    Equal rows of one document and text are interchangeable: they share their draws.
    """
    chosen = mix(docs, **options).groupBy("doc_id", "tie").agg(F.sum("times").alias("__mix_times"), F.count("*").alias("__mix_rows"))
    keys = [F.coalesce("doc_id", F.lit(0)).alias("__mix_doc"), F.col("doc_id").isNull().alias("__mix_none"), F.col("tie").alias("__mix_tie")]
    own = F.col("doc_id").cast("long")
    keyed = docs.select("*", F.coalesce(own, F.lit(0)).alias("__mix_doc"), own.isNull().alias("__mix_none"), F.xxhash64("text", own).alias("__mix_tie"))
    joined = keyed.join(chosen.select(*keys, "__mix_times", "__mix_rows").where("__mix_times > 0"), ["__mix_doc", "__mix_none", "__mix_tie"])
    # k equal rows share the draws of all k; the first of them carries the remainder. Rows lie by these keys after the join already
    nth = F.row_number().over(Window.partitionBy("__mix_doc", "__mix_none", "__mix_tie").orderBy("__mix_tie"))
    each = F.floor(F.col("__mix_times") / F.col("__mix_rows")) + F.when(nth <= F.col("__mix_times") % F.col("__mix_rows"), 1).otherwise(0)
    return joined.withColumn("__mix_each", each.cast("int")).where("__mix_each > 0").withColumn("__mix_each", F.explode(F.array_repeat(F.lit(0), F.col("__mix_each")))).select(*(F.col(f"`{c}`") for c in docs.columns))
