"""Sharding by vector bin packing over bytes, words and rows.

Documents with equal texts are a group, and a group is placed where the dot product of its (bytes, words, rows) with
the shard's residual capacity is highest among the shards that hold it. Groups go by falling size. Those over
1 / (shards * FINE) of all bytes are placed one by one, at most shards * FINE of them. The others are placed through their
size class: groups of a class have the same bytes (below ``EXACT``) or nearly the same, nearly the same words and about
the same rows, so a class is placed in lots of ever the same size until it is used up, and its groups take the
places by rank. So the driver plans a bounded number of lots at any scale, and each group goes where the rule puts it.
A group larger than a whole shard cannot lie in one if shards are to be equal: it alone is split, by a hash of
the document id.

Rows. Null text has size 1, as empty text has, and is a group with it. Null ids and repeated rows are
rows of their own. A very long text is a group like any other; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import WORD, cut

SHARDS = 8
FINE = 256
#: Groups of fewer bytes share a class only with groups of as many; others with those of a 64th of an octave.
EXACT, STEPS = 1024, 64
#: Lots that would fill a shard.
LOTS = 1024
#: Parts of a shard's size that a group larger than a shard is split into.
SPLIT = 32
#: Rows of a shard, or groups of a class, that share a numbering task, and the least number of such tasks.
NUMBERED, LEAST_PARTS = 100_000, 16


class Shards:
    """Residual capacities of shards, as shares of an even one in bytes, words and rows."""

    def __init__(self, total: np.ndarray, shards: int) -> None:
        self.capacity = np.maximum(np.asarray(total, float) / shards, 1e-12)
        self.residual = np.ones((shards, 3))

    def put(self, item: np.ndarray) -> int:
        share = item / self.capacity
        fits = (self.residual >= share - 1e-12).all(axis=1)
        if fits.any():
            best = int(np.where(fits, np.clip(self.residual, 0, None) @ share, -np.inf).argmax())
        else:
            # no shard holds it: the one that it overfills least, in any respect
            best = int((self.residual - share).min(axis=1).argmax())
        self.residual[best] -= share
        return best


def place(items: np.ndarray, counts: np.ndarray, total: np.ndarray, shards: int, lots: int = LOTS) -> list[list[tuple[int, int]]]:
    """For each item (bytes, words, rows) that stands for ``counts`` groups: (first rank, shard) of its lots, by vector bin packing."""
    items = np.asarray(items, float).reshape(-1, 3)
    held = Shards(total, shards)
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    for i in np.lexsort((np.arange(len(items)), -items[:, 0])).tolist():
        # a lot is small beside a shard in every respect
        lot = max(1, int(1 / max(float((items[i] / held.capacity).max()) * lots, 1e-12)))
        for first in range(0, int(counts[i]), lot):
            out[i].append((first, held.put(items[i] * min(lot, int(counts[i]) - first))))
    return out


def _class(size: Column, words: Column, rows: Column) -> Column:
    step = lambda x, n: F.floor(F.log2(x.cast("double")) * n)
    return F.struct(F.when(size < EXACT, size).otherwise(EXACT + step(size / EXACT, STEPS)).cast("long").alias("b"), step(words + 1, 4).cast("long").alias("w"), step(rows, 2).cast("long").alias("r"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2")))
    sums = (F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count("*").alias("rows"))
    total = rows.agg(*sums).first()
    groups = rows.groupBy("g1", "g2").agg(*sums)
    is_large = F.col("bytes") > total["bytes"] / (shards * FINE)
    own = groups.where(is_large).orderBy(F.desc("bytes"), "g1", "g2").collect()  # fewer than shards * FINE
    split = [(r["g1"], r["g2"], 1 if r["bytes"] <= total["bytes"] / shards else -(-r["bytes"] * shards * SPLIT // total["bytes"])) for r in own]
    large = spark.createDataFrame(split, "own_g1 long, own_g2 long, parts long")
    tagged = rows.join(F.broadcast(large), (F.col("g1") == F.col("own_g1")) & (F.col("g2") == F.col("own_g2")), "left")
    tagged = tagged.withColumn("cut", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.col("parts"))).otherwise(0)).drop("own_g1", "own_g2")
    # large groups and the parts of split ones, each an item of its own; then a class of small ones, each an item that stands for many
    single = tagged.where("parts is not null").groupBy("g1", "g2", "cut").agg(*sums).orderBy("g1", "g2", "cut").collect()
    small = groups.where(~is_large).withColumn("class", _class(F.col("bytes"), F.col("words"), F.col("rows")))
    classes = small.groupBy("class").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("bytes", "words", "rows"))).orderBy("class").collect()
    weights = [(r["bytes"], r["words"], r["rows"]) for r in (*single, *classes)]
    lots = place(np.array(weights), np.array([1] * len(single) + [r["n"] for r in classes]), np.array([total["bytes"], total["words"], total["rows"]], float), shards)

    kept = ("doc_id", "size", "text_crc32", "g1", "shard")
    plan = spark.createDataFrame([(r["g1"], r["g2"], r["cut"], x[0][1]) for r, x in zip(single, lots)], "g1 long, g2 long, cut long, shard int")
    placed = tagged.where("parts is not null").join(F.broadcast(plan), ["g1", "g2", "cut"]).select(*kept)  # at most shards * (FINE + 2 * SPLIT) rows
    by_class = spark.createDataFrame([(tuple(r["class"]), x) for r, x in zip(classes, lots[len(single) :])], "class struct<b: long, w: long, r: long>, lots array<struct<first: long, shard: int>>")
    ranked = _numbered(small.select("g1", "g2", "class"), ["class"], ["g1", "g2"], max((r["n"] for r in classes), default=0))
    # as many classes as sizes can form, whatever the number of groups
    found = ranked.join(F.broadcast(by_class), "class").select("g1", "g2", F.element_at(F.filter("lots", lambda x: x["first"] <= F.col("nth")), -1)["shard"].alias("shard"))
    placed = placed.unionByName(tagged.where("parts is null").drop("parts", "cut", "words").join(found, ["g1", "g2"]).select(*kept))
    numbered = _numbered(placed, ["shard"], ["doc_id", "g1"], total["rows"] // shards)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("nth").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """``rows`` with a gapless number ``nth`` from 0 in each group of ``by``, found in parts of a group of ``most`` rows."""
    parts = max(LEAST_PARTS, most // NUMBERED)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(parts)))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*by, "part").count().select(*by, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))
    return rows.withColumn("nth", nth).join(base, [*by, "part"]).withColumn("nth", (F.col("base") + F.col("nth") - 1).cast("long")).drop("part", "base")
