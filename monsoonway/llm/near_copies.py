"""Near copies by the exact likeness of word shingles, for corpora of which one row of each group is to stay.

Two texts are near copies if the Jaccard likeness of their sets of ``SHINGLE`` words is ``LEAST`` or more. A SimHash
of 64 bits cannot find them: texts alike by 0.8 differ in 8.5 bits on average, more than the index of
``simhash_index`` can be asked for. Candidates are texts that agree in a band of ``ROWS`` least hashes, one of
``BANDS``, as many as ``op12`` has; at a likeness of 0.8 all bands miss a pair with a chance of (1 - 0.8**5)**36 = 6e-7, at 0.9 of 5e-15. Every
candidate pair is then verified on the shingles themselves, and the groups are the components of the verified pairs.

Texts of the same words, by case and space, are one entry. In a band's list of at most ``ALL_PAIRS`` entries all
pairs are candidates; in a longer one first each entry and the next in an order that differs by band, which ties most of
a large group at no quadratic cost. Entries of a longer list that these links leave apart are then compared with all of
the list, in pairs of tiles, so no link is lost; only links leave a task, never pairs that were merely compared.

Rows. Null text has no words, as empty text; texts without words are copies of each other. One row of a group
stays: the smallest ``doc_id``, rows without an id after all others, then by hash and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._graph import connected_components
from ._runtime import through_parquet
from .simhash_index import _stars

SHINGLE = 5
#: The least likeness, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 36, 5
ALL_PAIRS = 16
#: Entries of a tile of a longer list, and shingles that are compared at once.
TILE, COLUMNS = 512, 1 << 12
SEED = 42
#: Shingles whose least hashes are taken at once.
CHUNK = 1 << 12
Shingled = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Chosen = Callable[[DataFrame], DataFrame]
_DRAW = np.random.default_rng(SEED)
_FLIP = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all runs of ``shingle`` words; of the whole text if it has fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(len(words) - shingle + 1, 1)
    starts, ends = starts[:n], ends[-n:]
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band; equal for equal sets."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[i : i + CHUNK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _entry(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(b" ".join(_words(text)), SEED)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes the number of its entry."""
    for batch in batches:
        found = np.fromiter((_entry(t.as_py()) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
        yield pa.record_batch([*batch.columns[:-1], pa.array(found.view(np.int64), pa.int64())], [*batch.schema.names[:-1], "entry"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, text) to (entry, bands)."""
    for batch in batches:
        keys = [band_keys(shingles(_words(t.as_py()))) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["entry", "bands"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, text) to (entry, found)."""
    for batch in batches:
        found = [shingles(_words(t.as_py())).view(np.int64) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["entry", "found"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (band, key, place, entry) sorted by the first three and emits the candidate pairs of each list."""

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        number = np.cumsum(new) - 1
        size = np.bincount(number)[number]
        a, b = [], []
        for step in range(1, min(ALL_PAIRS, rows.shape[1])):
            at = np.flatnonzero((number[step:] == number[:-step]) & ((size[step:] <= ALL_PAIRS) | (step == 1)))
            x, y = rows[3, at], rows[3, at + step]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
        none = np.zeros(0, np.int64)
        return pa.record_batch([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
        # the last list may go on in the next batch
        last = (rows[:2] == rows[:2, -1:]).all(axis=0)
        begins = int(np.argmax(last))
        if held and (begins or (held[-1][:2, -1] != rows[:2, -1]).any()):
            yield pairs(np.concatenate([*held, rows[:, :begins]], axis=1))
            held = []
        elif begins:
            yield pairs(rows[:, :begins])
        held.append(rows[:, begins:].copy())
    if held:
        yield pairs(np.concatenate(held, axis=1))


def _verified(chosen: Chosen, pairs: DataFrame, shingled: Shingled) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are alike by ``LEAST`` or more, compared on the shingles themselves."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("entry")).distinct()
    sets = through_parquet(chosen(asked).mapInArrow(shingled, "entry long, found array<long>"), "near_sets")
    one = lambda end: sets.select(F.col("entry").alias(end), F.col("found").alias(f"found_{end}"))
    top, bottom = LEAST
    n_a, n_b, both = F.size("found_a"), F.size("found_b"), F.size(F.array_intersect("found_a", "found_b"))
    sizes = sets.select("entry", F.size("found").alias("n"))
    near = pairs.join(sizes.select(F.col("entry").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("entry").alias("b"), F.col("n").alias("n_b")), "b")
    near = near.where(F.least("n_a", "n_b") * bottom >= F.greatest("n_a", "n_b") * top).select("a", "b")
    return near.join(one("a"), "a").join(one("b"), "b").where(both * (top + bottom) >= (n_a + n_b) * top).select("a", "b")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (band, key, tile, entry, part, found) sorted by the first three and emits links between near copies of different parts."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        entry, part = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        sizes = np.array([len(r[5]) for r in rows], np.int64)
        _, column, often = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
        place, both = np.repeat(np.arange(len(rows)), sizes), np.zeros((len(rows), len(rows)))
        shared = often[column] > 1
        place, column = place[shared], (np.cumsum(often > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        place, column = place[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            has = np.zeros((len(rows), COLUMNS), np.float32)
            has[place[lo:hi], column[lo:hi] - at] = 1
            both += has @ has.T
        top, bottom = LEAST
        alike = (both * (top + bottom) >= (sizes[:, None] + sizes) * top) & (part[:, None] != part)
        a, b = np.nonzero(np.triu(alike, 1))
        root = _stars(len(rows), a, b)
        member = np.flatnonzero(root != np.arange(len(root)))
        x, y = entry[member], entry[root[member]]
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        found = batch.column(5)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
            if held and held[0][:3] != row[:3]:
                yield links(held)
                held = []
            held.append((*row, found[i].values.to_numpy(zero_copy_only=False)))
    if held:
        yield links(held)


def _apart(chosen: Chosen, posted: DataFrame, near: DataFrame, shingled: Shingled) -> DataFrame:
    """Links (a, b) between entries of a list of over ``ALL_PAIRS`` entries that are near copies and that ``near`` leaves in different components.

    A list whose entries are all tied already is not read again. Any other is dealt in tiles of about ``TILE`` entries,
    each pair of tiles compared in one task, which returns a spanning star of the copies it finds and no pairs.
    """
    long_ = posted.groupBy("band", "key").count().where(F.col("count") > ALL_PAIRS).select("band", "key")
    tied = connected_components(near).select(F.col("node").alias("entry"), "component")
    members = through_parquet(posted.join(long_, ["band", "key"]).join(tied, "entry", "left").select("band", "key", "entry", F.coalesce("component", "entry").alias("part")), "near_lists")
    several = members.groupBy("band", "key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count("*") / TILE).alias("tiles")).where("low < high").drop("low", "high")
    open_ = members.join(several, ["band", "key"])
    sets = through_parquet(chosen(open_.select("entry")).mapInArrow(shingled, "entry long, found array<long>"), "near_open")
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("entry"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("band", "key", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("tile"), "entry", "part")
    dealt = dealt.join(sets, "entry").select("band", "key", "tile", "entry", "part", "found").repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def verified_pairs(texts: DataFrame, banded: Shingled = _banded) -> DataFrame:
    """Rows (a, b) of distinct entries ``texts(entry, text)`` that are near copies; they tie all that share a list and are alike.

    ``banded`` turns (entry, text) into (entry, bands), the keys of the lists in which candidates meet.
    """
    banded = through_parquet(texts.mapInArrow(banded, "entry long, bands array<long>"), "near_bands")
    return linked(banded, lambda asked: texts.join(asked, "entry", "left_semi").select("entry", "text"), _shingled)


def linked(banded: DataFrame, chosen: Chosen, shingled: Shingled) -> DataFrame:
    """The pairs of ``verified_pairs`` for entries whose lists ``banded(entry, bands)`` names.

    ``chosen`` gives the rows (entry, text) of asked entries, which may be asked more than once; ``shingled`` turns them into the sets that are compared.
    """
    posted = banded.select("entry", F.posexplode("bands").alias("band", "key"))
    lists = posted.select("band", "key", F.xxhash64("band", "entry").alias("place"), "entry").repartition("band", "key").sortWithinPartitions("band", "key", "place")
    pairs = through_parquet(lists.mapInArrow(_pairs, "a long, b long").distinct(), "near_pairs")
    near = through_parquet(_verified(chosen, pairs, shingled), "near_links")
    return near.unionByName(_apart(chosen, posted, near, shingled))


def one_of_each(docs: DataFrame, banded: Shingled = _banded) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see the module's notes. ``banded`` is that of ``verified_pairs``."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    read = docs.select(whole.alias("whole"), F.col("text").cast("binary").alias("text"))
    marked = read.mapInArrow(_entries, StructType([read.schema["whole"], StructField("entry", LongType())]))
    order = F.struct(F.col("whole.doc_id").isNull(), F.col("whole.doc_id"), F.xxhash64("whole.text"), F.col("whole.text"), F.xxhash64("whole"))
    first = through_parquet(marked.groupBy("entry").agg(F.min_by("whole", order).alias("whole")), "near_first")
    components = connected_components(verified_pairs(first.select("entry", F.col("whole.text").cast("binary").alias("text")), banded))
    rank = F.struct(F.col("whole.doc_id").isNull(), F.col("whole.doc_id"), F.col("entry"))
    stays = components.join(first.select(F.col("entry").alias("node"), rank.alias("rank")), "node").groupBy("component").agg(F.min("rank").alias("rank"))
    goes = components.join(stays.select(F.col("rank.entry").alias("node")), "node", "left_anti").select(F.col("node").alias("entry"))
    return first.join(goes, "entry", "left_anti").select("whole.*")
