"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints with at most ``max_bits`` differing bits differ in at most
that many bytes, so they share at least ``8 - max_bits`` bytes at equal positions: the guaranteed
minimum. Postings of single byte positions would be as long as the corpus / 256; the index therefore
posts each distinct fingerprint under every combination of ``COMBINED`` positions (no more than the
guaranteed minimum), so that no pair is missed.

Inside such a list the other positions are an inverted index of their own: members are posted under
(position, byte), the shared bytes of each pair are counted over those postings, and only pairs that reach the
minimum are verified. Pairs that never meet in a posting cost nothing.

A list returns a spanning star of each component it holds instead of all pairs; components over the whole corpus follow
from those stars. Copies of one fingerprint are one entry, so a large group of equal documents costs nothing here. A list
of more than ``LONG`` entries passes on unread; it is dealt in tiles of about that many, each pair of tiles a list of its
own, so no task holds more than two tiles and no link is lost.

Rows. Null text has no words and gets fingerprint zero, as any text without words. A null ``doc_id``
takes part; a component without any id is null. Repeated rows are returned as often as they occur.
A very long text is hashed in parts; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._runtime import cut, free_worker, in_slices

SHINGLE = 4
MAX_BITS = 4
#: Byte positions that make a posting key. Three give 35 or 56 keys of 24 bits, right up to some 10**9 fingerprints.
COMBINED = 3
SEED = 42
#: Shingles hashed at once.
CHUNK = 1 << 15
#: Members of a posting list that one task holds at once, and of a tile of a longer one.
LONG = 1024


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned; zero if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.record_batch([*batch.columns[:-1], pa.array(found.view(np.int64), pa.int64())], [*batch.schema.names[:-1], "fp"])

    return run


def _tally(lists: np.ndarray, fps: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of places that meet under some (list, position, byte), and under how many; a < b.

    ``positions[i]`` holds the byte positions that are still to be counted in the list of place i.
    """
    places = np.repeat(np.arange(len(fps)), positions.shape[1])
    position = positions.ravel().astype(np.int64)
    byte = fps.view(np.uint8).reshape(-1, 8)[places, position].astype(np.int64)
    key = (lists[places] << 11) + (position << 8) + byte
    order = np.lexsort((places, key))
    key, places = key[order], places[order]
    last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)
    end = np.repeat(last, np.diff(np.concatenate([[-1], last])))
    met, step, live = [], 1, np.arange(len(key))
    while len(live := live[live + step <= end[live]]):
        met.append(places[live] * len(fps) + places[live + step])
        step += 1
    pair, count = np.unique(np.concatenate(met) if met else np.zeros(0, np.int64), return_counts=True)
    return pair // max(len(fps), 1), pair % max(len(fps), 1), count


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place linked to each of ``n`` places by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def _links(rows: np.ndarray, rest: np.ndarray, combined: int, minimum: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the lists in ``rows`` (combo, masked, tile, fp), which are sorted."""
    new = np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
    fps = rows[3].copy().view(np.uint64)
    a, b, count = _tally(np.cumsum(new) - 1, fps, rest[rows[0]])
    reach = count + combined >= minimum
    a, b = a[reach], b[reach]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
    root = _stars(len(fps), a[near], b[near])
    member = np.flatnonzero(root != np.arange(len(root)))
    return rows[3, member], rows[3, root[member]]


_EDGES = "a long, b long, combo short, masked long"


def _postings(rest: np.ndarray, combined: int, minimum: int, max_bits: int, longest: int | None):
    """Reads rows (combo, masked, tile, fp) sorted by all four; emits edges, and members of lists over ``longest`` with their list."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        a, b = _links(rows, rest, combined, minimum, max_bits)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int16()), pa.nulls(len(a), pa.int64())], ["a", "b", "combo", "masked"])

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(rows[3], pa.int64()), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0], pa.int16()), pa.array(rows[1], pa.int64())], ["a", "b", "combo", "masked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        held, passing = np.zeros((4, 0), np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            if passing is not None:
                other = np.flatnonzero((rows[:3] != passing).any(axis=0))
                of_it = int(other[0]) if len(other) else rows.shape[1]
                if of_it:
                    yield passed(rows[:, :of_it])
                rows = rows[:, of_it:]
            if not rows.shape[1]:
                continue
            passing, held = None, np.concatenate([held, rows], axis=1)
            begin = np.concatenate([[0], np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1, [held.shape[1]]])
            size = np.diff(begin)
            if longest:
                for i in np.flatnonzero(size > longest).tolist():
                    yield passed(held[:, begin[i] : begin[i + 1]])
                if size[-1] > longest:
                    passing = held[:3, -1:].copy()
            # the last list may go on in the next batch
            stays = np.repeat((size <= longest) if longest else np.ones(len(size), bool), size)
            stays[begin[-2] :] = False
            if stays.any():
                # about so many rows at once that their pairs stay few
                whole = held[:, stays]
                starts = np.concatenate([[0], np.flatnonzero((whole[:3, 1:] != whole[:3, :-1]).any(axis=0)) + 1, [whole.shape[1]]])
                lo = 0
                for hi in (*starts[np.searchsorted(starts, np.arange(4 * LONG, whole.shape[1], 4 * LONG))].tolist(), whole.shape[1]):
                    if hi > lo:
                        yield edges(whole[:, lo:hi])
                        lo = hi
            held = held[:, begin[-2] :].copy() if passing is None else np.zeros((4, 0), np.int64)
        if held.shape[1]:
            yield edges(held)

    return run


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect every component of the distinct fingerprints ``fps(fp)``."""
    if not 0 <= max_bits < 8:
        raise ValueError("max_bits must leave a byte that two linked fingerprints share: 0 to 7")
    minimum = 8 - max_bits
    # Pairs that share m of 8 bytes share some n of the first 8 - (m - n); fewer positions, fewer postings.
    combined = min(COMBINED, minimum)
    combos = list(combinations(range(8 - (minimum - combined)), combined))
    rest = np.array([[p for p in range(8) if p not in c] for c in combos]).reshape(len(combos), -1)
    run = lambda longest: _postings(rest, combined, minimum, max_bits, longest)
    posted = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("combo"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("masked")) for i, c in enumerate(combos)))).alias("p"))
    lists = posted.select("p.combo", "p.masked", F.lit(0).cast("long").alias("tile"), "fp").repartition("combo", "masked").sortWithinPartitions("combo", "masked", "tile", "fp")
    found = cut(lists.mapInArrow(run(LONG), _EDGES))
    long_ = found.where("combo is not null").select(F.col("a").alias("fp"), "combo", "masked")
    if long_.isEmpty():
        return found.select("a", "b")
    tiles = long_.groupBy("combo", "masked").agg(F.ceil(F.count("*") / LONG).alias("tiles"))
    dealt = long_.join(tiles, ["combo", "masked"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("combo", "masked", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("tile"), "fp")
    dealt = dealt.repartition("combo", "masked", "tile").sortWithinPartitions("combo", "masked", "tile", "fp")
    return found.where("combo is null").select("a", "b").unionByName(dealt.mapInArrow(run(None), _EDGES).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for every row of ``docs``; see the module's notes."""
    marked = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = connected_components(link_fingerprints(classes.select("fp"), max_bits))
    named = classes.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
