"""MinHash near-dedup by fast similarity sketches, banding and exact verification.

A sketch of ``t`` coordinates is filled in rounds (Dahlgaard, Knudsen and Thorup, 2017). In round ``i`` each element of a set gets a
fresh hash, which names a coordinate and a value; a coordinate keeps the least of the first round that reached it. From round ``t`` on
round ``i`` places all elements into coordinate ``i - t``, so after ``2 t`` rounds every coordinate is filled, also that of a
one-element set. Rounds end once all are, so a set of ``n`` elements costs about ``n + t log t`` hashes, not ``n t``. Two sets agree
in a coordinate with a chance of their Jaccard likeness, and the share of agreeing coordinates is concentrated as that of
independent draws.

``BANDS`` bands of ``ROWS`` coordinates name the lists in which candidates meet: sets alike by 0.8 miss each other in all of
them with a chance of (1 - 0.8**5)**36 = 6e-7. Candidates are verified on their whole sets, and lists of any length
lose no link; see ``near_copies``, which holds that part.

Texts with the same lower-cased words are one class, found by a 128-bit digest, so copies cost nothing further.

Rows. Null text, or one without words, has an empty set, is linked with nothing and is its own component. A null ``doc_id`` takes
part; it names no component, and such a row is kept by none. Repeated ids are rows of their own that share what they are given. A text
is read whole, however long, its set hashed element by element. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._runtime import in_slices, through_parquet, use_shared_checkpoints
from .near_copies import linked, shingles

SHINGLE = 2
BANDS, ROWS = 36, 5
#: Elements whose sketches are made at once; a larger set is taken alone.
TOGETHER = 1 << 17
_MASK = (1 << 64) - 1
_EMPTY = np.uint64(_MASK)
_NO_WORDS = np.zeros(1, np.uint64)


def _mixed(x: np.ndarray, i: int) -> np.ndarray:
    """A hash of each element for round ``i``: the finalizer of splitmix64 over the element and a constant of the round."""
    z = x + np.uint64(((2 * i + 1) * 0x9E3779B97F4A7C15) & _MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketches(sets: list[np.ndarray], t: int = BANDS * ROWS) -> np.ndarray:
    """The sketches of non-empty sets of 64-bit elements: one row of ``t`` coordinates, (round, value) as one number, for each."""
    found = np.full((len(sets), t), _EMPTY, np.uint64)
    flat = found.reshape(-1)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        mixed = _mixed(element, i)
        place = owner * t + (((mixed >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else owner * t + (i - t)
        # a later round has a larger number, so it never replaces what an earlier one has placed
        np.minimum.at(flat, place, (np.uint64(i) << np.uint64(32)) | (mixed & np.uint64(0xFFFFFFFF)))
        open_ = (found == _EMPTY).any(axis=1)
        if not open_.any():
            break
        if not open_[owner].all():
            left = open_[owner]
            element, owner = element[left], owner[left]
    return found


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), -1, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        keys = _mixed(keys ^ parts[:, :, i], i)
    return keys.view(np.int64)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with digest: of the words in lower case, null without words."""
    for batch in in_slices(batches, "text"):
        words = (b" ".join(_words(t.as_py())) for t in batch.column(1))
        digests = [xxhash.xxh3_128_digest(w) if w else None for w in words]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])


def _banded(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    """(entry, text) to (entry, n, bands), n the size of the set."""
    for batch in in_slices(batches, "text"):
        ids, sets, size = [], [], 0
        for entry, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(entry)
            sets.append(shingles(_words(text.as_py()), shingle))
            size += len(sets[-1])
            if size >= TOGETHER:
                yield _keyed(ids, sets, bands)
                ids, sets, size = [], [], 0
        if ids:
            yield _keyed(ids, sets, bands)


def banded_by(shingle: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What turns (entry, text) into (entry, bands) by sketches of the sets of ``shingle`` words, in ``bands`` bands of ``ROWS`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _banded(batches, shingle, bands):
            yield batch.select(["entry", "bands"])

    return run


def _keyed(ids: list[int], sets: list[np.ndarray], bands: int = BANDS) -> pa.RecordBatch:
    # an empty set, which has no sketch, is one of a word that no text has
    keys = band_keys(sketches([s if len(s) else _NO_WORDS for s in sets], bands * ROWS))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), flat], ["entry", "n", "bands"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, text) to (entry, found)."""
    for batch in in_slices(batches, "text"):
        found = [shingles(_words(t.as_py()), SHINGLE).view(np.int64) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["entry", "found"])


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df``, which is dealt by ``key``, written and read back with that layout known, so that joins on the key move the other side only."""
    spark = df.sparkSession
    use_shared_checkpoints(spark)
    name = f"minhash_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what has been read from the catalog
    return held


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs``; see the module's notes."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = read.mapInArrow(_digested, "doc_id long, text binary, digest binary")
    # all texts of a class have the same words, so any of them will do
    first = marked.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    classes = _bucketed(first.withColumn("entry", F.monotonically_increasing_id()), "digest")
    banded = through_parquet(classes.select("entry", "text").mapInArrow(_banded, "entry long, n long, bands array<long>"), "minhash_bands")
    named = classes.select("entry", "digest", "least")

    def chosen(asked: DataFrame) -> DataFrame:
        # texts stay where they lie; what is asked goes to them
        at = named.join(asked, "entry", "left_semi").select("digest")
        return classes.join(at, "digest", "left_semi").select("entry", "text")

    components = connected_components(linked(banded.select("entry", "bands"), chosen, _shingled))
    named = named.join(components.withColumnRenamed("node", "entry"), "entry", "left").select("entry", "digest", "least", F.coalesce("component", "entry").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    sized = named.join(least, "component").join(banded.select("entry", "n"), "entry").select("digest", "component_id", "n")
    found = marked.select("doc_id", "digest").join(sized, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
