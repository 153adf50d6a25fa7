"""Exact substring dedup over word windows, partitioned by super-k-mers.

A window is ``window`` consecutive words. Every window has a minimiser, the smallest hash among its
``MINIMISER``-word grams; consecutive windows that share it travel together as one packed run of words
(a super-k-mer) to the bucket of that minimiser. Equal windows have equal minimisers, so each bucket
sees all occurrences of its windows. In a bucket the windows are sorted by a 64-bit hash and their
real bytes are compared inside equal hashes, so the outcome is exact.

Skew. A run whose words were seen before by the same map task does not travel again: all its windows
have an earlier occurrence and are marked at once; the marks of one block need no bucket and pass through a
group of their own. Minimisers that still carry more than ``HOT_SHARE`` of all runs are split by a second
content key, the largest gram hash of the window, which equal windows share as well.

Rows. Null text has no words. Documents are known by ``doc_id`` and 64 bits of a hash of their text; a null
``doc_id`` counts as smaller than any other. Rows that share an id are one document in the order of windows, so repeated
rows are not "earlier" than each other, and all get the same result. A very long text is read in pieces of ``PIECE`` words that overlap by a window. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import cut, free_worker, in_slices

WINDOW = 20
MINIMISER = 4
#: A minimiser with more than this share of all runs is split by a second key; at most 1 / HOT_SHARE are.
HOT_SHARE = 1 / 2000
#: A map task compresses what it holds for each bucket whenever it holds about so many bytes.
BLOCK_BYTES = 24 << 20
#: Words that a bucket should hold, so that sorting one takes tens of MB.
BUCKET_WORDS = 1_500_000
#: Bytes of runs that a map task remembers to drop those seen before.
SEEN_BYTES = 24 << 20
#: Words of a text that are hashed at once, bytes of a bucket that are, and bytes of texts in one slice.
PIECE, HASHED_BYTES, SLICE = 1 << 16, 1 << 20, 1 << 21
NULL_ID = -(1 << 63)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * (self.up[-1:] * _BASE)])
            self.down = np.concatenate([self.down, self.down * (self.down[-1:] * _INVERSE)])
            assert len(self.up) == 2 * k
        return self.up, self.down


def _spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space, with each word's start and end in the joined bytes."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return b" ".join(words), starts, ends


def _span_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of each span, equal for equal bytes, by prefix sums of a polynomial."""
    up, down = powers.reach(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each ``width`` consecutive values, in log2(width) steps."""
    out, reach = values, 1
    while reach * 2 <= width:
        out, reach = pick(out[:-reach], out[reach:]), reach * 2
    if rest := width - reach:
        out = pick(out[:-rest], out[rest:])
    return out


def _keys(starts: np.ndarray, ends: np.ndarray, joined: bytes, window: int, minimiser: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of each window, and the hashes of all grams."""
    grams = _span_hashes(joined, starts[: len(starts) - minimiser + 1], ends[minimiser - 1 :], powers)
    return _slide(grams, window - minimiser + 1, np.minimum), grams


def _cut_words(text: bytes, window: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(first word, joined words, starts, ends) of pieces of a text that together have each window once."""
    words = text.split()
    for at in range(0, max(len(words) - window + 1, 0), PIECE):
        yield at, *_spans(words[at : at + PIECE + window - 1])


def _runs(text: bytes, window: int, minimiser: int, hot: np.ndarray, powers: _Powers):
    """Yield (key, first window, windows, packed words) for each super-k-mer of a text."""
    for base, joined, starts, ends in _cut_words(text, window):
        keys, grams = _keys(starts, ends, joined, window, minimiser, powers)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            split = hot[at] == keys
            if split.any():
                keys = np.where(split, _mix(keys ^ _slide(grams, window - minimiser + 1, np.maximum)), keys)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = np.concatenate([[0], edges])
        count = np.diff(np.concatenate([first, [len(keys)]]))
        for k, f, c, s, e in zip(keys[first].tolist(), (first + base).tolist(), count.tolist(), starts[first].tolist(), ends[first + count + window - 2].tolist()):
            yield k, f, c, joined[s:e]


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in in_slices(batches, 2, SLICE):
        ids, hashes, texts = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            yield (NULL_ID if (d := ids[i].as_py()) is None else d), hashes[i].as_py(), text or b""


_PACKED = "bucket int, words long, block binary"
_SPAN = "doc_id long, text_hash long, first long, windows long"
_KEPT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("windows", pa.int64())])


def _pack(window: int, minimiser: int, buckets: int, hot: np.ndarray):
    """Map side: super-k-mers to compressed blocks by bucket; bucket -1 carries the marks of runs seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        powers, squeeze = _Powers(), zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        marks: list[list] = []
        size, seen_size = 0, 0
        seen: dict[bytes, tuple] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if marks:
                held[-1] = [(*m, 0, b"") for m in marks]
                marks.clear()
            kept = list(held)
            for i in range(0, len(kept), 256):
                out = [(b, sum(r[4] for r in rows), squeeze.compress(_write(rows))) for b in kept[i : i + 256] if (rows := held.pop(b))]
                b, w, x = zip(*out)
                yield pa.record_batch([pa.array(b, pa.int32()), pa.array(w, pa.int64()), pa.array(x, pa.binary())], ["bucket", "words", "block"])

        for doc, text_hash, text in _texts(batches):
            for key, first, windows, words in _runs(text, window, minimiser, hot, powers):
                at = (doc, text_hash, first)
                before = seen.get(words)
                if before is None:
                    if seen_size >= SEEN_BYTES:
                        seen.clear()
                        seen_size = 0
                    seen[words] = at
                    seen_size += len(words) + 200
                elif (before[0], before[2]) < (doc, first):
                    # all windows of this run start earlier in a run that this task has sent
                    if marks and marks[-1][:2] == [doc, text_hash] and marks[-1][2] + marks[-1][3] == first:
                        marks[-1][3] += windows
                    else:
                        marks.append([doc, text_hash, first, windows])
                        size += 200
                    continue
                held.setdefault(key % buckets, []).append((doc, text_hash, first, windows, windows + window - 1, words))
                size += len(words) + 200
                if size > BLOCK_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _write(rows: list) -> bytes:
    doc, text_hash, first, windows, _, words = zip(*rows)
    numbers = [np.array(x, kind).tobytes() for x, kind in ((doc, "<i8"), (text_hash, "<i8"), (first, "<i4"), (windows, "<i4"), ([len(w) for w in words], "<i4"))]
    return b"".join([np.int64(len(rows)).tobytes(), *numbers, *words])


def _read(block: bytes):
    n, at = int(np.frombuffer(block, np.int64, 1)[0]), 8
    out = []
    for kind in ("<i8", "<i8", "<i4", "<i4", "<i4"):
        out.append(np.frombuffer(block, kind, n, at).astype(np.int64))
        at += n * np.dtype(kind).itemsize
    return np.stack(out[:4]), out[4], block[at:]


def _merge(doc, text_hash, first, repeated) -> pa.Table:
    """Consecutive repeated windows of a document as one row each."""
    doc, text_hash, first = doc[repeated], text_hash[repeated], first[repeated]
    order = np.lexsort((first, text_hash, doc))
    doc, text_hash, first = doc[order], text_hash[order], first[order]
    if not len(doc):
        return _KEPT.empty_table()
    new = np.flatnonzero((doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (first[1:] > first[:-1] + 1)) + 1
    head = np.concatenate([[0], new])
    tail = np.concatenate([new, [len(doc)]]) - 1
    return pa.table([doc[head], text_hash[head], first[head], first[tail] - first[head] + 1], schema=_KEPT)


def _count(window: int):
    """Bucket side: sort all windows of the bucket and return those that start earlier elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        free_worker()
        numbers, lengths, words = [], [], []
        unsqueeze = zstandard.ZstdDecompressor()
        for block in table.column("block"):
            a, b, c = _read(unsqueeze.decompress(block.as_py()))
            numbers.append(a)
            lengths.append(b)
            words.append(c)
        doc, text_hash, first, windows = np.concatenate(numbers, axis=1)
        if table.column("bucket")[0].as_py() < 0:
            return pa.table([doc, text_hash, first, windows], schema=_KEPT)
        packed, lengths = b"".join(words), np.concatenate(lengths)
        run_end = np.cumsum(lengths)
        raw = np.frombuffer(packed, np.uint8)
        space = np.flatnonzero(raw == 32)
        bounds = np.sort(np.concatenate([space, run_end]))  # ends of words; a run's end is no space
        word_end = bounds
        last = np.searchsorted(word_end, run_end)
        word_start = np.empty_like(word_end)
        word_start[0] = 0
        word_start[1:] = word_end[:-1] + 1
        word_start[last[:-1] + 1] = run_end[:-1]
        first_word = np.concatenate([[0], last[:-1] + 1])
        reps = np.repeat(np.arange(len(doc)), windows)
        offset = np.arange(len(reps)) - np.repeat(np.cumsum(windows) - windows, windows)
        w = first_word[reps] + offset
        s, e = word_start[w], word_end[w + window - 1]
        hashes = np.empty(len(s), np.uint64)
        powers = _Powers()
        # spans are hashed in pieces of whole runs so that the prefix sums stay small
        edge = np.searchsorted(run_end, np.arange(0, len(packed), HASHED_BYTES))
        cuts = np.unique(np.concatenate([edge, [len(doc)]]))
        row_of = np.concatenate([[0], np.cumsum(windows)])
        begin = 0
        for stop in cuts.tolist():
            if stop <= begin:
                continue
            lo = 0 if begin == 0 else int(run_end[begin - 1])
            hi, x, y = int(run_end[stop - 1]), int(row_of[begin]), int(row_of[stop])
            hashes[x:y] = _span_hashes(packed[lo:hi], s[x:y] - lo, e[x:y] - lo, powers)
            begin = stop
        d, t, f = doc[reps], text_hash[reps], first[reps] + offset
        order = np.lexsort((f, d, hashes))
        h = hashes[order]
        same = h[1:] == h[:-1]
        repeated = np.zeros(len(h), bool)
        if same.any():
            edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
            size = np.diff(edges)
            for a, n in zip(edges[:-1][size > 1].tolist(), size[size > 1].tolist()):
                rows = order[a : a + n]
                earliest: dict[bytes, tuple] = {}
                for r in rows.tolist():
                    at = (d[r], f[r])
                    if earliest.setdefault(packed[s[r] : e[r]], at) != at:
                        repeated[r] = True
        return _merge(d, t, f, repeated)

    return run


def _hot(window: int, minimiser: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            keys, words = [], 0
            for text in batch.column(0):
                for _, joined, starts, ends in _cut_words(text.as_py() or b"", window):
                    words += len(starts)
                    k, _ = _keys(starts, ends, joined, window, minimiser, powers)
                    keys.append(k[np.concatenate([[True], k[1:] != k[:-1]])])
            key, count = np.unique(np.concatenate([none, *keys]), return_counts=True)
            many = count > max(1, count.sum() * HOT_SHARE / 4)  # lighter ones in every batch cannot pass HOT_SHARE
            yield pa.record_batch(
                [pa.array(np.concatenate([[0], key[many].view(np.int64)]), pa.int64()), pa.array(np.concatenate([[count.sum()], count[many]]), pa.int64()),
                 pa.array([words, *[-1] * int(many.sum())], pa.int64())], ["key", "n", "words"])

    return run


def _text_hash() -> F.Column:
    return F.xxhash64("text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Rows (doc_id, text_hash, first, windows): runs of windows that start earlier elsewhere."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("binary").alias("text"))
    counts = cut(source.select("text").mapInArrow(_hot(window, minimiser), "key long, n long, words long"))
    total = counts.where("words >= 0").agg(F.sum("n"), F.sum("words")).first()
    runs, words = int(total[0] or 0), int(total[1] or 0)
    heavy = counts.where("words < 0").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > max(64, runs * HOT_SHARE))
    hot = np.sort(np.array([r[0] for r in heavy.select("key").collect()], np.int64).view(np.uint64))
    buckets = max(16, -(-4 * words // BUCKET_WORDS))
    blocks = source.mapInArrow(_pack(window, minimiser, buckets, hot), _PACKED)
    # marks of each block are a group by themselves, so no group grows with the corpus
    salted = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.lit(0))
    return blocks.groupBy("bucket", salted.alias("part")).applyInArrow(lambda t: _count(window)(t.drop_columns(["words"])), _SPAN)


def _rewrite(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_py()
                words = (raw or b"").split()
                spans = spans.as_py()
                if not spans:
                    kept, removed = words, 0
                else:
                    cover = np.zeros(len(words) + 1, np.int64)
                    first = np.array([s["first"] for s in spans])
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + np.array([s["windows"] for s in spans]) + window - 1, -1)
                    stays = np.cumsum(cover)[:-1] == 0
                    kept = [w for w, k in zip(words, stays.tolist()) if k]
                    removed = len(words) - len(kept)
                joined = b" ".join(kept)
                new = raw if not removed else joined
                out.append((len(words), removed, hashlib.sha256(joined).hexdigest(), None if new is None else new.decode()))
            n, r, d, t = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch(
                [*(batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("text", "spans")),
                 pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(d, pa.string()), pa.array(t, pa.string())],
                [*(x for x in batch.schema.names if x not in ("text", "spans")), "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text), one for each row of ``docs``.

    ``kept_text`` is the text itself when nothing goes, else the words that stay joined by a space.
    ``carry`` names further columns of ``docs`` to return, as ``carry_<name>``.
    """
    spans = repeated_spans(docs, window, minimiser)
    by_doc = spans.groupBy(F.col("doc_id").alias("span_doc"), F.col("text_hash").alias("span_hash")).agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    left = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").alias(f"carry_{c}") for c in carry),
        F.col("text").cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("join_doc"), _text_hash().alias("join_hash"))
    joined = left.join(by_doc, (F.col("join_doc") == F.col("span_doc")) & (F.col("join_hash") == F.col("span_hash")), "left").drop("join_doc", "join_hash", "span_doc", "span_hash")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "spans"))
    return joined.mapInArrow(_rewrite(window), f"{kinds}, n_words long, n_removed long, kept_sha256 string, kept_text string")
