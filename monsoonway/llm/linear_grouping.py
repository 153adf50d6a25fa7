"""Packing token sequences: linear grouping, few-size configurations, substitution, best fit.

Documents longer than ``capacity`` are cut; what is left to pack is described by a histogram of at
most ``capacity`` lengths, whatever the size of the corpus, so the scheme is planned on the driver:

1. Linear grouping: pieces longer than ``SMALL`` are put, by falling length, into at most ``GROUPS``
   groups of equal cardinality and rounded up to the longest of their group.
2. Few sizes: column generation finds configurations of rounded sizes and how often to use each.
3. Substitution: actual pieces take the places of the rounded ones, which frees some room.
4. Best fit: what is left, by falling length, goes where the least room remains.

The plan says, for ranges of ranks within a length, which sequences and offsets they take; it has at
most some thousand ranges. Pieces get their rank within their length by partial counts, so no length is
gathered in one task, and look their range up.

Rows. Null text is empty; an empty document is the end token alone. Repeated rows are packed as often
as they occur. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import cut, in_slices, worker_slot

CAPACITY = 1024
END_ID = 2
SMALL = 128
GROUPS = 96
#: Pieces of one length that share a ranking task, and the least number of such tasks for each length.
RANKED, LEAST_PARTS = 100_000, 16
#: Pieces whose ids a worker remembers, and the bytes that one slice of texts has.
REMEMBERED, SLICE = 500_000, 1 << 21

# White space as the tokenizer's pattern means it, and its letters and numbers below U+0250.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN_LETTERS, _LATIN_NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(letter: str, number: str) -> str:
    """Pieces of a byte-level BPE: endings, letters, numbers and marks with a space before them, and white space."""
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


_LATIN, _ANY = re.compile(_pattern(_LATIN_LETTERS, _LATIN_NUMBERS)), regex.compile(_pattern(r"\p{L}", r"\p{N}"))
_BEYOND_LATIN = re.compile("[^\0-\u024f]")


class Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    A byte-level BPE cuts a text into pieces and encodes each by itself, so the ids of pieces are remembered.
    Texts that hold an added token, or a character that old versions of Unicode do not know, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, bytes] = {}
        self.old: set[str] = set()

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str] | None:
        if self.added and self.added.search(text):
            return None
        if text.isascii() or not _BEYOND_LATIN.search(text):
            return _LATIN.findall(text)
        for c in set(text) - self.old:
            if unicodedata.ucd_3_2_0.category(c) == "Cn":
                return None
            self.old.add(c)
        return _ANY.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut_up = [self._cut(t) for t in texts]
        if new := list(set().union(*(x for x in cut_up if x)) - self.known.keys()):
            self.known.update(zip(new, self._encode(new)))
        of = self.known.__getitem__
        return [self._encode([t])[0] if x is None else b"".join(map(of, x)) for t, x in zip(texts, cut_up)]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # later tasks of this worker find the pieces that earlier ones met
        ids, end = worker_slot(f"ids {path}", lambda: Ids(path)), np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches, 1, SLICE):
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), ids.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                start = 0
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    out.append((doc, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start = stop
            doc, piece, start, length, crc = zip(*out) if out else ((),) * 5
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``capacity`` of the greatest worth (an unbounded knapsack)."""
    size = np.array(sizes)
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    low = int(size.min())
    for room in range(low, capacity + 1):
        fits = np.flatnonzero(size <= room)
        value = best[room - size[fits]] + worth[fits]
        k = int(value.argmax())
        best[room], took[room] = (value[k], fits[k]) if value[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
    out, room = np.zeros(len(sizes), np.int64), capacity
    while room >= low:
        if took[room] < 0:
            room -= 1
        else:
            out[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), out


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down, from column generation (Gilmore and Gomory)."""
    if not sizes:
        return []
    g = len(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    demand = np.array(need, float)
    for _ in range(rounds):
        worth = np.linalg.solve(columns.T, np.ones(g))
        value, column = _best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        use = np.linalg.solve(columns, demand)
        step = np.linalg.solve(columns, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = column
    use = np.linalg.solve(columns, demand)
    return [(columns[:, i].astype(np.int64), int(use[i] + 1e-7)) for i in range(g) if use[i] >= 1 - 1e-7]


def groups_of(counts: np.ndarray, small: int, groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: (length, count) by falling length, cut into groups of equal cardinality."""
    lengths = [(n, int(counts[n])) for n in range(len(counts) - 1, small, -1) if counts[n]]
    total = sum(c for _, c in lengths)
    quota, out, room = -(-total // groups) if total else 1, [], 0
    for n, c in lengths:
        while c:
            if not room:
                out.append([])
                room = quota
            k = min(c, room)
            out[-1].append((n, k))
            c, room = c - k, room - k
    return out


class _Plan:
    """Ranges (length, rank, count, sequence, offset) and the room left in ranges of sequences."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next = capacity, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.ranges: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.ranges.append((length, self.rank[length], count, sequence, offset))
        self.rank[length] += count

    def new(self, count: int) -> int:
        self.next += count
        return self.next - count


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Ranges as rows (length, first rank, count, first sequence, offset), and how many sequences they take.

    ``counts[n]`` pieces have length n. Range i says: the piece of rank ``first rank + j`` goes to
    sequence ``first sequence + j`` at ``offset``.
    """
    counts = np.array(counts, np.int64)
    plan = _Plan(capacity)
    if counts[capacity]:
        plan.put(capacity, int(counts[capacity]), plan.new(int(counts[capacity])), 0)
        counts[capacity] = 0
    grouped = groups_of(counts, small, groups)
    sizes = [x[0][0] for x in grouped]
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, members in zip(sizes, grouped):
        merged.setdefault(size, []).extend(members)
    sizes = list(merged)
    left = [list(merged[s]) for s in sizes]
    for column, times in configurations(sizes, [sum(c for _, c in x) for x in left], capacity):
        slots = [i for i in range(len(sizes)) for _ in range(column[i])]
        # actual pieces may be fewer than the places of the rounded solution
        supply = [sum(c for _, c in x) for x in left]
        times = min([times, *(supply[i] // column[i] for i in set(slots))])
        if not times:
            continue
        first, done = plan.new(times), 0
        taken = []
        for i in slots:
            runs, want = [], times
            while want:
                n, c = left[i][0]
                k = min(c, want)
                runs.append((n, k))
                want -= k
                if c == k:
                    left[i].pop(0)
                else:
                    left[i][0] = (n, c - k)
            taken.append(runs)
        at = [0] * len(slots)
        spent = [0] * len(slots)
        while done < times:
            k = min(taken[s][at[s]][1] - spent[s] for s in range(len(slots)))
            offset = 0
            for s in range(len(slots)):
                n = taken[s][at[s]][0]
                plan.put(n, k, first + done, offset)
                offset += n
                spent[s] += k
                if spent[s] == taken[s][at[s]][1]:
                    at[s], spent[s] = at[s] + 1, 0
            plan.room[capacity - offset].append((first + done, k))
            done += k
    rest = counts.copy()
    rest[small + 1 :] = 0
    for x in left:
        for n, c in x:
            rest[n] += c
    rooms = sorted(plan.room)
    for n in range(capacity - 1, 0, -1):
        c = int(rest[n])
        while c:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                # a new sequence for each, filled at once with as many of this length as fit
                each = capacity // n
                for per, many in ((each, c // each), (c % each, 1 if c % each else 0)):
                    if many:
                        first = plan.new(many)
                        for j in range(per):
                            plan.put(n, many, first, j * n)
                        _add(plan, rooms, capacity - per * n, first, many)
                c = 0
                break
            room = rooms[i]
            first, k = plan.room[room].pop()
            if k > c:
                plan.room[room].append((first + c, k - c))
                k = c
            if not plan.room[room]:
                rooms.pop(i)
            plan.put(n, k, first, capacity - room)
            _add(plan, rooms, room - n, first, k)
            c -= k
    return np.array(plan.ranges, np.int64).reshape(-1, 5), plan.next


def _add(plan: _Plan, rooms: list[int], room: int, first: int, count: int) -> None:
    if room > 0:
        if not plan.room[room]:
            rooms.insert(bisect_left(rooms, room), room)
        plan.room[room].append((first, count))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): tokenised documents, long ones cut."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        _pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _place(ranges: np.ndarray):
    """Ranks to sequences: the ranges are sorted by (length, rank), which one number can hold."""
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    key = (ranges[:, 0].astype(np.uint64) << np.uint64(48)) + ranges[:, 1].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), side="right") - 1
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(ranges[at, 3] + rank - ranges[at, 1], pa.int64()), pa.array(ranges[at, 4], pa.int64())],
                [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece."""
    pieces = cut(cut_pieces(docs, tokenizer, capacity, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    ranges, _ = plan_packing(counts, capacity)
    parts = max(LEAST_PARTS, int(counts.max()) // RANKED)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "part"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")).mapInArrow(
        _place(ranges), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
