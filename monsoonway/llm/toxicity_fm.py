"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and the first letters of longer words (``PREFIXES``), hashed to
``BUCKETS`` numbers. Beside a weight each term has ``FACTORS`` latent factors, so a pair of terms adds
the product of theirs (Rendle 2010): an insult beside the mention of a group can score more than both alone.

Every hashed term of the fitted rows takes part. The values of terms shrink by evidence and none is left out: linear
values by how far the term's documents depart from the label's rate, factor values by how many documents have
the term. So a mention that says nothing by itself still enters its pairs with full value. Both sums are
divided by the size of the text's values, so long texts do not saturate.

The classifier is fitted on the driver from at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash; its size is
bounded by ``BUCKETS``.

Rows. Null and empty texts have no term and get the score of the bias. Labelled rows that are null
in id or label, or that name no document, teach nothing; a document with several labels counts as toxic if one
says so. Without any labels every score is 0. A very long text counts by its distinct words; an empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import bounded_sample, crc_remainder, in_slices, worker_slot

BUCKETS = 1 << 20
PREFIXES = (4, 5)
FACTORS = 4
TRAIN_ROWS = 20_000
#: Evidence at which a linear value is half its most, and documents at which a factor value is.
EVIDENCE, DOCUMENTS = 30.0, 30.0
#: What the linear sum of a text can reach for a weight of 1 in each of its terms.
LINEAR = 3.0
EPOCHS, STEP = 8, 0.15
SHRINK_WEIGHT, SHRINK_FACTOR = 2e-3, 1e-2
THRESHOLD = 0.3
REMEMBERED = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


def hashed(word: str) -> list[int]:
    """The hashed numbers of a word and of its prefixes."""
    return [zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(f"^{word[:n]}".encode()) % BUCKETS for n in PREFIXES if len(word) > n)]


class Terms(dict):
    """Words to the positions of their terms among the known ones, 21 bits each, remembered; 0 stands for none."""

    def __init__(self, known: np.ndarray) -> None:
        self.position = np.zeros(BUCKETS, np.int64)
        self.position[known] = np.arange(1, len(known) + 1)

    def __missing__(self, word: str) -> int:
        at = 0
        for t in hashed(word):
            at = at << 21 | int(self.position[t])
        self[word] = at
        return at

    def of(self, text: str | None) -> np.ndarray:
        words = set(_LETTERS.findall((text or "").lower()))
        if len(self) > REMEMBERED:
            self.clear()
        packed = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        packed = packed[packed > 0]
        found = np.unique(np.concatenate([packed & 0x1FFFFF, packed >> 21 & 0x1FFFFF, packed >> 42]))
        return found[found > 0] - 1


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally = {0: [], 1: []}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = {t for w in set(_LETTERS.findall((text or "").lower())) for t in hashed(w)}
            tally[toxic].append(np.fromiter(terms, np.int64, len(terms)))
        for toxic, rows in tally.items():
            if rows:
                # -1 counts the documents
                term, n = np.unique(np.concatenate([*rows, np.full(len(rows), -1)]), return_counts=True)
                yield pa.record_batch([pa.array(term, pa.int64()), pa.array(np.full(len(term), toxic), pa.int32()), pa.array(n, pa.int64())], ["term", "toxic", "n"])


def _vectors(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(known)
        for batch in in_slices(batches, 0):
            yield pa.record_batch([pa.array([terms.of(t).astype(np.int32) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["terms", "toxic"])

    return run


class Machine:
    """A factorization machine over ``known`` hashed terms, with the values of each term in the linear and the paired sum."""

    def __init__(self, known: np.ndarray, linear: np.ndarray, paired: np.ndarray, bias: float) -> None:
        self.known, self.linear, self.paired, self.bias = known, linear.astype(np.float32), paired.astype(np.float32), bias
        self.weight = np.zeros(len(known), np.float32)
        self.factors = np.random.default_rng(7).normal(0, 0.02, (len(known), FACTORS)).astype(np.float32)

    def values(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of a text's terms, divided by their size in the text."""
        x, z = self.linear[terms].astype(float), self.paired[terms].astype(float)
        return x * (LINEAR / np.sqrt((x * x).sum() + 1)), z / np.sqrt((z * z).sum() + 1e-9)

    def margin(self, terms: np.ndarray) -> float:
        x, z = self.values(terms)
        v = self.factors[terms] * z[:, None]
        return float(self.bias + self.weight[terms] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))

    def score(self, terms: np.ndarray) -> float:
        if self.bias == -np.inf:  # fitted without labels
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.margin(terms), -30, 30))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, known: np.ndarray, hit: np.ndarray, miss: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Logistic loss, AdaGrad over the terms of one row at a time, a fixed order of rows; ``hit`` and ``miss`` documents of each label have a term."""
    rate = float(np.clip(toxic.mean(), 1e-4, 1 - 1e-4))
    seen = hit + miss
    departs = (hit - seen * rate) ** 2 / (seen * rate * (1 - rate) + 0.5)
    machine = Machine(known, departs / (departs + EVIDENCE), seen / (seen + DOCUMENTS), float(np.log(rate / (1 - rate))))
    draw, (w, v) = np.random.default_rng(7), (machine.weight, machine.factors)
    gw, gv, gb = np.full(len(known), 1e-2, np.float32), np.full((len(known), FACTORS), 1e-2, np.float32), 1e-6
    for epoch in range(epochs):
        step = STEP / (1 + 0.1 * epoch)
        for r in draw.permutation(len(rows)):
            t = rows[r]
            x, z = machine.values(t)
            vt = v[t] * z[:, None]
            total = vt.sum(axis=0)
            margin = machine.bias + w[t] @ x + 0.5 * ((total**2).sum() - (vt**2).sum())
            off = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic[r]
            gb += off * off
            machine.bias -= step * 0.2 * off / np.sqrt(gb)
            if not len(t) or abs(off) < 1e-3:
                continue
            d = off * x
            gw[t] += d * d
            w[t] -= step * (d + SHRINK_WEIGHT * w[t] * x) / np.sqrt(gw[t])
            d = off * z[:, None] * (total - vt) + SHRINK_FACTOR * vt
            gv[t] += d * d
            v[t] -= step * 0.3 * d / np.sqrt(gv[t])
    return machine


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = bounded_sample(known, "label_doc", rows, "toxicity")
    # at most about ``rows`` short rows: their size is bounded
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_doc")).select("text", "toxic")
    of = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0))
    counts = sample.mapInArrow(_document_counts, "term long, toxic int, n long").groupBy("term").agg(of(1).alias("hit"), of(0).alias("miss")).toPandas().sort_values("term")  # BUCKETS rows at most
    if counts.empty:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), -np.inf)
    counts = counts[counts["term"] >= 0]
    terms = counts["term"].to_numpy(np.int64)
    got = sample.mapInArrow(_vectors(terms), "terms array<int>, toxic int").toArrow()
    lists, toxic = got.column("terms").combine_chunks(), got.column("toxic").to_numpy().astype(float)
    flat, begin = lists.values.to_numpy(), lists.offsets.to_numpy()
    vectors = [flat[i:j] for i, j in zip(begin[:-1], begin[1:])]  # views of one array
    order = sorted(range(len(vectors)), key=lambda i: (zlib.crc32(vectors[i].tobytes()), toxic[i]))
    return fit([vectors[i] for i in order], toxic[order], terms, counts["hit"].to_numpy(float), counts["miss"].to_numpy(float))


def _score(held, token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # later tasks of this worker find the machine, and the words that earlier ones met
        machine, terms = worker_slot(f"toxicity {token}", lambda: (held.value, Terms(held.value.known)))
        for batch in in_slices(batches, "text"):
            found = np.array([machine.score(terms.of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], float)
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs``; only text decides."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return marked.mapInArrow(_score(held, uuid.uuid4().hex), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rate_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows that are not held out and scores all rows of ``docs``."""
    return score(docs, train(docs, labels.where(crc_remainder("doc_id", 4) != 2)))
