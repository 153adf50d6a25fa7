"""Language identification: words first, then shorter and shorter character n-grams.

Training counts words and character n-grams per language. A document is the sum over its words of
per-language log frequencies: those of the word itself if it is known, else the mean of those of its
longest known character n-grams, from ``ORDERS`` letters with word boundaries down to one.

The model is fitted on at most about ``TRAIN_ROWS`` labelled rows of each language, chosen by a hash of id and text,
and keeps every word and n-gram of them. A language with any labelled row that has a letter is in the model, however
large the others are.

Rows. A letter is a character of Unicode category L; marks after it belong to its word. Text that is null or has no
letter is ``und`` with score 0. So is every text if nothing was learned. Equal scores go to the smaller language name.
Rows with a null language or id teach nothing. Repeated rows are scored alike, very long texts are read whole in parts,
an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import crc_remainder, worker_slot

TRAIN_ROWS = 500
ORDERS = 5
#: Words that a worker remembers between batches.
REMEMBERED = 200_000
#: What an n-gram's evidence counts against a known word's.
BACKOFF = 0.6
#: Texts that are scored at once.
SLICE = 512
UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(_LETTERS.findall((text or "").lower()))
        out = []
        for lang, seen in words.items():
            grams = [Counter() for _ in range(ORDERS + 1)]
            grams[0] = seen
            for word, n in seen.items():
                edged = f"^{word}$"
                for order in range(1, ORDERS + 1):
                    for i in range(len(edged) - order + 1):
                        grams[order][edged[i : i + order]] += n
            out += [(lang, order, g, n) for order, c in enumerate(grams) for g, n in c.items()]
        for i in range(0, len(out), 50_000):
            lang, order, gram, n = zip(*out[i : i + 50_000])
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(order, pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "grade", "gram", "n"])


class Model:
    """Log frequencies: ``tables[0]`` of words, ``tables[k]`` of k-grams, each a row of ``scores``."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], scores: np.ndarray) -> None:
        self.langs, self.tables, self.scores = langs, tables, scores
        self.token = uuid.uuid4().hex

    def backoff(self, word: str) -> np.ndarray:
        edged = f"^{word}$"
        for order in range(ORDERS, 0, -1):
            table = self.tables[order]
            if found := [table[g] for i in range(len(edged) - order + 1) if (g := edged[i : i + order]) in table]:
                return self.scores[found].mean(axis=0) * BACKOFF
        return np.zeros(len(self.langs), np.float32)


def sample_by_language(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` distinct texts of each language at most, the same ones in every run; all of a language with fewer, and always one.

    Repeated rows are one text, however many they are. Only rows with a letter count.
    """
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "text"), F.lit(1 << 30)) / float(1 << 30)
    known = labelled.where(F.col("text").rlike(r"\p{L}")).select("text", "lang", drawn.alias("drawn"))
    texts = known.select("lang", "drawn", F.xxhash64("text").alias("hash")).distinct()
    counts = texts.groupBy("lang").agg((F.lit(float(rows)) / F.count("*")).alias("share"), F.min("drawn").alias("least")).withColumnRenamed("lang", "its")
    # one short row for each language that the labels name
    chosen = known.join(F.broadcast(counts), F.col("lang") == F.col("its")).where((F.col("drawn") < F.col("share")) | (F.col("drawn") == F.col("least")))
    return chosen.select("text", "lang").distinct()


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of the rows of ``labelled(doc_id, text, lang)`` with a language and an id."""
    known = labelled.where("lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counted = sample_by_language(known, rows).mapInArrow(_count, "lang string, grade int, gram string, n long").groupBy("lang", "grade", "gram").agg(F.sum("n").alias("n")).toArrow()
    code = counted.column("lang").combine_chunks().dictionary_encode()
    names = code.dictionary.to_pylist()
    langs = sorted(names)
    lang = np.array([langs.index(x) for x in names], np.int64)[code.indices.to_numpy()]
    grade, n = counted.column("grade").to_numpy(), counted.column("n").to_numpy()
    tables: list[dict[str, int]] = [{} for _ in range(ORDERS + 1)]
    parts, base = [], 0
    for order in range(ORDERS + 1):
        own = np.flatnonzero(grade == order)
        table = tables[order]
        at = np.fromiter((table.setdefault(g, base + len(table)) for g in counted.column("gram").take(pa.array(own)).to_pylist()), np.int64, len(own)) - base
        seen = np.zeros((len(table), len(langs)), np.float32)
        seen[at, lang[own]] = n[own]
        totals = seen.sum(axis=0, dtype=np.float64) + 1
        freq = np.log((seen + 0.1) / (totals + 0.1 * len(table)).astype(np.float32))
        parts.append(freq - freq.mean(axis=1, keepdims=True) if len(langs) else freq)
        base += len(table)
    return Model(langs, tables, np.concatenate(parts).astype(np.float32))


class Scorer:
    """Looks words up, remembering those that had to back off."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        scorer = self

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = at = scorer.add(word)
                return at

        self.known = Known(self.model.tables[0])
        self.size = len(self.model.scores)
        self.scores = np.concatenate([self.model.scores, np.zeros((1 << 14, len(self.model.langs)), np.float32)])

    def add(self, word: str) -> int:
        if self.size == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((self.size // 2, len(self.model.langs)), np.float32)])
        self.scores[self.size] = self.model.backoff(word)
        self.size += 1
        return self.size - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall((text or "").lower())
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        if len(self.known) > REMEMBERED + len(self.model.tables[0]):
            self.reset()
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), 1 << 16):
            at = np.fromiter(map(self.known.__getitem__, words[i : i + (1 << 16)]), np.int64)
            total += self.scores[at].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        # confidence by the evidence of a word on average, no surer than 20 such words would make it
        lead = np.exp((total - total[best]) / len(words) * min(len(words), 20))
        return self.model.langs[best], float(1 / lead.sum())


def _scorer(held, token: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # later tasks of this worker find the model, and the words that earlier ones met
        scorer = worker_slot(f"langid {token}", lambda: Scorer(held.value))
        for batch in batches:
            found = [scorer.predict(t) for i in range(0, len(batch), SLICE) for t in batch.slice(i, SLICE).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of the ``keep`` columns with lang_pred and score; only text is read, and it alone travels to Python."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = F.arrow_udf(_scorer(held, model.token), "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()  # evaluated once
    chosen = docs.select(*(F.col(f"`{c}`") for c in keep), scored(F.col("text")).alias("found__"))
    return chosen.select(*(F.col(f"`{c}`") for c in keep), "found__.lang_pred", "found__.score")


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score): learns from the rows that are not held out."""
    fold = crc_remainder("doc_id", 3)
    model = train(docs.where(fold != 1))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, ("doc_id", "held_out"))
