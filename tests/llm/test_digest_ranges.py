"""The whole result of the digest operator against brute force, with ranges of few rows that are cut between quantiles."""

import hashlib
import re
import unicodedata
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from monsoonway.llm import exact_digest
from monsoonway.llm.queries import op10_exact_digest

DATA = Path("/root/testdata/sf0.001")


def canonical(text):
    compose = lambda t: unicodedata.normalize("NFC", t)
    return re.sub(r"[\s\x85]+", " ", compose(compose(text).casefold())).strip(" ")


def expected(rows):
    """By id: n_chars, edited_sha256, near_edited, near_next of (doc_id, text) with distinct ids."""
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 3
        edit = t[: len(t) - k] + n[:k]
        out[d] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), float(canonical(edit) == canonical(t)), float(canonical(n) == canonical(t)))
    return out


def compared(found, rows):
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found} == expected(rows) and len(found) == len(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    texts = {d: canonical(t or "") for d, t in rows}
    assert len(set(prints.values())) == len(set(texts.values())) == len({(prints[d], texts[d]) for d in prints})


def test_query_equals_brute_force(spark):
    table = pq.read_table(DATA / "documents.parquet", columns=["doc_id", "text"])
    compared(op10_exact_digest(spark, str(DATA)).collect(), list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text")))))


@pytest.mark.parametrize("chars", [40, 300, 5000])
def test_short_ranges(spark, monkeypatch, chars):
    """Ids that crowd together, gaps between them, and more ranges than quantiles and blocks."""
    monkeypatch.setattr(exact_digest, "RANGE_CHARS", chars)
    monkeypatch.setattr(exact_digest, "QUANTILES", 4)
    monkeypatch.setattr(exact_digest, "BLOCKS", 3)
    ids = [*range(60), *range(10_000, 10_020), 2**62, 2**62 + 1, 2**62 + 2, -(2**60), -5]
    rows = [(d, None if i % 17 == 3 else f"Text {d % 7} of " + "word " * (i % 11)) for i, d in enumerate(ids)]
    compared(exact_digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64, 1000])
def test_ranges_rise_with_the_key(spark, monkeypatch, ranges):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_digest, "QUANTILES", 8)
    keys = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("order_key")).unionByName(spark.createDataFrame([(-1e19,), (0.0,), (0.0,)], "order_key double"))
    edges = exact_digest._range_edges(keys, ranges)
    assert len(edges) <= 9
    found = keys.select("order_key", exact_digest._range_of(edges, F.col("order_key"), ranges).alias("range")).orderBy("order_key").collect()
    held = [r["range"] for r in found]
    assert held == sorted(held) and len(set(held)) >= min(ranges, 8) / 2 and all(a["range"] == b["range"] for a, b in zip(found, found[1:]) if a["order_key"] == b["order_key"])
    assert exact_digest._range_edges(keys.limit(0), ranges) == []
