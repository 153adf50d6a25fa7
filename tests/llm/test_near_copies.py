"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from monsoonway.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return 1.0 if x == y else len(x & y) / len(x | y)


def brute(rows):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(rows[i][1], rows[j][1]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        rank = (r[0] is None, r[0] or 0)
        best[g] = min(best.get(g, rank), rank)
    return sorted(best.values())


@pytest.fixture(scope="module")
def edited():
    """Texts, each with copies of which one to nine words in a hundred differ: likeness from far under 0.8 up to 0.95."""
    draw = np.random.default_rng(8)
    words = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(60):
        text = draw.choice(words, 200)
        out.append(" ".join(text))
        for edits in (1, 2, 3, 4, 5, 6, 9):
            copy = text.copy()
            copy[draw.choice(200, edits, replace=False)] = "other"
            out.append(" ".join(copy))
    return [out[i] for i in draw.permutation(len(out))]


def test_near_dedup_equals_brute_force(spark, edited):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(edited)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == brute(rows)


def test_near_dedup_with_null_and_repeated_ids(spark, edited):
    a, b, c, d, e = (f"{t} mark{i}" for i, t in enumerate([" ".join(f"{p}{i}" for i in range(60)) for p in "abcde"]))
    rows = [(None, a), (None, b), (7, c), (7, d), (None, a), (7, c), (3, d + " tail"), (None, e), (9, e), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    want = [(None, a), (None, b), (7, c), (3, d + " tail"), (9, e), (None, "")]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted((str(i), t) for i, t in want)
    assert kept[0].asDict().keys() == set(docs.columns)


def test_near_dedup_of_a_large_group(spark):
    """Copies of one base, each with edits of its own, all in the same lists."""
    draw = np.random.default_rng(9)
    base = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(base)]
    for i in range(150):
        copy = base.copy()
        copy[draw.choice(300, 3, replace=False)] = f"own{i}"
        texts.append(" ".join(copy))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [0]
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


@pytest.mark.parametrize("tile", [512, 30])
def test_copies_of_one_base_that_are_unlike_each_other(spark, monkeypatch, tile):
    """Every copy is alike to the base alone, so the order of a long list does not tie it."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    draw = np.random.default_rng(10)
    base = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(base)]
    for i in range(120):
        copy, at = base.copy(), int(draw.integers(0, 270))
        copy[at : at + 26] = [f"own{i}x{j}" for j in range(26)]
        texts.append(" ".join(copy))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert brute(rows) == [(False, 0)]
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [0]
