"""Recall of the forest on large tables, and the rows that a query reads there."""

import numpy as np
import pytest

from monsoonway.llm.ann_forest import READS, SAMPLE, TREES, Forest


def unit(rows, seed=1):
    x = np.random.default_rng(seed).normal(size=(rows, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_holds_on_a_large_table():
    draw = np.random.default_rng(1)
    x = unit(105_000)
    forest = Forest(x[draw.choice(len(x), SAMPLE, replace=False)], len(x))
    leaves = np.stack(list(forest.leaves_of(x)), axis=1)
    hits = 0
    for q in draw.choice(len(x), 40, replace=False):
        near = np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]
        hits += np.isin(leaves[near], forest.search(x[q])).any(axis=1).sum()
    assert hits >= 0.9 * 400


@pytest.mark.parametrize("rows", [50_000, 200_000])
def test_rows_read_do_not_grow_with_the_table(rows):
    """Clusters of 500: a query reads no more rows of the larger table, and finds its cluster in both."""
    draw = np.random.default_rng(2)
    centre = unit(rows // 500, 3)
    x = np.repeat(centre, 500, axis=0) + 0.05 * draw.normal(size=(rows, 64))
    forest = Forest(x[draw.choice(rows, SAMPLE, replace=False)], rows)
    leaves = np.stack(list(forest.leaves_of(x)), axis=1)
    hits = 0
    for q in draw.choice(rows, 20, replace=False):
        read = np.isin(leaves, forest.search(x[q]))
        assert read.sum() <= 1.5 * min(READS, rows * TREES / 2)
        hits += read[np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]].any(axis=1).sum()
    assert hits >= 0.95 * 200


def test_a_vector_that_fills_leaves_is_split_elsewhere():
    x = np.concatenate([unit(1000), np.repeat(unit(1, 9), 500, axis=0)])
    forest = Forest(x, len(x))
    for leaf in forest.leaves_of(x):
        assert len(np.unique(leaf[1000:])) == 1 and len(np.unique(leaf[:1000])) >= 10
