"""The pipeline's near-dedup meets its candidates by the sketches of op12."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from monsoonway.llm import fast_minhash, near_copies


def test_candidates_meet_by_fast_sketches(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "one_of_each", lambda docs, banded: asked.append(banded) or docs)
    corpus_pipeline.drop_near_copies(spark, spark.range(1), "")
    texts = [b"a b c d e f g h", b"A  b c d e f g h", b"one", b"", None]
    rows = pa.record_batch([pa.array(range(5), pa.int64()), pa.array(texts, pa.binary())], ["entry", "text"])
    found = pa.Table.from_batches(asked[0](iter([rows]))).to_pydict()
    assert list(found) == ["entry", "bands"] and found["entry"] == [0, 1, 2, 3, 4]
    sets = [near_copies.shingles(t.lower().split()) for t in texts[:3]]
    want = fast_minhash.band_keys(fast_minhash.sketches(sets, near_copies.BANDS * fast_minhash.ROWS))
    assert (np.array(found["bands"][:3]) == want).all()
    # texts without words are copies of each other and of nothing else
    assert found["bands"][3] == found["bands"][4] and not set(found["bands"][3]) & set(found["bands"][2])


def test_a_pair_at_the_least_likeness_is_not_missed(spark):
    """24 bands of five coordinates had no key in common for these two texts, alike by 8 shingles of 10."""
    words = [f"w36947x{i}" for i in range(14)]
    rows = [(1, " ".join(words[:13]), "en", "s", 0), (2, " ".join(words[1:]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]


def test_a_stage_sends_few_texts_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows, want in ((10_000, 2_000), (0, 2_000), (500, 500)):
            spark.conf.set(key, rows)
            corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "")
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)
