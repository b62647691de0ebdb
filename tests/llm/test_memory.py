"""What a Python worker of the pipeline's stages holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import ngram_join, quality
from orrery.llm import text as T


@pytest.mark.parametrize("step", [quality._features, lambda texts: ngram_join._sets(texts, 5)])
def test_words_are_looked_at_in_small_lots(monkeypatch, step):
    monkeypatch.setattr(T, "_powers", {})
    texts = pa.array([" ".join(f"w{(i * 7919 + j) % 9973}" for j in range(400)) for i in range(2000)])
    tracemalloc.start()
    try:
        rows = sum(x[1] - x[0] for x in step(texts))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert most < 24e6


def test_a_kept_text_is_sent_once(spark):
    rows = [(i, "one two three " * (i % 5) or None, f"s{i % 3}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    kept = quality.score(docs, w, *docs.columns)
    assert kept.columns == [*docs.columns, "quality_score"]
    assert "text_to_score" not in kept._jdf.queryExecution().analyzed().toString()
    apart = {r.doc_id: r.quality_score for r in quality.score(docs, w, "doc_id").collect()}
    assert sorted(map(tuple, kept.collect())) == sorted((*r, apart[r[0]]) for r in rows)
