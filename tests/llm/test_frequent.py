"""The order of shingles in prefixes must know a shared passage however large the corpus is."""

import numpy as np

from lodestream.llm import jaccard
from lodestream.llm.decontam import let_through


def _docs(spark):
    """2,000 unlike texts, of which every 30th has the same passage of forty words."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + (f" {passage}" if i % 30 == 0 else "")) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), np.sort(jaccard.shingle_set(passage))


def test_passages_are_frequent_in_a_large_corpus(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 20)
    docs, shared = _docs(spark)
    often, count, *_ = jaccard.frequent_shingles(docs)
    low = [s for s in shared if s < np.iinfo("<i8").min // 2]  # by hash in the part of each set that is counted
    assert low and set(low) <= set(often.tolist()) and len(often) == len(count)


def test_frequent_shingles_beyond_the_list_are_in_a_filter(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_HELD", 1)
    docs, _ = _docs(spark)
    often, count, rest = jaccard.frequent_shingles(docs)
    assert len(often) == len(count) == 1 and rest is not None
    monkeypatch.setattr(jaccard, "_HELD", 100_000)
    every, _, none = jaccard.frequent_shingles(docs)
    assert none is None and len(let_through(every.view(np.uint64), *rest)) == len(every) > 1
    s = np.sort(np.concatenate((every, np.arange(-5, 5))))
    assert set(jaccard.in_order(s, often, count, rest)[-len(every) :].tolist()) == set(every.tolist())
