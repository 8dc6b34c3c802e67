"""A filter beyond its bound is broadcast in groups of its parts."""

import pytest

from trackweave.llm import lm, tokens


def test_groups_of_parts_score_as_the_whole_filter(spark, monkeypatch):
    monkeypatch.setattr(tokens, "bucket_bits", lambda *a: 3)
    texts = [(i, " ".join(f"w{(i * i + k * k) % 23}" for k in range(40))) for i in range(30)] + [(30, None), (31, ""), (5, "w1 w2"), (5, "w1 w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda **limits: sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm.report(docs, **limits).collect())
    whole = rows()
    # Before, pairs of tokens of all texts were written and shuffled as soon as the filter passed its bound.
    monkeypatch.setattr(lm, "_by_shuffle", lambda *a: pytest.fail("tokens were shuffled"))
    assert len(whole) == 34 and rows(broadcast_bytes=1) == whole
    trained = lm.train(docs)
    assert rows(broadcast_bytes=trained.filter_bytes // 2) == whole


def test_tokens_that_came_once_go_with_the_groups(spark, monkeypatch):
    """Before, with more types than are broadcast, the tokens and pairs of all texts were written and shuffled (F1)."""
    monkeypatch.setattr(tokens, "bucket_bits", lambda *a: 3)
    texts = [(i, " ".join([*(f"w{(i * i + k * k) % 23}" for k in range(30)), *(f"once{i}x{k}" for k in range(9)), "w3", f"w{i}"])) for i in range(40)] + [(40, None), (41, ""), (5, "w1 once3x4 new w2"), (5, "w1 once3x4 new w2"), (42, "once3x4")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda **limits: sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm.report(docs, **limits).collect())
    whole, shuffled = rows(), rows(broadcast_tokens=1)
    monkeypatch.setattr(lm, "_by_shuffle", lambda *a: pytest.fail("tokens were shuffled"))
    assert len(whole) == len(texts) and shuffled == whole
    trained = lm.train(docs)
    for size in (1, trained.filter_bytes // 2, 1 << 30):
        assert rows(broadcast_tokens=100, broadcast_bytes=size) == whole
    assert trained.n_once > 200 and trained.n_types - trained.n_once < 100
