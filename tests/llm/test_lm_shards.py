"""Shards of the language model grow with the corpus, not with the session's partitions."""

import random

import pyarrow as pa

from newsgraph.llm import lm_score
from newsgraph.llm.tables import salt_count
from test_operators import by_id, scores_by_trying, sentence


def test_shards_follow_the_tokens(spark, monkeypatch):
    rng, asked = random.Random(9), []
    docs = spark.createDataFrame([(k, sentence(rng, 50)) for k in range(40)], "doc_id long, text string")
    deal = lm_score.occurrences
    monkeypatch.setattr(lm_score, "occurrences", lambda docs, hot, shards: asked.append(shards) or deal(docs, hot, shards))
    few = by_id(lm_score.score_documents(docs), "n_tokens", "n_known", "score")
    monkeypatch.setattr(lm_score, "PER_SHARD", 100)
    many = by_id(lm_score.score_documents(docs), "n_tokens", "n_known", "score")
    assert asked == [salt_count(spark), 21]  # 40 texts of 50 words and an end
    assert few.keys() == many.keys()
    for k, (tokens, known, score) in many.items():
        assert few[k][:2] == (tokens, known) and abs(few[k][2] - score) < 1e-3 * tokens


def test_one_pair_in_half_of_all_tokens(spark, monkeypatch):
    """The pair stands in many shards, and scores are those of the whole counts."""
    rng = random.Random(11)
    documents = [(k, " ".join(["so much"] * 40) if k % 2 else sentence(rng, 30)) for k in range(200)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(12, "doc_id").persist()
    shards, dealt = 7, []
    monkeypatch.setattr(lm_score, "SLICE_TEXTS", 5)
    deal = lm_score.occurrences
    monkeypatch.setattr(lm_score, "occurrences", lambda docs, hot, n: dealt.append((hot, deal(docs, hot, n))) or dealt[0][1])
    got = sorted((tuple(r) for r in lm_score.score_documents(docs, shards).collect()), key=repr)
    for a, b in zip(got, scores_by_trying(documents), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-3 * b[2]

    hot, rows = dealt[0]
    assert 0 < len(hot[2]) <= shards
    much = lm_score.tokens_of(pa.array(["so much"]))[0][1].tobytes()
    in_shards = {r["shard"] for r in rows.collect() if much in bytes(r["words"])}
    assert len(in_shards) == shards
