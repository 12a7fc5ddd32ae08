"""Buckets with many classes that are not linked: the same components, met in bounded blocks."""

import random

import pytest

from newsgraph.llm import near_dup
from test_operators import by_id, components_by_trying, sentence


def boilerplate(n, groups):
    """Texts that share a long passage but are under the threshold, and some chains of near copies of them."""
    rng = random.Random(11)
    shared = sentence(rng, 80).split()
    documents = [(k, " ".join(shared + sentence(rng, 55).split())) for k in range(n)]
    for g in range(groups):
        words = documents[g * 3][1].split()
        for step in range(3):
            words = list(words)
            words[90 + 9 * step] = sentence(rng, 1)
            documents.append((n + g * 3 + step, " ".join(words)))
    rng.shuffle(documents)
    return documents


@pytest.mark.parametrize(
    "sizes", [{"CROWD": 4, "RUN": 7, "BLOCK": 16}, {"CROWD": 0, "RUN": 1, "BLOCK_SHINGLES": 300, "LARGE": 2}, {"CROWD": 4, "LARGE": 1, "BLOCK": 5}]
)
def test_crowded_buckets(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(near_dup, name, value)
    documents = boilerplate(150, 20)
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    wanted = components_by_trying(documents)
    assert by_id(near_dup.near_duplicates(docs), "n_shingles", "component_id", "kept") == wanted
    assert 100 < sum(v[2] for v in wanted.values()) < len(documents)
