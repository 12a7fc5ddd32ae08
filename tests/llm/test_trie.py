"""The trie's pointer level and the ranges of children."""

import numpy as np
import pytest

from newsgraph.llm.elias_fano import BigramTrie, EliasFano, MappedFile


@pytest.mark.parametrize("top", [3, 900, 1 << 50])
def test_elements_at_places(top):
    values = np.sort(np.random.Generator(np.random.PCG64(3)).integers(0, top, 1000)).astype(np.uint64)
    held = EliasFano(values, MappedFile())
    places = np.random.Generator(np.random.PCG64(4)).permutation(1000)
    assert (held.at(places) == values[places]).all()


def test_children_are_found_in_the_range_of_their_word():
    rng = np.random.Generator(np.random.PCG64(5))
    words = np.unique(rng.integers(0, 1 << 60, 60)).astype(np.uint64)
    contexts = np.unique(rng.integers(0, 1 << 40, 30)).astype(np.uint64)
    there = rng.random((len(words), len(contexts))) < rng.random(len(words))[:, None]
    there[[0, 7, 8, -1]] = False  # words without children
    word, number = np.nonzero(there)
    trie = BigramTrie(words, word, contexts[number], np.arange(len(word), dtype=float))
    begins = trie.begins.at(np.arange(len(words) + 1)).astype(np.int64)
    assert (np.diff(begins) == there.sum(axis=1)).all()
    asked_word, asked = np.indices(there.shape).reshape(2, -1)
    value, found = trie.find(asked_word, contexts[asked])
    assert (found == there.ravel()).all()
    assert np.allclose(value[found], np.arange(len(word)), atol=0.1)
    assert not trie.find(np.array([3]), np.array([contexts[-1] + np.uint64(1)]))[1].any()
    empty = BigramTrie(words, word[:0], contexts[:0], np.zeros(0))
    assert not empty.find(np.array([0, 5]), contexts[:2])[1].any()
