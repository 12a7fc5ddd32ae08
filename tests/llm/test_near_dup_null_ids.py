"""Near copies among documents without an id."""

import random

from newsgraph.llm import near_dup
from test_operators import sentence


def changed(words, *places):
    return " ".join("changed" if k in places else w for k, w in enumerate(words))


def test_texts_without_an_id_are_linked(spark):
    rng = random.Random(12)
    bridge, other = sentence(rng, 100).split(), sentence(rng, 100).split()
    # 1 and 2 are alike only by way of a text without an id; two more texts have no id at all.
    named = [(1, changed(bridge, 10, 30)), (2, changed(bridge, 60, 80))]
    nameless = [(None, " ".join(bridge)), (None, " ".join(other)), (None, changed(other, 50)), (None, changed(other, 50))]
    docs = spark.createDataFrame(named + nameless, "doc_id long, text string")
    made = near_dup.near_duplicates(docs)
    assert made.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = sorted((tuple(r) for r in made.select("doc_id", "component_id", "kept").collect()), key=repr)
    expected = [(1, 1, True), (2, 1, False), (None, 1, False), *[(None, None, True)] * 3]
    assert found == sorted(expected, key=repr)
    left = [tuple(r) for r in near_dup.keep_one(docs).collect()]
    assert named[0] in left and len(left) == 2 and left != [named[0]] * 2
