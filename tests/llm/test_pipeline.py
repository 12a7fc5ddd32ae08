"""The corpus pipeline and the registered queries, against brute force on the smallest tables."""

import collections
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsgraph.llm import quality_rules
from newsgraph.llm.catalog import QUERIES, tokenizer_path
from newsgraph.llm.tables import table
from newsgraph.session import stored
from test_operators import components_by_trying, hits_by_trying, scores_by_trying, statistics_by_trying

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]


def pieces_by_trying(documents, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = {}
    for doc, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), capacity):
            part = np.array(ids[at : at + capacity], "<u4")
            found[doc, at // capacity] = (at, len(part), zlib.crc32(part.tobytes()))
    return found


def check_packed(rows, documents):
    expected = pieces_by_trying(documents)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(filled) <= 1.03 * -(-sum(v[1] for v in expected.values()) // 2048) + 1


def test_packing_query(spark, documents):
    check_packed(QUERIES["op1_packing"](spark, SF).collect(), documents)


def test_decontamination_query(spark, documents, benchmark):
    got = sorted((tuple(r) for r in QUERIES["op4_decontamination"](spark, SF).collect()), key=repr)
    assert got == hits_by_trying(documents, benchmark)


def test_decontamination_runs_no_python(spark):
    plan = QUERIES["op4_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_duplicate_query(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op5_near_dup"](spark, SF).collect()}
    assert got == components_by_trying(documents)


def test_sharding_query(spark, documents):
    texts = dict(documents)
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(documents) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language_query(spark):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(rows) == len(langs)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def test_quality_query(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    for doc, text in documents:
        assert tuple(rows[doc][c] for c in quality_rules.COUNTS) == statistics_by_trying(text)
    good = [r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 1").collect()]
    assert np.mean([rows[d]["kept"] or rows[d]["base_failed"] for d in good]) > 0.97


def test_scores_query(spark, documents):
    got = sorted((tuple(r) for r in QUERIES["op9_lm_score"](spark, SF).collect()), key=repr)
    for a, b in zip(got, scores_by_trying(documents), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-3 * b[2])


def test_token_count_query(spark, documents):
    expected = collections.Counter()
    for (doc, _), (_, length, _) in pieces_by_trying(documents).items():
        expected[doc] += length
    got = {r["doc_id"]: r["n_tokens"] + 1 for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    assert got == dict(expected)


def test_pipeline(spark, benchmark):
    docs = table(spark, SF, "documents")
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stored(stage(spark, docs, SF), name)
        assert made.columns == docs.columns
        kept[name] = (texts(docs), texts(made))
        docs = made
    before, after = kept["language_id"]
    assert 0.98 * len(before) <= len(after) <= len(before)
    before, after = kept["quality_rules"]
    failed = {d for d, t in before if (s := statistics_by_trying(t))[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert not failed & {d for d, _ in after} and len(after) > 0.5 * len(before)
    before, after = kept["near_dup"]
    assert sorted(d for d, _ in after) == sorted(d for d, v in components_by_trying(before).items() if v[2])
    before, after = kept["decontamination"]
    assert sorted(d for d, _ in after) == sorted(r[0] for r in hits_by_trying(before, benchmark) if not r[-1])
    check_packed(corpus_pipeline.run(spark, SF).collect(), after)


def test_stages_take_odd_tables(spark):
    docs = table(spark, SF, "documents").limit(40).withColumn("row", F.lit(1)).withColumn("node", F.lit(2))
    odd = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    mixed = docs.union(docs).union(odd)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0
        assert stage(spark, mixed, SF).count() <= 200
