"""Repeated training rows, and workers that have no copy of the package."""

import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.llm import language_id, sharding, url_filter
from newsgraph.llm.catalog import tokenizer_path
from newsgraph.llm.tokens import text_encoder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KINDS = {"aa": "abcde ", "bb": "fghijé ", "cc": "klmno "}
SCHEMA = "doc_id long, text string, lang string"


def texts(rng, ids):
    made = []
    for k in ids:
        lang = list(KINDS)[k % 3]
        made.append((k, "".join(rng.choice(KINDS[lang]) for _ in range(rng.randint(20, 200))) + KINDS[lang][0], lang))
    return made


@pytest.mark.parametrize("spare", [8, 1])
def test_repeated_training_rows_count_once(spark, monkeypatch, spare):
    monkeypatch.setattr(language_id, "SPARE", spare)
    monkeypatch.setattr(language_id, "TEXTS_PER_LANGUAGE", 40)
    rows = texts(random.Random(1), range(300))
    plain = spark.createDataFrame(rows, SCHEMA)
    copied = spark.createDataFrame(rows + rows[:9] * 1000, SCHEMA).repartition(4)
    models = [language_id.fit(df, 40, 30) for df in (plain, copied)]
    assert models[0].languages == models[1].languages == list(KINDS)
    # The same texts are chosen, whatever is repeated.
    assert np.array_equal(models[0].landmarks, models[1].landmarks)
    assert np.allclose(models[0].weights, models[1].weights)
    picked = language_id.choose(copied, 40)
    assert {r["name"]: r["count"] for r in picked.groupBy("name").count().collect()} == dict.fromkeys(KINDS, 40)
    told = language_id.identify(copied).select("doc_id", "lang_pred").distinct().collect()
    assert sorted(map(tuple, told)) == sorted((k, lang) for k, _, lang in rows)


def test_one_id_on_many_texts(spark):
    rng = random.Random(2)
    rows = texts(rng, range(90)) + [(3, t, lang) for _, t, lang in texts(rng, range(3000))]
    made = language_id.predict(spark.createDataFrame(rows, SCHEMA), language_id.fit(spark.createDataFrame(rows, SCHEMA)))
    assert made.filter(F.col("row.lang") != F.col("lang_pred")).count() == 0


def test_ids_of_letters_whose_lower_case_has_a_mark():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    encode = text_encoder(tokenizer_path(), False)
    rng = random.Random(3)
    for text in ["İ.", "aİ,", "İstanbul!"] + ["".join(rng.choice("İIıiaé.,!?# ") for _ in range(12)) for _ in range(500)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_queries_run_where_workers_have_no_copy_of_the_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as entry\n"
        "from newsgraph.session import local_session\n"
        "spark = local_session(4, 'elsewhere', '3g')\n"
        "for name, run in entry.queries().items():\n"
        "    if name == 'pipeline' or name in entry.LLM_QUERIES or name in ('tone_density', 'node_embeddings'):\n"
        "        run(spark, '/root/testdata/sf0.001').write.format('noop').mode('overwrite').save()\n"
        "        print(name, flush=True)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout[-500:] + done.stderr[-2000:]


def test_growth_by_several_shards_and_by_other_weights(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = [1.0, 2.0, 1.0, 0.5]
    for grown in ([*weights, 1.5, 3.0], weights, [2.0, 2.0, 1.0, 0.5, 1.0], [1.0, 2.0]):
        made = sharding.shard_documents(docs, weights, grown).withColumn("whole", sharding.rendezvous_shard(F.col("doc_id"), grown))
        assert made.filter(F.col("grown_shard") != F.col("whole")).count() == 0
        assert made.filter(F.col("shard") != sharding.rendezvous_shard(F.col("doc_id"), weights)).count() == 0
    moved = sharding.shard_documents(docs, weights, [*weights, 1.5, 3.0]).filter("shard <> grown_shard")
    assert moved.filter("grown_shard < 4").count() == 0 and moved.count() > 0


def test_vocabulary_of_generated_urls(spark):
    rng = random.Random(4)
    terms = [*url_filter.STRICT_TERMS, *url_filter.SOFT_TERMS]
    assert max(url_filter.SOFT_TERMS.values()) < url_filter.SOFT_LIMIT and len(terms) > 150
    words = terms + ["news", "article", "Essex", "é", "casinoo", "a1", "hotel", ""]
    urls = []
    for k in range(1500):
        some = [rng.choice(words if rng.random() < 0.5 else words[-8:]) for _ in range(rng.randint(1, 6))]
        joined = "".join(w + rng.choice(["-", "/", ".", "_", "", "é", "=", "1", "?"]) for w in some)
        urls.append((k, "http://h.net/" + (joined.upper() if k % 5 == 0 else joined)))
    made = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    verdicts = set()
    for k, url in urls:
        low = "".join(c.lower() if c in url_filter.UPPER else c for c in url)
        hits = {t for t in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}
        strict = hits & set(url_filter.STRICT_TERMS)
        weight = sum(url_filter.SOFT_TERMS[t] for t in hits - strict)
        blocked = bool(strict) or weight >= url_filter.SOFT_LIMIT
        got = made[k]
        assert (got["n_strict"], got["soft_weight"], got["terms"]) == (len(strict), weight, " ".join(sorted(hits))), url
        assert got["verdict"] == ("block" if blocked else "allow")
        verdicts.add((bool(strict), blocked, weight > 0))
    assert verdicts >= {(False, False, False), (False, False, True), (False, True, True), (True, True, False)}
