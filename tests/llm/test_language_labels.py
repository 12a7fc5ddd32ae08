"""More labels than a few dozen."""

import random

from newsgraph.llm import language_id


def test_seventy_languages(spark):
    rng, rows = random.Random(8), []
    names = [f"l{k:02d}" for k in range(70)]
    for name in names:
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(30)]
        rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(40)), name) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert len(made) == len(rows)
    assert sum(made[k] == name for k, _, name in rows) > 0.95 * len(rows)
