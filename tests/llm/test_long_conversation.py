"""Long conversations: every turn comes back, and the time follows the number of turns."""

import time

from pyspark.sql import functions as F

from newsgraph.llm import chat_format


def read_back(df):
    made = chat_format.format_conversations(df)
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    return made.select(chat_format.parse_turns(F.col("formatted")).alias("turns"), loss.alias("loss")).first()


def turns_of(spark, n, role):
    text = F.concat(F.lit("answer </s> \\ é𝄞 "), F.col("id").cast("string"))
    return spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))


def expected_texts(n):
    return [f"answer </s> \\ é𝄞 {k}" for k in range(n)]


def test_sixteen_thousand_turns(spark):
    n = 16_000
    changing = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    for role, trained in ((changing, slice(1, None, 2)), (F.lit("assistant"), slice(None))):
        df = turns_of(spark, n, role).persist()
        df.count()
        began = time.time()
        row = read_back(df)
        # A form that copies the runs at every turn takes about ten times as long.
        assert time.time() - began < 10
        assert [t["text"] for t in row["turns"]] == expected_texts(n)
        assert row["loss"] == "".join(expected_texts(n)[trained])
        df.unpersist()


def test_spans_over_blocks(spark):
    texts = ["", "x" * (chat_format.CUT - 1), "é\n" * chat_format.CUT, "[INST]", "", "𝄞" * (3 * chat_format.CUT + 1)]
    df = spark.createDataFrame([(1, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(texts)], "conv_id int, turn int, role string, text string")
    row = read_back(df)
    assert [t["text"] for t in row["turns"]] == texts
    assert row["loss"] == "".join(t for k, t in enumerate(texts) if k % 3)


def test_running_sums(spark):
    for values in ([], [5], [1, 0, 2], list(range(33))):
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        assert df.select(chat_format.running_sums(F.col("v"))).first()[0] == [sum(values[: k + 1]) for k in range(len(values))]
