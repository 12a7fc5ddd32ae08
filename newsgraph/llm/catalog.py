"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.llm import (
    alignment,
    chat_format,
    decontaminate,
    language_id,
    line_dedup,
    lm_score,
    near_dup,
    packing,
    quality_rules,
    sharding,
    token_files,
    turn_repair,
    url_filter,
)
from newsgraph.llm.tables import table
from newsgraph.session import Scratch, shared_folder, stored

# What the queries ask for.
SHARDS = 40
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"
REPAIR_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of the public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "soft_weight", "terms")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(EXTRA_CONVERSATION, 0, "user", EXTRA_TEXT), (EXTRA_CONVERSATION, 1, "assistant", EXTRA_TEXT)], rows.schema
    )
    made = chat_format.format_conversations(rows.unionByName(extra))
    turns = chat_format.parse_turns(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    digest = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = sharded.select("doc_id", "size", digest.alias("text_crc32"), "shard", "grown_shard")
    with Scratch(spark) as scratch:
        # Numbering reads the rows twice; the draws and texts are done with by then.
        narrow = scratch.store(rows, "sharded")
        numbered = sharding.with_slots(narrow, ["doc_id", "text_crc32"])
        law = F.lit("key").alias("law")
        return scratch.keep(numbered.select("doc_id", "size", "text_crc32", law, "shard", "slot", "grown_shard"), "slots")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    listed = stored(token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path()), "listed")
    scanned = stored(token_files.scan_blocks(token_files.token_blocks(spark, folder), folder), "scanned")
    counted = token_files.document_lengths(scanned)
    return listed.join(counted, ["file", "place"]).select("doc_id", "n_tokens", "file", "place", "start")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    with Scratch(spark) as scratch:
        made = turn_repair.repair_conversations(turn_repair.damage(rows), scratch)
        digests = turn_repair.turn_digests(made.turns).withColumnRenamed("digest", "repaired_sha256")
        # Conversations that lost all rows have no report, those that lost all turns no digest.
        parts = [rows.select("conv_id").distinct(), made.reports, digests]
        told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("conv_id")
        numbers = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in REPAIR_COUNTS]
        nothing = F.sha2(F.lit("").cast("binary"), 256)
        judged = told.agg(
            *numbers,
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), nothing).alias("repaired_sha256"),
        )
        return scratch.keep(judged, "repaired")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), scratch)
        told = kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
        return scratch.keep(told, "lines")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)
    with Scratch(spark) as scratch:
        return scratch.keep(alignment.align_documents(table(spark, sf_dir, "documents"), *paths, scratch), "alignment")


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_chat_format": op3_chat_format,
    "op4_decontamination": op4_decontamination,
    "op5_near_dup": op5_near_dup,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_score": op9_lm_score,
    "op10_token_counts": op10_token_counts,
    "op11_turn_repair": op11_turn_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_token_alignment": op13_token_alignment,
}
