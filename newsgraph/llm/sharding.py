"""Rendezvous hashing over weighted shards.

Every shard draws a number for a record key, and the record goes to the shard
whose draw is best for its weight. A shard's draw for a key does not depend on
the other shards, so one more shard takes records only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.tables import ranked, salt_count

DRAW_DIGITS = 13  # hex digits of a draw: 52 bits, exact in a double


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that only the key and the shard decide."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{shard}")))
    number = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def _costs(key: Column, weights: Sequence[float], first: int = 0) -> list[Column]:
    """What each shard from ``first`` on costs a key, with its number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one per shard")
    numbered = enumerate(weights, first)
    return [F.struct((-F.ln(draw(key, k)) / F.lit(float(w))).alias("cost"), F.lit(k).alias("shard")) for k, w in numbered]


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a key: the least of ``-ln(draw) / weight``.

    A shard gets keys in proportion to its weight. Ties go to the lower shard.
    A null key counts as an empty one. Weights must be positive.
    """
    return F.array_min(F.array(*_costs(key, weights)))["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Every document with its size and shard.

    ``doc_id, text, size, shard, grown_shard``: size is the UTF-8 bytes of the
    text plus 16, and ``grown_shard`` is the shard under the weights ``grown``
    (one more shard of weight 1 unless given); ``with_slots`` adds slots. Where
    ``grown`` only adds shards, a key draws for those alone a second time. Other columns are dropped. A null text has no bytes and stays null;
    rows with the same key share a shard and get different slots; an empty table
    gives an empty one.
    """
    grown = [*weights, 1.0] if grown is None else grown
    key, size = F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    best = docs.select("doc_id", "text", size.alias("size"), F.array_min(F.array(*_costs(key, weights))).alias("best"))
    n = len(weights)
    if list(grown[:n]) == list(weights):
        after = F.array_min(F.array("best", *_costs(key, grown[n:], n)))["shard"] if grown[n:] else F.col("best.shard")
    else:
        after = rendezvous_shard(key, grown)
    return best.select("doc_id", "text", "size", F.col("best.shard").alias("shard"), after.alias("grown_shard"))


def with_slots(sharded: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``slot``: their number in their shard, gapless from 0."""
    columns = [F.col(c) for c in order]
    return ranked(sharded, "shard", columns, "slot", salt_count(sharded.sparkSession))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The records as Parquet, one folder per shard; tasks write several shards each."""
    sharded.write.partitionBy("shard").parquet(path)
