"""Repairing the structure of conversations: faults of rows, cheapest edits, repaired turns.

Rows are dealt out by ranges of conversation and turn, so the rows of one very
long conversation lie in many tasks, and numbered in that order. Faults are
column expressions and one aggregate. Only one character per row goes to the task
that solves a conversation (``auction.py``); the edits come back to the rows by
their numbers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.auction import BLANK, CUT, DUPLICATE, OK, ROLES, cheapest_edits, fault_of, role_of
from newsgraph.llm.tables import salt_count
from newsgraph.session import Scratch

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
# Text beyond this many characters does not decide the range a row is dealt to.
HEAD = 32
PART_BITS = 33
LEGAL = {"su", "ua", "au"}
ROLE = {"u": "user", "a": "assistant"}
SIGNS = "".join(chr(ord("A") + k) for k in range(16))
SOLVED = (
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "edits array<struct<first: long, codes: string>>"
)


@dataclass
class Repair:
    """``reports`` has a row per conversation, ``turns`` the repaired turns in the order of ``row, part``."""

    reports: DataFrame
    turns: DataFrame


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the damage that a hash of conversation and turn draws for them.

    Null roles, texts and parts of the hashed key count as one space. Of 20 draws
    0 drops a row, 1 empties its text, 2 removes stops, 3 repeats it, 4 makes it a
    user's.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    drawn = rows.select(
        "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
        (F.crc32(F.encode(key, "UTF-8")) % 20).alias("draw"),
    )
    draw = F.col("draw")
    emptied = F.when(draw == 1, "").when(draw == 2, F.regexp_replace("text", f"[{STOPS}]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1))
    return drawn.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"), emptied.alias("text"), F.explode(copies)
    ).drop("col")


def place_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, role, text, row``: numbered by turn (nulls first), then role and text.

    Rows that agree in all of these may be swapped. The numbers of a
    conversation's rows are consecutive within a partition and rise over them.
    """
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    plain = rows.select("conv_id", "turn", spaced("role"), spaced("text"))
    keyed = plain.withColumn("head", F.substring("text", 1, HEAD))
    dealt = keyed.repartitionByRange(salt_count(rows.sparkSession), "conv_id", "turn", "role", "head")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").drop("head")
    return scratch.store(ordered.withColumn("row", F.monotonically_increasing_id()), "placed")


def signs(placed: DataFrame) -> DataFrame:
    """``conv_id, row, sign``: role initial and first fault of every row as one character."""
    bare = F.btrim("text", F.lit(SPACES))
    told = placed.select(
        "conv_id", "row", F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*STOPS)).alias("cut"),
    )
    text = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    said = placed.select("conv_id", "role", *text, "row").groupBy("conv_id", "role", "t1", "t2")
    # The first rows meet their own numbers again: no key of this join can be hot.
    firsts = said.agg(F.min("row").alias("row")).select("row", F.lit(True).alias("is_first"))
    joined = told.join(firsts, "row", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(OK)
    role = reduce(lambda made, k: made.when(F.col("initial") == ROLES[k], k), range(3), F).otherwise(3)
    return joined.select("conv_id", "row", F.substring(F.lit(SIGNS), 1 + 4 * fault + role, F.lit(1)).alias("sign"))


def _codes(edits: list[tuple[str, str]]) -> list[str]:
    """Per row: inserted roles before it, what becomes of it (K, D, new role), and behind the last row what follows."""
    made, held = [], ""
    for letter, role in edits:
        if letter == "I":
            held += role
        else:
            made.append(held + (role.upper() if letter == "R" else letter))
            held = ""
    made[-1] += held
    return made


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = []
        for segments in batch.column("segments").to_pylist():
            rows = "".join(s["signs"] for s in segments)
            initials = "".join(map(role_of, rows))
            faults = Counter(map(fault_of, rows))
            cost, edits = cheapest_edits(rows)
            codes, done, parts = _codes(edits), 0, []
            for s in segments:
                parts.append({"first": s["first"], "codes": " ".join(codes[done : done + len(s["signs"])])})
                done += len(s["signs"])
            told.append(
                {
                    "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[CUT],
                    "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    "cost": cost, "audit": "".join(e[0] for e in edits), "edits": parts,
                }
            )
        numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
        parts = pa.list_(pa.struct([("first", pa.int64()), ("codes", pa.string())]))
        schema = pa.schema([*[(c, pa.int64()) for c in numbers], ("audit", pa.string()), ("edits", parts)])
        made = pa.RecordBatch.from_pylist(told, schema=schema)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made.columns], names=["conv_id", *schema.names])


def solve(signed: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and coded edits of every conversation with rows."""
    conv_type = signed.schema["conv_id"].dataType.simpleString()
    listed = F.sort_array(F.collect_list(F.struct("row", "sign")))
    part = F.shiftright("row", PART_BITS).alias("part")
    segments = signed.groupBy("conv_id", part).agg(
        F.min("row").alias("first"), F.array_join(F.transform(listed, lambda x: x["sign"]), "").alias("signs")
    )
    whole = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "signs"))).alias("segments"))
    return whole.mapInArrow(_solve, f"conv_id {conv_type}, {SOLVED}")


def repaired_turns(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv_id, row, part, role, text`` of the turns that stay or were inserted."""
    parts = solved.select(F.explode("edits").alias("e"))
    coded = parts.select("e.first", F.posexplode(F.split("e.codes", " ")).alias("at", "code"))
    codes = coded.select((F.col("first") + F.col("at")).alias("row"), "code")
    letters = placed.select("conv_id", "row", "role", "text").join(codes, "row")
    told = letters.select("conv_id", "row", "role", "text", F.posexplode(F.split("code", "")).alias("part", "letter"))
    stays = told.filter(F.col("letter").isin("K", *"UAua"))
    lower = F.lower("letter")
    role = F.when(lower == "u", ROLE["u"]).when(lower == "a", ROLE["a"]).otherwise(F.col("role"))
    text = F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("text"))
    return stays.select("conv_id", "row", "part", role.alias("role"), text.alias("text"))


def gaps(placed: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turns missing between a conversation's first and last one."""
    turns = placed.select("conv_id", "turn").distinct().groupBy("conv_id")
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def repair_conversations(rows: DataFrame, scratch: Scratch) -> Repair:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    ``rows`` has ``conv_id, turn, role, text``; others are ignored. Reports have
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    Keeping a row costs 0, giving it another role 3, deleting it 4 (a must for
    blank rows and for ones whose role and text came before), inserting a turn
    with an empty text 3, and a truncated row that stays 3 more. ``audit`` has the
    edits' initials, of equal costs the ASCII-least.

    Null roles and texts count as one space. Rows without conv_id are one
    conversation; null turns come first; rows of one turn go by role and text.
    Repeated rows are duplicates. An empty table gives empty results. A
    conversation's signs and edits, some characters a row, are one row of the
    reports and must fit a task; its texts need not.
    """
    placed = place_rows(rows, scratch)
    solved = scratch.store(solve(signs(placed)), "solved")
    told = solved.drop("edits").unionByName(gaps(placed), allowMissingColumns=True)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    reports = told.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])
    return Repair(reports, repaired_turns(placed, solved))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined lines of each run of equal conv_id, over batches."""
    current, digest = None, None
    for batch in batches:
        ids, told = [], []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv_id, role, text in zip(*columns):
            if digest is None or conv_id != current:
                if digest is not None:
                    ids.append(current)
                    told.append(digest.hexdigest())
                current, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(told, pa.string())], names=["conv_id", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], names=["conv_id", "digest"])


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, digest``: SHA-256 of the lines ``role:text`` of every conversation with turns.

    A conversation's lines pass through one task in their order, batch by batch.
    """
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition(salt_count(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "row", "part")
    return ordered.select("conv_id", "role", "text").mapInArrow(_digests, f"conv_id {conv_type}, digest string")
