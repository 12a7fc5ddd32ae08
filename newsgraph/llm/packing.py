"""Packing of token pieces into sequences: dominance reduction, then best fit.

What fits with what depends on lengths alone, and there are at most as many
lengths as a sequence has tokens. So the plan is made from the number of pieces
of each length: a table of at most ``capacity`` rows, whatever the size of the
corpus. Executors then number the pieces of a length and look their number up in
the plan.

The reduction is that of Martello and Toth. For a piece, a set of at most three
pieces that holds it and fits is fixed as a sequence when no other set with it
can be better: nothing else fits; one partner fills the sequence or is the only
that can be added; or the largest partner is at least any pair. What is fixed
leaves the instance, which is then reduced again. The rest is packed by best
fit, longest first.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.tables import ranked, salt_count
from newsgraph.llm.tokens import ID_BYTES, text_encoder
from newsgraph.session import stored

CAPACITY = 2048
END_ID = 0

Pattern = tuple[int, ...]  # lengths in a sequence


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids``: every document's ids, then ``end_id``, cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers. Only documents longer than
    the capacity have more than one piece. A null text is an empty one: its
    piece is the end id alone. Repeated rows give repeated pieces; other columns
    are not read; an empty table gives an empty one.
    """
    end = np.array([end_id], "<u4").tobytes()
    width = capacity * ID_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer, plain_specials=False)

        def batch_of(rows):
            names = ["doc_id", "piece", "start", "length", "ids"]
            kinds = [doc_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            doc_type, rows, held = batch.schema.field("doc_id").type, [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append((doc, at // width, at // ID_BYTES, len(part) // ID_BYTES, part))
                    held += len(part)
                if held > 8_000_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _dominating(counts: list[int], present: list[int], length: int, capacity: int) -> Pattern | None:
    """The partners of ``length`` in a set that dominates all others with it, or None.

    ``present`` lists the lengths there are, ascending; ``counts`` how many of
    each, the piece itself taken out.
    """
    room = capacity - length
    smallest, k = [], 0
    for x in present:
        take = min(counts[x], 3 - len(smallest))
        smallest += [x] * take
        if len(smallest) == 3 or x > room:
            break
    while k < len(smallest) and sum(smallest[: k + 1]) <= room:
        k += 1
    if k == 0:
        return ()
    at = bisect_right(present, room) - 1
    while at >= 0 and not counts[present[at]]:
        at -= 1
    largest = present[at]
    if k == 1 or largest == room:
        return (largest,)
    if k > 2:
        return None
    best, low, high = 0, 0, at
    while low <= high:  # the best pair that fits, by two ends moving inwards
        a, b = present[low], present[high]
        if a + b > room:
            high -= 1
        elif counts[a] and counts[b] and (a != b or counts[a] > 1):
            best, low = max(best, a + b), low + 1
        elif a == b or not counts[a]:
            low += 1
        else:
            high -= 1
    return (largest,) if largest >= best else None


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """Sequences that some best packing has, and the pieces of the others.

    Sets are fixed many at a time while at least three pieces of each length in
    them are left, as the conditions look at no more than three of a length.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    fixed: Counter = Counter()
    changed = True
    while changed:
        changed = False
        present = [x for x in range(1, capacity + 1) if counts[x]]
        for length in reversed(present):
            while counts[length]:
                counts[length] -= 1
                partners = _dominating(counts, present, length, capacity)
                counts[length] += 1
                if partners is None:
                    break
                need = Counter((length, *partners))
                least = min(counts[x] // m for x, m in need.items())
                # () holds while nothing that is left fits; the others while three of each are left.
                times = least if not partners else max(1, least - 3)
                fixed[tuple(sorted((length, *partners), reverse=True))] += times
                for x, m in need.items():
                    counts[x] -= m * times
                changed = True
    return fixed, {x: n for x, n in enumerate(counts) if n}


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Sequences of the pieces, longest first, each into the fullest sequence with room.

    Open sequences with the same room are handled together: a piece goes to the
    least room that holds it, and the next of its length to the same sequence
    while it fits. So a length adds at most two kinds of sequences.
    """
    open_by_room: dict[int, list[list]] = {capacity: []}
    rooms: list[int] = []  # of open sequences, ascending

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_by_room or not open_by_room[room]:
            open_by_room[room] = []
            if room not in rooms:
                rooms.insert(bisect_right(rooms, room), room)
        open_by_room[room].append([pattern, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):  # new sequences
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            group = open_by_room[room]
            pattern, n = group.pop()
            each = room // length
            whole = min(n, left // each)
            if whole:
                put(room - each * length, pattern + (length,) * each, whole)
                left -= whole * each
                n -= whole
            if n and left and left < each:
                put(room - left * length, pattern + (length,) * left, 1)
                left, n = 0, n - 1
            if n:
                group.append([pattern, n])
            if not open_by_room[room]:
                rooms.remove(room)
    made: Counter = Counter()
    for group in open_by_room.values():
        for pattern, n in group:
            made[pattern] += n
    return made


def packing_plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their number within the length.

    One entry for a length and a kind of sequence: pieces from number ``first``
    on fill sequences from ``sequence`` on, ``each`` to a sequence, from
    ``offset`` in it. Sorted by length and first number.
    """
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed, rest = reduce_instance(histogram, capacity)
    kinds = fixed + best_fit(rest, capacity)
    used: Counter = Counter()
    entries, sequence = [], 0
    for pattern, n in sorted(kinds.items(), reverse=True):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            entries.append((length, used[length], sequence, each, offset))
            used[length] += each * n
            offset += each * length
        sequence += n
    columns = np.array(sorted(entries), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), columns))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: their place in a sequence.

    ``pieces`` has ``doc_id, piece, length`` and any columns but ``number``,
    ``sequence_id`` and ``offset``; it is read twice, so it should be stored.
    Sequences hold at most ``capacity`` tokens, without gaps. Lengths must be
    from 1 to the capacity. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most capacity lengths, a few kinds of sequences each: bounded for any corpus.
    plan = spark.sparkContext.broadcast(packing_plan(histogram, capacity))
    order = [F.col(c) for c in pieces.columns if c in ("doc_id", "piece", "ids_crc32")]
    numbered = ranked(pieces, "length", order, "number", salt_count(spark))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        span = np.int64(1 << 40)
        keys = p["length"] * span + p["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * span + number, "right") - 1
            within = number - p["first"][at]
            sequence = p["sequence"][at] + within // p["each"][at]
            offset = p["offset"][at] + within % p["each"][at] * length
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Documents as pieces in sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    With ``keep_ids`` the ids of each piece come too, as ``ids``. Pieces are
    written to the shared folder once, as both their counts and their places are
    needed.
    """
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack_pieces(stored(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)
