"""Exact nearest companies that leave out what the triangle inequality rules out.

Every vector lies near one of a few pivots, at a stored angle; vectors of a pivot
in one shell of angles are a block. The angle of a vector to anything in a block
is at least the difference of its angle to the block's pivot and the shell. A
first round meets the blocks around each vector's own pivot and so finds a k-th
best that holds for sure; a second one meets only the blocks that may still hold
something as near. Blocks travel in bundles: a vector goes once to each bundle
that has a block it needs, and only what can be among its best comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.constants import STORED_NEIGHBORS
from newsgraph.operators.neighbors import BLOCK_ROWS, SLACK, TIE_DECIMALS, _ranked, _unit, tile_rows
from newsgraph.session import Scratch

# Bounds of what the driver and every task hold: pivots, the vectors they are picked from, shells of a pivot.
MOST_PIVOTS, SAMPLE, SHELLS = 256, 2048, 32
# Blocks there should be for each block's worth of vectors.
FINER = 4
# Bundles there should be, and the most blocks' worth of vectors in one.
BUNDLES, MOST_BUNDLED = 8, 4
# Vectors whose needs are worked out at a time, and lists of the best that a task holds before it merges them.
NEED_ROWS, HELD_LISTS = 1024, 4


@dataclass
class Pruned:
    """The nearest companies, and of all pairs how many were multiplied."""

    nearest: DataFrame
    pairs_met: int
    pairs: int


@dataclass
class Blocks:
    """Per block its pivot, bounds of angles and size; a pivot of -1 holds vectors of length 0."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit vectors of a sample, each as far as can be from those before it."""
    unit = _unit(sample)
    unit = unit[np.linalg.norm(unit, axis=1) > 0]
    picked, nearest = [], np.full(len(unit), -2.0)
    for _ in range(min(n, len(unit))):
        k = int(nearest.argmin())
        if nearest[k] > 1 - 1e-12:
            break
        picked.append(k)
        nearest = np.maximum(nearest, unit @ unit[k])
    return unit[picked]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _place(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, unit, pivot, shell, angle`` of every vector."""
    kind = vectors.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, -1))
            pivot, angle = np.full(len(unit), -1), np.zeros(len(unit))
            real = np.linalg.norm(unit, axis=1) > 0
            if len(pivots) and real.any():
                angles = _angles(unit[real], pivots)
                pivot[real], angle[real] = angles.argmin(axis=1), angles.min(axis=1)
            shell = np.minimum((angle * SHELLS * 2 / np.pi).astype(int), SHELLS - 1)
            columns = [batch.column("id"), pa.array(list(unit), pa.list_(pa.float64()))]
            columns += [pa.array(pivot, pa.int32()), pa.array(shell, pa.int32()), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "unit", "pivot", "shell", "angle"])

    return vectors.select("id", "features").mapInArrow(place, f"id {kind}, unit array<double>, pivot int, shell int, angle double")


def _summed(placed: DataFrame, block_rows: int) -> tuple[Blocks, dict[tuple[int, int], int]]:
    """Blocks, and the block of each pivot and shell: shells are joined to blocks of up to ``block_rows``."""
    told = placed.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    rows = sorted(tuple(r) for r in told.collect())  # one per pivot and shell
    made, number = [], {}
    for pivot, shell, n, low, high in rows:
        last = made[-1] if made else None
        if last and last[0] == pivot and last[3] + n <= block_rows:
            made[-1] = (pivot, last[1], high, last[3] + n)
        else:
            made.append((pivot, low, high, n))
        number[pivot, shell] = len(made) - 1
    columns = zip(*made) if made else ([], [], [], [])
    return Blocks(*[np.array(c) for c in columns]), number


def _bundled(size: np.ndarray, part_rows: int) -> np.ndarray:
    """The bundle of each block: blocks in a row of up to ``part_rows`` vectors, a larger block alone."""
    number, held, made = -1, part_rows, []
    for n in size:
        if held + n > part_rows:
            number, held = number + 1, 0
        held += n
        made.append(number)
    return np.array(made, int)


def _homes(blocks: Blocks, pivots: np.ndarray, k: int) -> list[np.ndarray]:
    """Per pivot (the last one is that of no length) the blocks of the first round: its own, and near ones until k others are there."""
    angle = _angles(pivots, pivots) if len(pivots) else np.zeros((0, 0))
    homes = []
    for p in [*range(len(pivots)), -1]:
        order = angle[p].argsort(kind="stable") if p >= 0 else np.arange(-1, len(pivots))
        held, taken = 0, []
        for q in order:
            own = np.flatnonzero(blocks.pivot == q)
            taken.append(own)
            held += int(blocks.size[own].sum())
            if held > k:
                break
        homes.append(np.concatenate(taken) if taken else np.zeros(0, int))
    return homes


def _rows_best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """Every row's best ``k`` of ``y`` but itself; equal scores go to the smaller id. ``others`` is sorted."""
    width, found = len(others), []
    at = np.minimum(np.searchsorted(others, ids), width - 1)
    own = others[at] == ids
    step = tile_rows(width)
    for i in range(0, len(x), step):
        scores = x[i : i + step] @ y.T
        keys = np.rint(scores * 10**TIE_DECIMALS).astype("int64") * width + np.arange(width - 1, -1, -1)
        rows = np.flatnonzero(own[i : i + step])
        keys[rows, at[i : i + step][rows]] = np.iinfo("int64").min
        keep = min(k, width)
        to = np.argpartition(keys, width - keep, axis=1)[:, width - keep :]
        row = np.repeat(np.arange(i, i + len(scores)), keep)
        told = pd.DataFrame({"row": row, "company": ids[row], "neighbor": others[to.ravel()]})
        told["confidence"] = np.take_along_axis(scores, to, axis=1).ravel()
        found.append(told[np.take_along_axis(keys, to, axis=1).ravel() > np.iinfo("int64").min])
    return pd.concat(found)


def _merged(found: list[pd.DataFrame], k: int) -> list[pd.DataFrame]:
    """Every row's best ``k`` of several lists."""
    every = pd.concat(found)
    every = every.assign(score=np.rint(every["confidence"] * 10**TIE_DECIMALS))
    every = every.sort_values(["row", "score", "neighbor"], ascending=[True, False, True])
    return [every.groupby("row").head(k).drop(columns="score")]


def _meet(
    needs: DataFrame, placed: DataFrame, size: np.ndarray, bundle: np.ndarray, choose, k: int, part_rows: int
) -> tuple[DataFrame, int]:
    """Every vector's best ``k`` in the blocks it needs, and how many pairs that are.

    ``needs`` is that of `_needed`, stored; ``size`` and ``bundle`` are those of
    the blocks. Both sides of a bundle are cut into parts of bounded size by their
    ids, and each pair of parts is a task's, which chooses the blocks again. What
    a vector's ``least`` rules out does not leave the task.
    """
    spark = needs.sparkSession
    kind = needs.schema["id"].dataType.simpleString()
    pairs = needs.agg(F.sum("met").alias("met")).first()["met"] or 0
    asked = needs.select(F.explode("bundles").alias("bundle")).groupBy("bundle").count().collect()  # one per bundle
    of = lambda b: int(size[bundle == b].sum())
    cuts = [(b, -(-n // part_rows), -(-of(b) // part_rows)) for b, n in sorted(tuple(r) for r in asked)]
    parts = F.broadcast(spark.createDataFrame(cuts, "bundle int, x_parts int, y_parts int"))
    dealt = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    told = needs.select(F.explode("bundles").alias("bundle"), "id", "unit", "pivot", "least").join(parts, "bundle")
    left = told.select("bundle", dealt("x_parts").alias("xp"), every("y_parts").alias("yp"), "id", "unit", "pivot", "least")
    right = placed.join(parts, "bundle").select("bundle", every("x_parts").alias("xp"), dealt("y_parts").alias("yp"), "id", "unit", "block")

    def multiply(_, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"company": [], "neighbor": [], "confidence": []}, dtype=object)
        if one.empty or two.empty:
            return none
        dtype = object if kind == "string" else None
        unit, ids, least = np.stack(one["unit"].to_numpy()), np.asarray(one["id"], dtype), one["least"].to_numpy(float)
        blocks = np.unique(two["block"])
        wanted = choose(one["pivot"].to_numpy(), unit, least, blocks)
        found = []
        for column, block in enumerate(blocks):
            rows = np.flatnonzero(wanted[:, column])
            if not len(rows):
                continue
            own = two[two["block"] == block].sort_values("id")
            best = _rows_best(unit[rows], ids[rows], np.stack(own["unit"].to_numpy()), np.asarray(own["id"], dtype), k)
            best["row"] = rows[best["row"]]
            found.append(best[~(best["confidence"].to_numpy(float) < least[best["row"]] - SLACK)])
            if sum(map(len, found)) > HELD_LISTS * k * len(one):
                found = _merged(found, k)
        return _merged(found, k)[0][["company", "neighbor", "confidence"]] if found else none

    key = ["bundle", "xp", "yp"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(multiply, f"company {kind}, neighbor {kind}, confidence double")
    return met, pairs


def _needed(rows: DataFrame, choose, size: np.ndarray, bundle: np.ndarray) -> DataFrame:
    """``id, unit, pivot, least, bundles, met``: one row per vector.

    ``choose(pivot, unit, least, blocks)`` tells which of the blocks each row
    needs; ``bundles`` are those that have one, ``met`` the vectors in the blocks.
    """
    kind = rows.schema["id"].dataType.simpleString()
    first = np.flatnonzero(np.diff(bundle, prepend=-1))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, NEED_ROWS):
                batch = whole.slice(at, NEED_ROWS)
                unit = np.array(batch.column("unit").to_pylist(), float).reshape(batch.num_rows, -1)
                pivot, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "least"))
                wanted = choose(pivot, unit, least.astype(float), np.arange(len(size)))
                some = np.logical_or.reduceat(wanted, first, axis=1)
                ends = np.concatenate([[0], some.sum(axis=1).cumsum()])
                bundles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(some)[1], pa.int32()))
                columns = [batch.column(c) for c in ("id", "unit", "pivot", "least")]
                columns += [bundles, pa.array(wanted @ size.astype("int64"))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "unit", "pivot", "least", "bundles", "met"])

    made = f"id {kind}, unit array<double>, pivot int, least double, bundles array<int>, met long"
    return rows.select("id", "unit", "pivot", "least").mapInArrow(need, made)


def pruned_topk(vectors: DataFrame, k: int = STORED_NEIGHBORS, block_rows: int = BLOCK_ROWS, finer: int = FINER) -> Pruned:
    """`connections_topk` by meeting only the blocks that can matter.

    The same rows as there, ties included. Pivots, at most MOST_PIVOTS, and the
    bounds of their at most SHELLS shells are what the driver and all tasks hold,
    whatever the vectors. Vectors without direction are one block of their own,
    and meet all others. Where nothing can be ruled out every pair is met, as
    there. ``vectors`` is read more than once and should be a stored table.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        total = vectors.count()
        wanted = int(np.clip(finer * -(-total // block_rows), 1, MOST_PIVOTS))
        sampled = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("features").collect()
        sample = np.array([r["features"] for r in sampled], float)
        pivots = pick_pivots(sample, wanted) if len(sample) else np.zeros((0, 1))
        stood = scratch.store(_place(vectors, pivots), "placed")
        blocks, number = _summed(stood, block_rows)
        part_rows = int(np.clip(-(-total // BUNDLES), block_rows, MOST_BUNDLED * block_rows))
        size, bundle = blocks.size, _bundled(blocks.size, part_rows)
        rows = [(*key, b, int(bundle[b])) for key, b in sorted(number.items())]
        cells = spark.createDataFrame(rows, "pivot int, shell int, block int, bundle int")
        placed = stood.join(F.broadcast(cells), ["pivot", "shell"])
        homes = _homes(blocks, pivots, k) if total else []
        # Per pivot, that of no length last, whether a block is one of its homes.
        home = np.zeros((len(homes), len(size)), bool)
        for p, own in enumerate(homes):
            home[p, own] = True
        bounds = spark.sparkContext.broadcast((pivots, blocks.pivot, blocks.low, blocks.high, home))

        def at_home(pivot: np.ndarray, unit: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
            return bounds.value[-1][:, at][pivot]

        def may_hold(pivot: np.ndarray, unit: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
            pivots, of, low, high, home = bounds.value
            of, low, high = of[at], low[at], high[at]
            most = np.zeros((len(unit), len(of)))
            real = of >= 0
            if real.any():
                near, place = np.unique(of[real], return_inverse=True)
                angle = _angles(unit, pivots[near])[:, place]
                apart = np.maximum(np.maximum(angle - high[real], low[real] - angle), 0.0)
                most[:, real] = np.where((pivot >= 0)[:, None], np.cos(np.minimum(apart, np.pi)), 0.0)
            return ~(most < np.nan_to_num(least, nan=-2.0)[:, None] - SLACK) & ~home[:, at][pivot]

        def met(rows: DataFrame, choose, name: str) -> tuple[DataFrame, int]:
            needs = scratch.store(_needed(rows, choose, size, bundle), name)
            return _meet(needs, placed, size, bundle, choose, k, part_rows)

        best, pairs_first = met(stood.withColumn("least", F.lit(None).cast("double")), at_home, "first")
        near = scratch.store(_ranked(best, k), "near")
        # The k-th best so far, for those that have k.
        kth = near.filter(F.col("rank") == k - 1).select(F.col("company").alias("id"), F.col("confidence").alias("least"))
        late, pairs_second = met(stood.join(kth, "id", "left"), may_hold, "second")
        every = near.select("company", "neighbor", "confidence").unionByName(late)
        nearest = scratch.keep(_ranked(every, k), "nearest")
    return Pruned(nearest, pairs_first + pairs_second, total * total)
