"""Near-duplicate documents by circulant MinHash, bands and exact verification.

Two permutations make the whole signature: the first scatters shingles over the
places of a circle, the second ranks the places, and coordinate k is the least
rank after turning the circle by k. A shingle so reads one run of neighbouring
ranks instead of drawing a hash per coordinate.

Documents with equal shingle sets are one class, and only classes are compared.
Classes that agree in a band are candidates. First neighbours in the order of a
bucket are verified, which is linear in its size and joins groups of copies.
Then classes of a bucket that are still in different components are compared:
pair by pair, or block by block where one of the components is large or the bucket
holds many classes. Links are confirmed on full shingle sets, fetched for
candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.components import components
from newsgraph.llm.words import Words, find_words, mix, raw_text, shingles, slices, worker_cache
from newsgraph.session import stored

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 5
COORDINATES = 256
CIRCLE = 1 << 20
# Coordinates of two documents at the threshold agree in their lowest bit about
# 0.875 of the time; five standard deviations below that a pair is dismissed.
LEAST_BITS = COORDINATES * 0.875 - 5 * (COORDINATES * 0.875 * 0.125) ** 0.5
# Components with more classes are met in blocks of BLOCK, smaller ones pair by pair.
LARGE, BLOCK, BLOCK_SHINGLES = 32, 256, 4_000_000
# Classes of a bucket that are ordered together, and classes in small components that meet pair by pair.
RUN, CROWD = 50_000, 512
BITS = [f"bits{k}" for k in range(COORDINATES // 64)]


def shingle_sets(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words than ``size`` is one shingle, its whole sequence; one
    without words has an empty set.
    """
    hashed, text_of, _ = shingles(words, size)
    bounds = np.searchsorted(text_of, np.arange(len(words.first)))
    counts = words.counts()
    sets = []
    for k, n in enumerate(counts):
        if n >= size:
            sets.append(np.unique(hashed[bounds[k] : bounds[k + 1]]))
        elif n:
            whole = np.array([int(n) * 0x632BE59BD9B4E019 & (1 << 64) - 1], np.uint64)
            for w in range(words.first[k], words.first[k + 1]):
                whole = mix(whole) + words.hashes[w : w + 1]
            sets.append(mix(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    a, b = mix(s ^ np.uint64(0xA0761D6478BD642F)), mix(s ^ np.uint64(0xE7037ED1A0B428DB))
    ends = np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) + np.uint64(len(s))])
    return mix(ends).tobytes()


def _ranks() -> np.ndarray:
    """The second permutation, with the circle's begin again at its end; row p is the run from place p."""
    cache = worker_cache()
    if "ranks" not in cache:
        line = np.random.Generator(np.random.PCG64(20240229)).permutation(CIRCLE).astype(np.int32)
        line = np.concatenate([line, line[: COORDINATES - 1]])
        cache["ranks"] = np.lib.stride_tricks.sliding_window_view(line, COORDINATES)
    return cache["ranks"]


def signature(s: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a non-empty set: COORDINATES least ranks."""
    places = (mix(s ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(64 - 20)).astype(np.int64)
    ranks, least = _ranks(), None
    for at in range(0, len(places), 2048):
        part = ranks[places[at : at + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of each signature."""
    cut = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, node, bands, bits0..bits3`` of every document.

    ``node`` names the class of equal sets; it is null for an empty set.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(find_words(*raw_text(batch.column("text")), lower=True))
            full = [k for k, s in enumerate(sets) if len(s)]
            made = np.array([signature(sets[k]) for k in full], np.int32).reshape(-1, COORDINATES)
            keys = np.zeros((len(sets), BANDS), np.int64)
            keys[full] = band_keys(made)
            bits = np.zeros((len(sets), len(BITS)), np.int64)
            bits[full] = np.packbits((made & 1).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel())),
                    *(pa.array(bits[:, k]) for k in range(len(BITS))),
                ],
                names=["doc_id", "text_hash", "n", "node", "bands", *BITS],
            )

    kind = dict(docs.dtypes)["doc_id"]
    fields = f"doc_id {kind}, text_hash long, n long, node binary, bands array<long>, " + ", ".join(f"{b} long" for b in BITS)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sketch, fields)


def may_link(a, b) -> Column:
    """Sizes allow the similarity, and enough signature bits agree. ``a``, ``b`` give columns by name."""
    differ = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in BITS), F.lit(0))
    sizes = F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * PERCENT
    return sizes & (differ <= int(COORDINATES - LEAST_BITS))


def class_sets(asked: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, hashes``: the full sets of the classes ``asked`` for, made again from one text of each."""
    ids = classes.join(asked, "node", "left_semi").select(F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    texts = docs.select("doc_id", "text").join(ids, same, "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [s for s in shingle_sets(find_words(*raw_text(batch.column("text")), lower=True)) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "hashes"],
            )

    sets = texts.mapInArrow(sets_of, "node binary, hashes binary").join(asked, "node", "left_semi")
    return stored(sets.dropDuplicates(["node"]), "sets")


def _sets_in(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]


def linked_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough; a pair travels with its two sets."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = class_sets(asked, classes, docs)
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(_sets_in(batch.column("left")), _sets_in(batch.column("right"))):
                s, t = (s, t) if len(s) < len(t) else (t, s)
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(100 * common >= PERCENT * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(confirm, "a binary, b binary")


def linked_to_groups(visits: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` from each visitor to the components of a group that hold a similar class.

    ``visits`` and ``members`` are ``node, n, own, root``: a class, the size of its
    set, its component so far, and a group. Of each other component a block holds,
    one link is told. Visitors and members of a group are dealt into blocks of
    bounded numbers of classes and shingles, and blocks are compared with each
    other: a set travels once per block of the other side, no pairs are emitted,
    and no task holds a whole group.
    """
    nodes = visits.select("node").union(members.select("node")).distinct()
    sets = class_sets(nodes, classes, docs)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
        return df.groupBy("root").agg(many.alias(name))

    counted = blocks(visits, "of_visits").join(blocks(members, "of_members"), "root")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    held = members.join(counted, "root").select("root", "node", "own", part("of_members").alias("m"), all_of("of_visits").alias("v"))
    come = visits.join(counted, "root").select("root", "node", "own", all_of("of_members").alias("m"), part("of_visits").alias("v"))

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and two.num_rows:
            own = _sets_in(two.column("hashes"))
            sizes = np.array([len(s) for s in own])
            hashes = np.concatenate(own)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], np.repeat(np.arange(len(own)), sizes)[order]
            names, owns = two.column("node").to_pylist(), two.column("own").to_pylist()
            visitors = zip(one.column("node").to_pylist(), one.column("own").to_pylist(), _sets_in(one.column("hashes")))
            for name, mine, s in visitors:
                begin, end = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
                times = end - begin
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
                common = np.bincount(owner[at], minlength=len(own))
                hits = np.flatnonzero(100 * common >= PERCENT * (len(s) + sizes - common))
                # One of each component but the visitor's own.
                found += [(name, names[k]) for k in {owns[k]: k for k in hits if owns[k] != mine}.values()]
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    key = ["root", "m", "v"]
    fresh = lambda df: df.join(sets, "node").select(*[F.col(c).alias(c) for c in ("node", "own", "hashes", *key)])
    return fresh(come).groupBy(*key).cogroup(fresh(held).groupBy(*key)).applyInArrow(compare, "a binary, b binary")


def judged_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept, stays`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable over links of at least 75
    percent similarity of distinct five-word shingles, ``kept`` whether it is the
    row's own. Texts without words, null among them, have no links. Repeated
    rows are copies of each other, with one doc_id all kept; a null doc_id is
    never the smallest. ``stays`` is true for one text of each component, and for
    texts without words. Other columns are not read; an empty table gives an empty
    one. A pair exactly at the threshold is missed with a chance of about 2e-5.
    """
    made = stored(sketches(docs), "sketches")
    full = made.filter("node IS NOT NULL")
    first = F.first
    # The row that stands for a class; any row with an id comes before those without.
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    classes = full.groupBy("node").agg(F.min(row).alias("least"))
    attributes = full.groupBy("node").agg(first("n").alias("n"), *[first(b).alias(b) for b in BITS])
    # One row per class and band; buckets of one class end here.
    one = full.groupBy("node").agg(first("bands").alias("bands"))
    rows = one.select("node", F.explode("bands").alias("band"))
    ends = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = rows.join(ends.filter("low != high").select("band"), "band", "left_semi")
    members = stored(shared.distinct().join(attributes, "node"), "members")

    # A bucket's order is cut into runs by a hash where it is long; neighbours that
    # this parts are met later.
    crowds = members.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > RUN)
    run = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / RUN)), F.lit(0))
    line = Window.partitionBy("band", "run").orderBy("n", *BITS, "node")
    runs = members.join(crowds, "band", "left").withColumn("run", run)
    ahead = runs.select("*", F.lag(F.struct("node", "n", *BITS)).over(line).alias("p"))
    near = ahead.filter("p IS NOT NULL").filter(may_link(F.col, lambda c: F.col("p")[c]))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = stored(near.select(*pair(F.col("node"), F.col("p.node"))).distinct(), "pairs")
    links = stored(linked_pairs(tried, classes, docs), "linked")

    roots = components(links)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sizes, "root", "left")
    placed = placed.withColumn("size", F.coalesce("size", F.lit(1)))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    apart = stored(placed.join(mixed.select("band"), "band", "left_semi"), "apart")
    few = apart.filter(F.col("size") <= LARGE)
    # Buckets of many classes in small components are met in blocks, others pair by pair.
    crowded = few.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > CROWD).select("band")
    calm = few.join(crowded, "band", "left_anti")
    x, y = calm.alias("x"), calm.alias("y")
    side = lambda s: lambda c: F.col(f"{s}.{c}")
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & may_link(side("x"), side("y"))
    others = x.join(y, meet).select(*pair(F.col("x.node"), F.col("y.node"))).distinct()
    others = stored(others.join(tried, ["a", "b"], "left_anti"), "pairs")
    group = ["node", "n", F.col("root").alias("own"), F.col("band").alias("root")]
    packed = stored(few.join(crowded, "band", "left_semi").select(*group), "crowded")
    large = apart.filter(F.col("size") > LARGE).select("band", F.col("root").alias("group"), F.col("size").alias("of")).distinct()
    smaller = (F.col("size") < F.col("of")) | ((F.col("size") == F.col("of")) & (F.col("root") < F.col("group")))
    visits = apart.join(large, "band").filter(smaller).select("node", "n", F.col("root").alias("own"), F.col("group").alias("root"))
    visits = stored(visits.distinct(), "visits")
    visited = roots.join(visits.select("root").distinct(), "root", "left_semi").join(attributes.select("node", "n"), "node")
    visited = stored(visited.select("node", "n", F.col("root").alias("own"), "root"), "visited")
    more = linked_pairs(others, classes, docs).union(linked_to_groups(visits, visited, classes, docs))
    more = more.union(linked_to_groups(packed, packed.select("*"), classes, docs))
    roots = components(stored(links.union(more), "linked"))

    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("first"))
    of_class = grouped.select("node", "root").join(least, "root")
    of_class = of_class.select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("pick"))
    found = made.select("doc_id", "text_hash", "n", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    own = F.col("doc_id").eqNullSafe(component)
    return found.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        own.alias("kept"),
        (own & F.coalesce(F.col("text_hash") == F.col("pick"), F.lit(True))).alias("stays"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``, as ``judged_rows`` has them."""
    return judged_rows(docs).drop("text_hash", "stays")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of a group the smallest doc_id stays.

    Of rows with equal id and text one stays, and of a group whose smallest id
    stands on several texts, or that has no id at all, one text. Rows are found by id and text
    hash, so other texts under an id that goes, or without an id, stay; what is
    taken out is a small part and is broadcast where its size allows.
    """
    judged = stored(judged_rows(docs.select("doc_id", "text")), "judged")
    names = F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")
    gone = stored(judged.filter(~F.col("stays")).select(*names).distinct(), "gone")
    same = lambda found: docs["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(docs["text"]) == found["hash"])
    left = docs.join(gone, same(gone), "left_anti")
    times = judged.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    twice = stored(times.filter("times > 1").select(*names), "twice")
    copies = left.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same(twice), "left_anti").union(copies)
