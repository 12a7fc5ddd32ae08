"""Language of texts by a string kernel with landmarks and ridge regression.

The kernel of two texts counts the n-grams of one to four bytes that both have,
scaled by the geometric mean of how many each has. A text is described by its
kernel values with a few landmark texts, turned into coordinates by the inverse
root of the landmarks' own kernel matrix (Nyström). On these coordinates one
ridge regression per language, weighted so that languages count alike, says how
much a text looks like it. Texts are scored in batches by matrix products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.words import raw_text

LONGEST_GRAM = 4
SLOT_BITS = 15  # n-grams are told apart by a hash of so many bits
BATCH_TEXTS = 64
PIECE = 1 << 20
# Bounds of what a model is fitted on; with many languages it grows, each has LEAST_LANDMARKS.
TEXTS_PER_LANGUAGE = 1000
LANDMARKS = 128
LEAST_LANDMARKS = 4
# Rows looked at for a sample, as a multiple of it, and by how much that is widened.
SPARE, WIDER = 8, 16
RIDGE = 1e-3
UNKNOWN = "und"


def _mark_grams(piece: np.ndarray, at: np.ndarray, present: np.ndarray) -> None:
    """Sets the slots of all n-grams of the texts in one piece; ``at`` are their bounds in it."""
    upper = (piece >= 65) & (piece <= 90)
    low = piece + upper.astype(np.uint8) * np.uint8(32)
    row = np.repeat(np.arange(len(at) - 1) << SLOT_BITS, np.diff(at))
    flat = present.reshape(-1)
    gram = np.zeros(len(low), np.uint32)
    inside = np.ones(len(low), bool)
    for n in range(1, LONGEST_GRAM + 1):
        if n > 1:
            gram, inside = gram[:-1], inside[:-1].copy()
            last = at[1:-1] - n + 1  # here an n-gram would begin in one text and end in the next
            for shift in range(n - 1):
                begin = last + shift
                inside[begin[(begin >= 0) & (begin < len(inside))]] = False
        gram = (gram << np.uint32(8)) | low[n - 1 :]
        slot = (gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - SLOT_BITS)
        where = row[: len(slot)] + slot
        flat[where[inside] if n > 1 else where] = 1


def gram_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts ``[i, j)`` of a column at a time with the 0/1 matrix of their n-grams."""
    data, at = raw_text(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = i + 1
        while j < n and j - i < BATCH_TEXTS and at[j + 1] - at[i] <= PIECE:
            j += 1
        present = np.zeros((j - i, 1 << SLOT_BITS), np.float32)
        if at[j] - at[i] <= PIECE or j - i > 1:
            _mark_grams(data[at[i] : at[j]], at[i : j + 1] - at[i], present)
        else:  # one long text, in pieces that overlap
            for a in range(int(at[i]), int(at[j]), PIECE):
                part = data[a : min(a + PIECE + LONGEST_GRAM - 1, int(at[j]))]
                _mark_grams(part, np.array([0, len(part)]), present)
        yield i, j, present
        i = j


def kernel_rows(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts (rows) with landmarks; 0 for texts without n-grams."""
    sizes = np.sqrt(np.outer(present.sum(axis=1), landmarks.sum(axis=1)))
    common = present @ landmarks.T
    return np.divide(common, sizes, out=np.zeros(common.shape), where=sizes > 0)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, one row per landmark
    weights: np.ndarray  # kernel values and 1 to one number per language

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.landmarks, axis=1).astype(np.float32)

    def scores(self, present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        values = kernel_rows(present, landmarks)
        return np.hstack([values, np.ones((len(values), 1))]) @ self.weights


def solve(values: np.ndarray, between: np.ndarray, which: np.ndarray, n_languages: int, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from kernel values of training texts and of the landmarks themselves."""
    size, turn = np.linalg.eigh((between + between.T) / 2)
    root = turn @ np.diag(1 / np.sqrt(np.maximum(size, 1e-4))) @ turn.T
    x = np.hstack([values @ root, np.ones((len(values), 1))])
    y = np.where(which[:, None] == np.arange(n_languages), 1.0, -1.0)
    balance = 1 / np.maximum(np.bincount(which, minlength=n_languages), 1)[which] / n_languages
    left = (x * balance[:, None]).T @ x + ridge * np.eye(x.shape[1]) / len(x)
    found = np.linalg.solve(left, (x * balance[:, None]).T @ y)
    turned = np.vstack([root @ found[:-1], found[-1:]])
    return turned


def in_training(doc_id: Column) -> Column:
    """Documents a model may learn from: crc32 of the id as text is not 1 modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def _draw(share: Column) -> Column:
    """Whether the hash of a row's id and text is in the lowest ``share`` of all hashes."""
    return (F.col("draw").cast("double") + 2.0**63) / 2.0**64 < share


def choose(usable: DataFrame, per_language: int) -> DataFrame:
    """``id, name, text_hash, rank``: of each language the ``per_language`` distinct texts of an id with the least hashes.

    Only a share of the hashes that should hold some times as many is looked at,
    so what is sorted for a language does not grow with it; where copies leave too
    few different rows in it, the share is widened.
    """
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    keyed = usable.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("name"),
        F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text").alias("draw"),
    )
    spark, open_, found = usable.sparkSession, dict.fromkeys(counts, SPARE), []
    order = Window.partitionBy("name").orderBy("draw", "id", "text_hash")
    while open_:
        shares = [(lang, min(1.0, times * per_language / counts[lang])) for lang, times in open_.items()]
        limits = spark.createDataFrame(shares, "name string, share double")
        drawn = keyed.join(F.broadcast(limits), "name").filter(_draw(F.col("share"))).drop("share").distinct()
        ranks = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
        # At most per_language rows of each language.
        rows = [tuple(r) for r in ranks.select("id", "name", "text_hash", "rank").collect()]
        held = Counter(r[1] for r in rows)
        done = {lang for lang, share in shares if share == 1.0 or held[lang] == per_language}
        found += [r for r in rows if r[1] in done]
        open_ = {lang: times * WIDER for lang, times in open_.items() if lang not in done}
    kind = keyed.schema["id"].dataType.simpleString()
    return spark.createDataFrame(sorted(found, key=repr), f"id {kind}, name string, text_hash long, rank int")


def fit(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """A model from ``doc_id, text, lang`` of training documents; None without any.

    At most ``per_language`` texts of each language, those with the smallest
    hashes, are described on the executors; the driver gets a row of kernel
    values for each. Repeated rows count once, an id with several texts once for
    each. ``landmarks`` are shared out over the languages, but each has
    LEAST_LANDMARKS, so the driver's part grows with their number squared.
    """
    usable = docs.filter(in_training(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    ids = choose(usable, per_language)
    languages = sorted(r["name"] for r in ids.select("name").distinct().collect())
    if not languages:
        return None
    each = max(LEAST_LANDMARKS, landmarks // len(languages))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = usable.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash"))
    same = [F.col("doc_id") == F.col("id"), F.col("lang") == F.col("name"), hashed["text_hash"] == ids["text_hash"]]
    joined = hashed.join(F.broadcast(ids), same).select("doc_id", "text", "lang", hashed["text_hash"], "rank")
    picked = joined.dropDuplicates(["doc_id", "lang", "text_hash"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(p.astype(np.uint8), axis=1) for _, _, p in gram_batches(batch.column("text"))]
            rows = [r.tobytes() for b in bits for r in b]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "bits"])

    marked = picked.filter(F.col("rank") <= each).select("doc_id", "text")
    found = sorted(marked.mapInArrow(pack, f"doc_id {kind}, bits binary").collect(), key=repr)
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in found])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(packed, axis=1).astype(np.float32)
        for batch in batches:
            rows = [kernel_rows(p, marks) for _, _, p in gram_batches(batch.column("text"))]
            values = np.vstack(rows) if rows else np.zeros((0, len(marks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([v.tobytes() for v in values], pa.binary())], names=["lang", "kernel"]
            )

    rows = picked.select("text", "lang").mapInArrow(describe, "lang string, kernel binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["kernel"]))
    number = {lang: k for k, lang in enumerate(languages)}
    which = np.array([number[r["lang"]] for r in rows])
    marks = np.unpackbits(packed, axis=1).astype(np.float32)
    weights = solve(np.array([np.frombuffer(r["kernel"]) for r in rows]), kernel_rows(marks, marks), which, len(languages))
    return Model(languages, packed, weights)


def _has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a character that is a letter."""
    return np.array([any(map(str.isalpha, v.as_py() or "")) for v in column], bool)


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``row`` (the row as it was), ``lang_pred`` and ``score`` of each row's text.

    The score is the winning regression's value brought from -1..1 to 0..1 and
    cut there. A null text, or one without a letter, is ``und`` with score 0, and
    so is every text without a model. Ties go to the first language by name.
    """
    place = df.columns.index(text)
    rows = df.select(F.struct("*").alias("row"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # A row of bits per landmark, a weight per landmark and language; no class of ours, which workers could not name.
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.landmarks, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        marks, names = known.unpacked(), np.array(known.languages, object)
        for batch in batches:
            n, texts = batch.num_rows, batch.column("row").field(place)
            best, top = np.zeros(n, int), np.zeros(n)
            for i, j, present in gram_batches(texts):
                values = known.scores(present, marks)
                best[i:j] = values.argmax(axis=1)
                top[i:j] = values.max(axis=1)
            letters = _has_letter(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(np.where(letters, names[best], UNKNOWN), pa.string()),
                    pa.array(np.where(letters, np.clip((top + 1) / 2, 0, 1), 0.0)),
                ],
                names=["row", "lang_pred", "score"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(score, f"row {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, with a model fitted on ``docs``.

    Repeated rows give repeated rows, a null id is not held out, other columns
    are not read, an empty table gives an empty one.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    made = predict(docs.select("doc_id", "text"), model)
    held_out = ~F.coalesce(in_training(F.col("row.doc_id")), F.lit(True))
    return made.select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, with a language and at least ``least_score``."""
    model = fit(docs.select("doc_id", "text", "lang"))
    made = predict(docs, model)
    return made.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
