"""Tokens of two tokenizers over the same bytes, aligned by pointer jumping.

The tokens of A and of B both tile a text. Both begin anew where white space
begins, so a text is the row of its parts between, and a part that came before is
not aligned again. Every token points to the overlapping
token that reaches farthest right, a token of B before one of A that ends at the
same place, and itself if none does better. Successor doubling, on the arrays of
many texts at once, takes every token to the terminal token of its component;
tokens with the same terminal are one group.

Counts of linked id pairs cover all texts. The most frequent pairs, a bounded
number, are sent to the tasks; the others are joined by a shuffle in which no
pair can be hot.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.words import raw_text, slices, worker_cache
from newsgraph.session import Scratch

# The pairs that go to every task: 17 bytes each.
SENT_PAIRS = 1 << 16
SLICE_BYTES = 1_000_000
SHIFT = 32
# Fixed value: how the byte-level kind of tokenizer cuts a text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The quicker library runs out of stack on long runs of white space.
QUICK = 1000
# What a worker keeps of parts; it changes time only.
REMEMBERED, REMEMBERED_BYTES = 200_000, 40_000_000
# White space of Python is a superset of that of the tokenizers.
_RUN = re.compile(r"^\s|\s ")
_CUT = re.compile(r"(?<!\s) ")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"


def _byte_of_shown() -> dict[str, int]:
    """The byte for each character in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """Ids of a byte-level BPE file; strings of its special tokens are plain text."""

    def __init__(self, path: str):
        # A task has one core: the library's own threads would take those of other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_of_shown()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            shown = all(c in byte_of for c in entry)
            self.spelled[number] = bytes(byte_of[c] for c in entry) if shown else entry.encode()
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary under the quicker library, if its merges are in the order of their ids."""
        with open(path) as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        splitter = told["pre_tokenizer"] or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        if told["normalizer"] or not plain or made != sorted(made) or min(made) < 256:
            return None
        import tiktoken

        ranks = {self.spelled[k]: k for k in [*range(256), *made]}
        return tiktoken.Encoding("aligned", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and the text."""
        return [self.ranked.encode_ordinary(" " + t) if self.ranked and len(t) <= QUICK else self._whole(t) for t in texts]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceTokenizer:
    """Ids of a piece model, which itself puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = [self._bytes(k) for k in range(self.model.get_piece_size())]

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteTokenizer, PieceTokenizer]:
    """Both tokenizers, loaded once per worker."""
    cache = worker_cache()
    key = ("aligned", path_a, path_b)
    if key not in cache:
        cache[key] = ByteTokenizer(path_a), PieceTokenizer(path_b)
    return cache[key]


def jump(pointer: np.ndarray) -> np.ndarray:
    """The end of every chain, by doubling: each round goes twice as far."""
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def successors(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For the tokens of A, then of B, the number of the farthest-right token that overlaps.

    Both sides tile the same ranges, in order. Tokens of one end: B's is taken.
    """
    n = len(end_a)
    last_b = np.searchsorted(start_b, end_a, "left") - 1
    last_a = np.searchsorted(start_a, end_b, "left") - 1
    return np.concatenate([last_b + n, np.where(end_a[last_a] > end_b, last_a, np.arange(len(end_b)) + n)])


def _numbers_as_text(numbers: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers each followed by a byte, as one byte array, and where each begins."""
    digits = np.searchsorted(10 ** np.arange(1, 10), numbers, "right") + 1
    at = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(digits + 1, out=at[1:])
    told = np.empty(at[-1], np.uint8)
    told[at[1:] - 1] = behind
    rest, place = numbers.copy(), at[1:] - 2
    left = np.arange(len(numbers))
    while len(left):
        told[place[left]] = rest[left] % 10 + 48
        rest[left] //= 10
        place[left] -= 1
        left = left[rest[left] > 0]
    return told, at


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has."""
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count


def align(ids_a: list[list[int]], ids_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> dict:
    """Groups and links of texts with the same bytes under both tokenizers.

    ``size_*`` has the bytes of each id. Per text: ``n_groups``, ``groups``
    (ids as ``a1,a2|b1;...``) and ``links``, its linked pairs of ids as 64-bit
    integers, A's in the upper half.
    """
    (a, count_a), (b, count_b) = flat(ids_a), flat(ids_b)
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    pointer = successors(end_a - size_a[a], end_a, end_b - size_b[b], end_b)
    terminal = jump(pointer)
    # Terminals are tokens of B, one per component, in order: they number the groups.
    group_a, group_b = terminal[: len(a)] - len(a), terminal[len(a) :] - len(a)
    last_a = np.flatnonzero(np.diff(group_a, append=-1))
    last_b = np.flatnonzero(group_b == np.arange(len(b)))
    # Tokens in the order of groups, A before B within one.
    before_a = np.searchsorted(group_b, group_a, "left")
    before_b = np.searchsorted(group_a, group_b, "right")
    place_a, place_b = np.arange(len(a)) + before_a, np.arange(len(b)) + before_b
    ids, behind = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    behind[place_a[last_a]], behind[place_b[last_b]] = ord("|"), ord(";")
    told, at = _numbers_as_text(ids, behind)
    first = np.concatenate([[0], np.cumsum(count_a + count_b)])
    cut = np.searchsorted(last_b, np.concatenate([[0], np.cumsum(count_b)]))
    told, at = told.tobytes(), at[first].tolist()
    links, by_text = (a[last_a] << SHIFT | b[last_b]).astype("<i8").tobytes(), (cut * 8).tolist()
    return {
        "n_groups": np.diff(cut).tolist(),
        "groups": [told[i : max(j - 1, i)] for i, j in zip(at[:-1], at[1:])],
        "links": [links[i:j] for i, j in zip(by_text[:-1], by_text[1:])],
    }


def spelled_alike(texts: list[str], ids: list[list[int]], spelled: list[bytes]) -> list[bool]:
    """For each text, whether its tokens spell a space and the text."""
    wanted = [b" " + t.encode() for t in texts]
    sizes = [sum(map(len, map(spelled.__getitem__, x))) for x in ids]
    if sizes == list(map(len, wanted)) and b"".join(wanted) == b"".join(map(spelled.__getitem__, chain.from_iterable(ids))):
        return [True] * len(texts)
    return [x == b"".join(map(spelled.__getitem__, y)) for x, y in zip(wanted, ids)]


def parts_of(text: str) -> list[str]:
    """A text cut at the first space of each run of white space; a space and each part give back ``" " + text``.

    Neither tokenizer joins what stands before such a space with it (A's pattern
    begins a word there, B's pieces have spaces in front only), so the tokens of
    a text are those of its parts in a row, and groups stay within a part.
    """
    parts = _CUT.split(" " + text)[1:] if _RUN.search(text) else text.split(" ")
    if parts[-1] == "" and len(parts) > 1:
        # A last space alone is no text of its own.
        parts[-2:] = [parts[-2] + " "]
    return parts


class AlignedParts:
    """Groups, links and counts of parts, kept by a worker under the part's number.

    Parts seen for the first time are tokenized and aligned together; one whose
    bytes a tokenizer changes has the number -1. Beyond ``REMEMBERED`` parts or
    ``REMEMBERED_BYTES`` all but those of the texts at hand are forgotten.
    """

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(x) for x in t.spelled], np.int64) for t in (a, b))
        probe = "Two  words,\nthree\t lines \n\n of it's 1 2  tést"
        by_parts = [sum(t.ids(parts_of(probe)), []) for t in (a, b)]
        inner = any(b" " in x.lstrip(b" ") for x in b.spelled)
        # Other kinds of tokenizers get whole texts.
        self.cut = not inner and by_parts == [t.ids([probe])[0] for t in (a, b)]
        self._begin({}, [], [], np.zeros((0, 3), np.int64))

    def _begin(self, number: dict[str, int], groups: list[bytes], links: list[bytes], counts: np.ndarray) -> None:
        self.number, self.groups, self.links, self.counts = number, groups, links, counts
        self.held = sum(map(len, groups)) + sum(map(len, links))

    def parts(self, text: str) -> list[str]:
        return parts_of(text) if self.cut else [text]

    def learn(self, parts: list[str]) -> None:
        ids_a, ids_b = self.a.ids(parts), self.b.ids(parts)
        alike = list(map(all, zip(spelled_alike(parts, ids_a, self.a.spelled), spelled_alike(parts, ids_b, self.b.spelled))))
        if not all(alike):
            self.number.update(dict.fromkeys(parts, -1))
            parts, ids_a, ids_b = (list(compress(x, alike)) for x in (parts, ids_a, ids_b))
        found = align(ids_a, ids_b, self.size_a, self.size_b)
        self.number.update(zip(parts, range(len(self.groups), len(self.groups) + len(parts))))
        self.groups += found["groups"]
        self.links += found["links"]
        counts = [list(map(len, ids_a)), list(map(len, ids_b)), found["n_groups"]]
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64).T.reshape(-1, 3)])
        self.held += sum(map(len, found["groups"])) + sum(map(len, found["links"]))

    def forget_but(self, parts: set[str]) -> None:
        kept = [p for p in parts if self.number.get(p, -1) >= 0]
        old = [self.number[p] for p in kept]
        groups, links = ([x[k] for k in old] for x in (self.groups, self.links))
        self._begin(dict(zip(kept, range(len(kept)))), groups, links, self.counts[old])

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of each text's parts."""
        parts = set(chain.from_iterable(texts))
        if len(self.number) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget_but(parts)
        self.learn([p for p in parts if p not in self.number])
        return [list(map(self.number.__getitem__, parts)) for parts in texts]


def _aligned_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    cache, key = worker_cache(), ("aligned parts", path_a, path_b)
    if key not in cache:
        cache[key] = AlignedParts(*tokenizers_of(path_a, path_b))
    known = cache[key]
    for batch in batches:
        for part in slices(batch, SLICE_BYTES):
            n = part.num_rows
            data, at = raw_text(part.column("text"))
            held = np.flatnonzero(np.diff(at)).tolist()
            texts = [known.parts(data[at[k] : at[k + 1]].tobytes().decode()) for k in held]
            counted, told, linked = np.zeros((n, 3), np.int64), [""] * n, [b""] * n
            for row, numbers in zip(held, known.numbers(texts)):
                if min(numbers) >= 0:
                    counted[row] = known.counts[numbers].sum(axis=0)
                    told[row] = hashlib.sha256(b";".join(map(known.groups.__getitem__, numbers))).hexdigest()
                    linked[row] = b"".join(map(known.links.__getitem__, numbers))
            pairs, counts = np.unique(np.frombuffer(b"".join(linked), "<i8"), return_counts=True)
            doc_id = part.column("doc_id").cast(pa.int64())
            n_a, n_b, n_groups = np.append(counted, [[0, 0, 0]], axis=0).T
            # One more row carries the slice's pair counts.
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.concat_arrays([doc_id, pa.nulls(1, pa.int64())]),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(n_groups),
                    # Tokens are not empty, so one of each side ends where a group ends.
                    "n_links": pa.array(n_groups),
                    "groups_sha256": pa.array([*told, None], pa.string()),
                    "links": pa.array([*linked, None], pa.binary()),
                    "pairs": pa.array([*[None] * n, pairs], pa.list_(pa.int64())),
                    "counts": pa.array([*[None] * n, counts.astype(np.int64)], pa.list_(pa.int64())),
                }
            )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best`` of every linked id pair; ``best``: no pair of the same B id has more."""
    told = aligned.filter(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("z"))
    counted = told.groupBy(F.col("z.pairs").alias("pair")).agg(F.sum("z.counts").alias("count"))
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counted.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("most"))
    return counted.withColumn("b_id", b_id).join(most, "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(batches: Iterator[pa.RecordBatch], sent: tuple) -> Iterator[pa.RecordBatch]:
    """Per text the sums over links of sent pairs; the other links stay as pairs with their number."""
    pair, count, best = sent
    for batch in batches:
        rows, n_best, count_sum, rest, times = batch.column("row"), [], [], [], []
        for value in batch.column("links"):
            links = np.frombuffer(value.as_buffer(), "<i8")
            if len(pair):
                at = np.minimum(np.searchsorted(pair, links), len(pair) - 1)
                known = pair[at] == links
                n_best.append(int(best[at[known]].sum()))
                count_sum.append(int(count[at[known]].sum()))
                links = links[~known]
            else:
                n_best.append(0)
                count_sum.append(0)
            left, n = np.unique(links, return_counts=True)
            rest.append(left)
            times.append(n.astype(np.int64))
        yield pa.RecordBatch.from_pydict(
            {
                "row": rows,
                "n_best": pa.array(n_best, pa.int64()),
                "count_sum": pa.array(count_sum, pa.int64()),
                "rest": pa.array(rest, pa.list_(pa.int64())),
                "times": pa.array(times, pa.list_(pa.int64())),
            }
        )


def align_documents(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Every document's groups of tokens of A and B and how usual its links are.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``:
    tokens of both, groups, pairs of tokens that end at the same byte, those among
    them whose id pair is the most frequent of its B id over all documents (ties
    included), the sum of the frequencies, and the hash of the groups' ids. The
    result does not depend on ``sent_pairs``, the number of pairs sent to all tasks.

    Null and empty texts, and texts whose bytes a tokenizer changes (one that
    normalises), have no tokens: zeros and an empty string. Every row is
    a document of its own, repeated ids and rows too; a null id stays null; an
    empty table gives an empty one. Other columns are dropped. A very long text is
    tokenized in one task, in memory of some hundred times its size.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _aligned_batches(batches, path_a, path_b), ALIGNED
    )
    aligned = scratch.store(made.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = scratch.store(pair_counts(aligned), "pairs")
    top = counts.orderBy(F.desc("count"), "pair").limit(sent_pairs)
    told = sorted(tuple(r) for r in top.collect())
    columns = list(zip(*told)) or [(), (), ()]
    sent = tuple(np.array(c, kind) for c, kind in zip(columns, (np.int64, np.int64, bool)))
    shipped = scratch.spark.sparkContext.broadcast(sent)
    rows = aligned.filter(F.col("links").isNotNull())
    partial = rows.select("row", "links").mapInArrow(
        lambda batches: _sums(batches, shipped.value), "row long, n_best long, count_sum long, rest array<long>, times array<long>"
    )
    partial = scratch.store(partial, "partial")
    rest = partial.select("row", F.explode(F.arrays_zip("rest", "times")).alias("z"))
    found = rest.select("row", F.col("z.rest").alias("pair"), F.col("z.times").alias("times")).join(counts, "pair")
    late = found.select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("count") * F.col("times")).alias("count_sum")
    )
    sums = reduce(DataFrame.unionByName, [partial.select("row", "n_best", "count_sum"), late])
    summed = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(summed, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
