"""Language-model scores of documents from bigram tries that are dealt over shards.

The model gives a word after a context ``(c(context word) + MU * p(word)) /
(c(context) + MU)``, with ``p`` the word's add-one frequency. Its logarithm is a
part that needs only the word's counts and a part that needs only the context's,
so a score is a sum of what is known about each word separately. Occurrences go
to the shard of their word; the shard builds its part of the trie from the
training ones, looks all of them up, and returns one sum per document. Counts
and occurrences so move once, and no task needs the whole model.

Words that are more frequent than a share of a shard are dealt by word and
context instead; there are at most SHARE words per shard of that kind, and their
counts are sent along. Pairs that alone exceed a shard's mean are dealt by slice:
they are counted first, by one aggregate over the words that can make such a
pair, there is at most one per shard, and their counts are sent along too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.elias_fano import BigramTrie
from newsgraph.llm.tables import salt_count
from newsgraph.llm.words import find_words, mix, raw_text, slices
from newsgraph.session import stored

MU = 20.0
SHARE = 4
# Occurrences of a shard, in the mean: what one task holds at once.
PER_SHARD = 4_000_000
# Slices of a batch that are sorted and sent together.
SLICE_BYTES, SLICE_TEXTS = 16_000_000, 50_000
# Hashes of the end of a text, and of what stands before its first word.
END, BEGIN = np.uint64(0xE17A1465B9D3E6F1), np.uint64(0x5D588B656C078965)
CONTEXT_BYTES = 5


def in_training(doc_id: Column) -> Column:
    """Documents that are learned from: crc32 of the id as text is not 2 modulo 7; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and the number of each token's text."""
    words = find_words(*raw_text(column), lower=True)
    texts = np.arange(len(words.first) - 1)
    tokens = np.insert(words.hashes, words.first[1:], END)
    return tokens, np.repeat(texts, words.counts() + 1)


def _narrow(context: np.ndarray) -> np.ndarray:
    """Contexts as 40-bit numbers."""
    return context >> np.uint64(64 - 8 * CONTEXT_BYTES)


def contexts_of(tokens: np.ndarray) -> np.ndarray:
    """What stands before each token, as 40-bit numbers."""
    before = np.concatenate([[BEGIN], tokens[:-1]])
    before[before == END] = BEGIN
    return _narrow(before)


def pair_ids(tokens: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return tokens ^ mix(contexts)


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, train, total``: occurrences of each token in training documents and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, SLICE_TEXTS):
                tokens, text_of = tokens_of(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)[text_of]
                found, number = np.unique(tokens, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        pa.array(np.bincount(number[train], minlength=len(found))),
                        pa.array(np.bincount(number, minlength=len(found))),
                    ],
                    names=["token", "train", "total"],
                )

    rows = docs.select("text", in_training(F.col("doc_id")).alias("train"))
    counted = rows.mapInArrow(count, "token long, train long, total long")
    return counted.groupBy("token").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def pair_counts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``token, context, train, total`` of pairs whose word and context are both in ``words`` or a beginning."""
    words = np.sort(words)
    contexts = np.unique(_narrow(np.append(words, BEGIN)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, SLICE_TEXTS):
                tokens, text_of = tokens_of(part.column("text"))
                context = contexts_of(tokens)
                own = np.flatnonzero(np.isin(tokens, words) & np.isin(context, contexts))
                learn = part.column("train").to_numpy(zero_copy_only=False).astype(bool)[text_of[own]]
                _, one, number = np.unique(pair_ids(tokens[own], context[own]), return_index=True, return_inverse=True)
                columns = [tokens[own][one].view(np.int64), context[own][one].view(np.int64)]
                columns += [np.bincount(n, minlength=len(one)) for n in (number[learn], number)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "context", "train", "total"])

    rows = docs.select("text", in_training(F.col("doc_id")).alias("train"))
    counted = rows.mapInArrow(count, "token long, context long, train long, total long")
    return counted.groupBy("token", "context").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


# What is sent along: hot words, sorted, with their training counts; hot pairs as words and contexts with theirs.
Hot = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _column(rows: list, name: str, kind=np.uint64) -> np.ndarray:
    return np.array([r[name] for r in rows], np.int64).view(kind)


def hot_counts(docs: DataFrame, counts: DataFrame, total: int, shards: int) -> Hot:
    """Words above 1 / (SHARE * shards) of all occurrences and pairs above 1 / shards: at most SHARE + 1 numbers a shard."""
    frequent = counts.filter(F.col("total") > total / (SHARE * shards)).collect()
    # A pair is no more frequent than its word and its context.
    able = [r["token"] for r in frequent if r["total"] > total / shards]
    pairs = []
    if able:
        counted = pair_counts(docs, np.array(able, np.int64).view(np.uint64))
        pairs = counted.filter(F.col("total") > total / shards).collect()
    frequent.sort(key=lambda r: r["token"] % (1 << 64))
    words = _column(frequent, "token"), _column(frequent, "train", np.int64)
    return *words, _column(pairs, "token"), _column(pairs, "context"), _column(pairs, "train", np.int64)


NAMES = ["shard", "slice", "doc_ids", "n_tokens", "train", "words", "times", "contexts", "texts"]


def occurrences(docs: DataFrame, hot: Hot, shards: int) -> DataFrame:
    """Tokens with their contexts as one row per slice and shard, and one row about each slice.

    ``slice`` names the slice by its content and ``train`` has a bit per document
    of it. ``words`` and ``times`` are the distinct tokens and how often each
    stands in the row; ``contexts`` and ``texts`` are, in that order, what stood
    before each and the number of its document in the slice. The row about a
    slice has its ``doc_ids`` and their ``n_tokens`` instead.
    """
    words_dealt, pairs_dealt = hot[0], pair_ids(hot[2], hot[3])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, SLICE_TEXTS):
                tokens, text_of = tokens_of(part.column("text"))
                context = contexts_of(tokens)
                ids = part.column("doc_id")
                train = np.packbits(part.column("train").to_numpy(zero_copy_only=False).astype(bool)).tobytes()
                counts = np.bincount(text_of, minlength=part.num_rows).astype("<u4").tobytes()
                told = hashlib.blake2b(repr(ids.to_pylist()).encode() + train + tokens.tobytes(), digest_size=16)
                name = told.digest()
                pair = pair_ids(tokens, context)
                dealt = np.where(np.isin(tokens, words_dealt), pair, tokens)
                dealt = np.where(np.isin(pair, pairs_dealt), pair ^ np.uint64(int.from_bytes(name[:8])), dealt)
                shard = mix(dealt) % np.uint64(shards)
                shard = shard.astype(np.uint16 if shards < 65536 else np.uint32)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [(int.from_bytes(name[:4]) % shards, name, ids.to_pylist(), counts, train, b"", b"", b"", b"")]
                for s in np.flatnonzero(np.diff(bounds)):
                    own = order[bounds[s] : bounds[s + 1]]
                    own = own[np.lexsort((context[own], tokens[own]))]
                    words, times = np.unique(tokens[own], return_counts=True)
                    narrow = context[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BYTES]
                    packed = (words.tobytes(), times.astype("<u4").tobytes(), narrow.tobytes(), text_of[own].astype("<u2").tobytes())
                    rows.append((int(s), name, [], b"", train, *packed))
                kinds = [pa.int32(), pa.binary(), pa.list_(ids.type), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", in_training(F.col("doc_id")).alias("train"))
    fields = f"shard int, slice binary, doc_ids array<{kind}>, " + ", ".join(f"{n} binary" for n in NAMES[3:])
    return rows.mapInArrow(deal, fields)


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column.combine_chunks()]


def _gathered(table: pa.Table) -> tuple:
    """Words of a shard's rows; then of each token its word's number, that with the context, row with text, training."""
    words, times, contexts = _arrays(table["words"], np.uint64), _arrays(table["times"], "<u4"), _arrays(table["contexts"], np.uint8)
    texts, train = _arrays(table["texts"], "<u2"), _arrays(table["train"], np.uint8)
    all_words, number = np.unique(np.concatenate(words), return_inverse=True)
    word_of = np.repeat(number.astype(np.int32), np.concatenate(times))
    narrow = np.concatenate(contexts).reshape(-1, CONTEXT_BYTES)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :CONTEXT_BYTES] = narrow
    key = wide.view("<u8").ravel()
    key |= word_of.astype(np.uint64) << np.uint64(8 * CONTEXT_BYTES)
    place = np.concatenate([x.astype(np.int64) | row << 16 for row, x in enumerate(texts)])
    learn = [np.unpackbits(t)[x].astype(bool) for t, x in zip(train, texts)]
    return all_words, word_of, key, place, np.concatenate(learn)


def shard_scores(rows: DataFrame, kind: str, hot: Hot, total: int, distinct: int) -> DataFrame:
    """Sums per document, packed into one row per slice and shard.

    ``slice, doc_ids, n_tokens, train`` as they came, and ``texts, tokens, known,
    base, score``: numbers of documents in the slice, and their sums.
    """
    hot_words, word_counts, pair_words, pair_contexts, counts_of_pairs = hot
    width, low = float(total + distinct + 1), np.uint64((1 << 8 * CONTEXT_BYTES) - 1)

    def score(table: pa.Table) -> pa.Table:
        words, word_of, key, place_of, learn = _gathered(table)
        counts = np.bincount(word_of[learn], minlength=len(words))
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, words), len(hot_words) - 1)
            counts = np.where(hot_words[at] == words, word_counts[at], counts)
        prior = MU * (counts + 1) / width
        asked, number = np.unique(key, return_inverse=True)
        del key
        asked_word = (asked >> np.uint64(8 * CONTEXT_BYTES)).astype(np.int64)
        times = np.bincount(number[learn], minlength=len(asked))
        # Hot pairs of this shard have the counts of all slices instead of their own.
        if len(words) and len(pair_words):
            at = np.minimum(np.searchsorted(words, pair_words), len(words) - 1)
            wanted = at.astype(np.uint64) << np.uint64(8 * CONTEXT_BYTES) | pair_contexts
            there = np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)
            here = (words[at] == pair_words) & (asked[there] == wanted)
            times[there[here]] = counts_of_pairs[here]
        seen = times > 0
        of = asked_word[seen]
        trie = BigramTrie(words, of, asked[seen] & low, np.log10(times[seen] + prior[of]))
        place, _ = trie.words.successor(words[asked_word])
        value, found = trie.find(place, asked & low)
        value = np.where(found, value, np.log10(prior)[asked_word])[number]
        value -= np.where(words == END, 0.0, np.log10(counts + MU))[word_of]
        del number
        # One sum per row and text, in that order.
        group, of_group = np.unique(place_of, return_inverse=True)
        bounds = np.searchsorted(group >> 16, np.arange(table.num_rows + 1))
        add = lambda x: np.bincount(of_group, x, minlength=len(group))
        columns = [
            (group & 0xFFFF).astype("<u2"),
            add(np.ones(len(word_of))).astype("<u4"),
            add((counts > 0)[word_of]).astype("<u4"),
            add(np.log10(counts + 1.0)[word_of]),
            add(value),
        ]
        packed = [pa.array([c[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()) for c in columns]
        return pa.table([*(table[n] for n in NAMES[1:5]), *packed], names=[*NAMES[1:5], *SUMS])

    fields = f"slice binary, doc_ids array<{kind}>, n_tokens binary, train binary, " + ", ".join(f"{n} binary" for n in SUMS)
    return rows.groupBy("shard").applyInArrow(score, fields)


SUMS = {"texts": "<u2", "tokens": "<u4", "known": "<u4", "base": "<f8", "score": "<f8"}


def slice_scores(packed: DataFrame, kind: str) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, base, score`` of every document, from the rows of its slice.

    Equal slices share a name; their rows add up and are dealt back evenly.
    """

    def add_up(table: pa.Table) -> pa.Table:
        about = [k for k, c in enumerate(table["n_tokens"]) if len(c.as_buffer())]
        columns = {n: np.concatenate(_arrays(table[n], kind)) for n, kind in SUMS.items()}
        times = len(about)
        ids = table["doc_ids"][about[0]].values if times else pa.array([])
        n = len(ids)
        texts = columns.pop("texts").astype(np.int64)
        sums = {k: np.bincount(texts, v, minlength=n) / max(times, 1) for k, v in columns.items()}
        tokens = np.frombuffer(table["n_tokens"][about[0]].as_buffer(), "<u4") if times else np.zeros(0)
        if len(sums["tokens"]) != n or (sums["tokens"] != tokens).any():
            raise RuntimeError("rows of a slice are missing: the documents changed while they were read")
        train = np.unpackbits(np.frombuffer(table["train"][0].as_buffer(), np.uint8))[:n].astype(bool)
        whole = lambda x: pa.array(np.rint(x).astype(np.int64))
        one = pa.table(
            [ids, pa.array(train), whole(tokens), whole(sums["known"]), pa.array(sums["base"]), pa.array(sums["score"])],
            names=["doc_id", "train", "n_tokens", "n_known", "base", "score"],
        )
        return pa.concat_tables([one] * times)

    fields = f"doc_id {kind}, train boolean, n_tokens long, n_known long, base double, score double"
    return packed.groupBy("slice").applyInArrow(add_up, fields)


def score_documents(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Scores of every document, learned from the training documents of ``docs`` (``doc_id, text``).

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A
    null text is an empty one: it has one token, the end. Repeated rows are
    counted and returned as often as they stand there. Without training documents
    all scores are those of empty counts. Other columns are not read; an empty
    table gives an empty one. ``shards`` is a shard per PER_SHARD occurrences, and
    the number of shuffle partitions at least, unless given; results do not depend
    on it but for rounding of the trie's values.
    """
    counts = stored(token_counts(docs), "token-counts")
    end = int(END.view(np.int64))
    totals = counts.agg(
        F.sum("train").alias("train"),
        F.sum("total").alias("total"),
        F.count(F.when(F.col("train") > 0, 1)).alias("distinct"),
        F.sum(F.when(F.col("token") == end, F.col("train"))).alias("texts"),
    ).first()
    total, distinct, texts = (totals[n] or 0 for n in ("train", "distinct", "texts"))
    shards = shards or max(salt_count(docs.sparkSession), -(-(totals["total"] or 0) // PER_SHARD))
    hot = hot_counts(docs, counts, totals["total"] or 0, shards)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = occurrences(docs, hot, shards)
    sums = slice_scores(shard_scores(rows, kind, hot, total, distinct), kind)
    return sums.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("score") - F.lit(float(np.log10(texts + MU)))).alias("score"),
    )
