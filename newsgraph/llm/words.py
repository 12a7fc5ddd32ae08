"""Text columns as flat arrays: words, their hashes, their places.

A batch of texts is one byte buffer with offsets, as Arrow keeps it. Words are
found and hashed with array operations over pieces of about a megabyte that end
at white space, so memory follows the number of words, not of Python objects,
and a very long text needs no more than a short one at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks."""
    return sys.__dict__.setdefault("_newsgraph_worker_cache", {})


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets from 0 of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, most_bytes: int = 2_000_000, most_texts: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts with a bounded ``text`` column, so that arrays over its words stay small."""
    _, at = raw_text(batch.column("text"))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), i + most_texts, n)
        yield batch.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = max(n, CHUNK + 4096)
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        made = []
        for step in (base, inverse):
            line = np.full(size, step, np.uint64)
            line[0] = 1
            made.append(np.cumprod(line, dtype=np.uint64))
        cache["powers"] = tuple(made)
    return cache["powers"]


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        values[65:91] = values[97:123]
    return values


def hash_spans(block: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of non-empty byte spans of one block, by differences of a running sum."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(block) + 1)
    total = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[block] * power[: len(block)], out=total[1:])
    span = (total[end] - total[start]) * inverse[start]
    return mix(span + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """Words of a batch: hash, byte span, and per text the first word's number."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def cuts(data: np.ndarray, at: np.ndarray, breaks: np.ndarray) -> list[int]:
    """Ends of pieces of about CHUNK bytes, each at a break byte or at a text's end."""
    found, place, stop = [], int(at[0]), int(at[-1])
    while place < stop:
        cut = min(place + CHUNK, stop)
        if cut < stop:
            border = int(at[np.searchsorted(at, cut)])
            while cut < border:
                near = np.flatnonzero(breaks[data[cut : min(cut + 4096, border)]])
                if len(near):
                    cut += int(near[0])
                    break
                cut = min(cut + 4096, border)
        found.append(cut)
        place = cut
    return found


def lookup(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


def find_words(data: np.ndarray, at: np.ndarray, lower: bool, breaks: bytes = SPACES) -> Words:
    """Longest runs of other bytes than ``breaks``: words ``[^\\x20\\x09-\\x0D]+`` of every text.

    ``lower`` ignores the case of A-Z in the hashes.
    """
    space = lookup(breaks)
    hashes, starts, ends, place = [], [], [], int(at[0])
    for cut in cuts(data, at, space):
        block = data[place:cut]
        inside = ~space[block]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        edge = at[np.searchsorted(at, place) : np.searchsorted(at, cut)] - place
        begins[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        finishes[edge] = inside[edge]
        start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        hashes.append(hash_spans(block, start, end, lower))
        starts.append(start + place)
        ends.append(end + place)
        place = cut
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, at))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, the number of each run's text, its first word."""
    total = len(words.hashes) - size + 1
    text_of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = np.zeros(total, np.uint64)
    for k in range(size):
        hashed = mix(hashed + np.uint64(0x9E3779B97F4A7C15)) + words.hashes[k : k + total]
    inside = text_of[:total] == text_of[size - 1 :]
    return mix(hashed[inside]), text_of[:total][inside], np.flatnonzero(inside)
