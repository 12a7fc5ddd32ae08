"""Monotone sequences in little space, and two trie levels made of them.

A sorted sequence is kept as packed low bits and a bit vector of high parts in
unary (Elias-Fano). The first value not below a given one is found by selecting
a zero in the bit vector and a binary search over few low parts; queries come in
arrays. All parts lie in one memory-mapped file that has no name, so nothing is
left behind when a task ends or dies.
"""

from __future__ import annotations

import tempfile

import numpy as np

_QUERIES = 1 << 15
_MOST_LOW_BITS = 56


class MappedFile:
    """Arrays appended to an unnamed temporary file and mapped back read-only."""

    def __init__(self):
        self._file = tempfile.TemporaryFile()
        self._end = 0

    def put(self, values: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(values)
        if not raw.size:
            return raw
        self._file.seek(self._end)
        self._file.write(raw.tobytes())
        self._file.write(bytes(-raw.nbytes % 64))
        self._file.flush()
        held = np.memmap(self._file, raw.dtype, "r", self._end, raw.shape)
        self._end += raw.nbytes + -raw.nbytes % 64
        return held


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values."""

    def __init__(self, values: np.ndarray, file: MappedFile):
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n = n
        self.low_bits = min(_MOST_LOW_BITS, max(0, (top // n).bit_length() - 1)) if n else 0
        low, high = np.uint64(self.low_bits), values >> np.uint64(self.low_bits)
        self._mask = np.uint64((1 << self.low_bits) - 1)
        packed = [np.zeros(0, np.uint8)]
        for at in range(0, n if self.low_bits else 0, 1 << 16):  # a multiple of 8 values fills whole bytes
            part = values[at : at + (1 << 16)] & self._mask
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : int(low)]
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        self._low = file.put(np.concatenate([*packed, np.zeros(8, np.uint8)]))
        self.highest = int(high[-1]) if n else 0
        size = (n + self.highest + 1 + 63) // 64 * 64
        line = np.zeros(size, np.uint8)
        line[high.astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(line, bitorder="little").view("<u8")
        self._bits = file.put(words)
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self._zeros_before = file.put(np.concatenate([[0], np.cumsum(zeros)]))
        self._ones_before = file.put(np.concatenate([[0], np.cumsum(64 - zeros)]))

    def _low_at(self, place: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(place), np.uint64)
        bit = place * self.low_bits
        windows = np.ndarray((len(self._low) - 7,), "<u8", self._low, strides=(1,))
        return (windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & self._mask

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """Values whose high part is below ``k``: the ones before the k-th zero, counted from 1."""
        found = np.zeros(len(k), np.int64)
        some = np.flatnonzero(k > 0)
        for at in range(0, len(some), _QUERIES):
            which = some[at : at + _QUERIES]
            nth = k[which]
            block = np.searchsorted(self._zeros_before, nth, "left") - 1
            word = np.ascontiguousarray(self._bits[block])
            zero = 1 - np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.argmax(np.cumsum(zero, axis=1, dtype=np.uint8) == (nth - self._zeros_before[block])[:, None], axis=1)
            found[which] = block * 64 + inside + 1 - nth
        return found

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the place of the first element not below it, and whether they are equal."""
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) if self.low_bits else values.astype(np.int64)
        beyond = (high > self.highest) | (self.n == 0)
        high = np.where(beyond, 0, high)
        begin = self._ones_before_zero(high)
        end = np.where(high == self.highest, self.n, self._ones_before_zero(np.minimum(high + 1, self.highest)))
        wanted, low, limit = values & self._mask, begin.copy(), end.copy()
        active = np.flatnonzero(low < limit)
        while len(active):
            middle = (low[active] + limit[active]) >> 1
            below = self._low_at(middle) < wanted[active]
            low[active] = np.where(below, middle + 1, low[active])
            limit[active] = np.where(below, limit[active], middle)
            active = active[low[active] < limit[active]]
        hit = (low < end) & ~beyond
        where = np.flatnonzero(hit)
        hit[where] = self._low_at(low[where]) == wanted[where]
        return np.where(beyond, self.n, low), hit

    def at(self, place: np.ndarray) -> np.ndarray:
        """The elements at the given places."""
        high = np.zeros(len(place), np.uint64)
        for at in range(0, len(place), _QUERIES):
            nth = place[at : at + _QUERIES] + 1
            block = np.searchsorted(self._ones_before, nth, "left") - 1
            word = np.ascontiguousarray(self._bits[block])
            one = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.argmax(np.cumsum(one, axis=1, dtype=np.uint8) == (nth - self._ones_before[block])[:, None], axis=1)
            high[at : at + _QUERIES] = block * 64 + inside + 1 - nth
        return (high << np.uint64(self.low_bits)) | self._low_at(place)

    def bytes(self) -> int:
        return self._low.nbytes + self._bits.nbytes + self._zeros_before.nbytes + self._ones_before.nbytes


class Quantised:
    """Numbers on an even grid of 65,536 values between the least and the greatest."""

    def __init__(self, values: np.ndarray, file: MappedFile):
        self.least = float(values.min()) if len(values) else 0.0
        self.step = max((float(values.max()) - self.least) / 65535, 1e-12) if len(values) else 1.0
        self._codes = file.put(np.rint((values - self.least) / self.step).astype(np.uint16))

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.least + self._codes[place] * self.step if len(place) else np.zeros(0)


class BigramTrie:
    """Words, and under each word the words that came before it, with a value per pair.

    Pointers say where the children of each word begin. Children are numbers of
    contexts, made monotone over the whole level by adding the last value before
    the word's range; a context is looked up in the range of its word.
    """

    def __init__(self, words: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, values: np.ndarray):
        """``words`` sorted; pairs sorted by word number, then context."""
        file = MappedFile()
        self.words = EliasFano(words, file)
        contexts = np.unique(pair_context)
        self.contexts = EliasFano(contexts, file)
        begins = np.searchsorted(pair_word, np.arange(len(words) + 1))
        self.begins = EliasFano(begins.astype(np.uint64), file)
        number = np.searchsorted(contexts, pair_context).astype(np.uint64) + np.uint64(1)
        # What a word's range adds up to in the end: the sum of the last numbers of all ranges so far.
        some = np.flatnonzero(np.diff(begins))
        ends = np.zeros(len(words), np.uint64)
        ends[some] = number[begins[some + 1] - 1]
        base = np.cumsum(ends, dtype=np.uint64) - ends
        self.pairs = EliasFano(base[pair_word] + number, file)
        self.values = Quantised(values, file)

    def find(self, word_number: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of pairs, and whether the pair is there; the value is 0 where it is not."""
        number, known = self.contexts.successor(context)
        found, out = np.zeros(len(context), bool), np.zeros(len(context))
        ask = np.flatnonzero(known)
        word, which = np.unique(word_number[ask], return_inverse=True)
        begin, end = self.begins.at(word).astype(np.int64), self.begins.at(word + 1).astype(np.int64)
        base = np.zeros(len(word), np.uint64)
        base[begin > 0] = self.pairs.at(begin[begin > 0] - 1)
        place, hit = self.pairs.successor(base[which] + number[ask].astype(np.uint64) + np.uint64(1))
        hit &= place < end[which]  # a number beyond the range may be one of the next
        found[ask[hit]] = True
        out[ask[hit]] = self.values.at(place[hit])
        return out, found
