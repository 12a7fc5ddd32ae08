"""Token ids of texts, with the ids of words remembered per worker.

White space never joins what stands on its two sides, so the ids of a text are
those of its white-space-free parts in a row. A part that was seen before is one
dictionary lookup; the dictionary is emptied when it has grown to
``REMEMBERED`` parts, which changes time only.
"""

from __future__ import annotations

import re

import numpy as np

from newsgraph.llm.words import worker_cache

REMEMBERED = 400_000
LONGEST = 48
ID_BYTES = 4
# A letters-only part keeps its ids when one of these follows it.
_TAIL = ".,!?;:#*$%&"
# Letters before this are composed already and have the same lower case everywhere.
_LATIN_END = "\u0250"
# Python splits at these, the tokenizer does not.
_ODD_SPACES = re.compile("[\x1c-\x1f]")


class WordIds(dict):
    """Little-endian unsigned 32-bit ids by part, found by the tokenizer when missing.

    ``encode`` takes any text; ``spell`` takes lower-case Latin letters, which
    need no normalising and are one word to the tokenizer.
    """

    def __init__(self, encode, spell):
        self.encode, self.spell = encode, spell

    def __missing__(self, part: str) -> bytes:
        core = part.rstrip(_TAIL)
        if core and core.isalpha() and max(core) < _LATIN_END:
            low, tail = core.lower(), part[len(core) :]
            if not low.isalpha():  # a lower case with a mark that would join what follows
                ids = self.encode(part)
            elif low == part:
                ids = self.spell(part)
            else:
                ids = self[low] + (self[tail] if tail else b"")
        else:
            ids = self.encode(part)
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids


def _shown_bytes() -> dict[int, int]:
    """The character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


def text_encoder(path: str, plain_specials: bool):
    """A function from a text to the bytes of its ids.

    ``plain_specials`` reads the strings of special tokens as ordinary text.
    """
    key = ("encoder", path, plain_specials)
    cache = worker_cache()
    if key not in cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain_specials

        def encode(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        shown = _shown_bytes()

        def spell(word: str) -> bytes:
            mapped = word.encode().decode("latin-1").translate(shown)
            return np.array([t.id for t in tokenizer.model.tokenize(mapped)], "<u4").tobytes()

        words = ["the", "étéñß", "xylophonist", "q"]
        word_ids = WordIds(encode, spell if all(spell(w) == encode(w) for w in words) else encode)

        def whole(text: str) -> bytes:
            if _ODD_SPACES.search(text):
                return encode(text)
            return b"".join(map(word_ids.__getitem__, text.split()))

        cache[key] = whole
    return cache[key]
