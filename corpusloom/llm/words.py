"""Words of texts as 64-bit hashes, in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII letters lower-cased, other ASCII but digits to blanks; other bytes belong to words.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
CACHE_WORDS = 300_000


def split_words(text: bytes) -> list[bytes]:
    """Words [0-9a-z and non-ASCII]+ of UTF-8 text with A-Z lower-cased."""
    return text.translate(_TABLE).split()


class WordHashes:
    """hashes(words) with a bounded cache."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        missing = set(words).difference(cache)
        if missing:
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = set(words)
            cache.update((w, xxhash.xxh64_intdigest(w)) for w in missing)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
