"""Token ids of whole texts through the tokenizers library, word by word with a bounded cache.

For a vocabulary whose normalizer and pre-tokenizer are KNOWN, no token crosses white space and the normalizer is local to
a word, so the ids of a text are those of its blank-separated words in order. A run of letters is one piece for the
library's model, and ASCII marks behind a letter or digit are a run of their own; if the normalizer could end a word with
anything but a letter or digit (a letter that it takes apart, say), the word goes to the library whole. Any other
vocabulary gets whole texts.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

#: Words of one generation of a Python worker's cache (about 230 bytes each). A full generation becomes the old one,
#: whose words move to the new one when they are met again; at most two generations are held.
GENERATION = 700_000
#: Longer words are not cached.
CACHE_CHARS = 64
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed: normalizer and pre-tokenizer that the word-by-word way is exact for.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters below this (Latin) that are their own lower case and NFC form need no normalizer.
PLAIN_BELOW = "ɐ"
#: White space to blanks; and A-Z to a-z as well.
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else c for b, c in enumerate(_BLANKS))

_encoders: dict[str, "WordEncoder"] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others
    in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids by word (UTF-8); a missing word is looked up in the older generation or made."""

    def __init__(self, older: dict, make):
        super().__init__({b"": b""})
        self.older, self.make = older, make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class WordEncoder:
    """encode(text) gives the ids of a text as little-endian unsigned integers of `width` bytes, 2 or 4."""

    def __init__(self, path: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_word = all(made[k] == v for k, v in KNOWN.items()) and all("<|" in t["content"] for t in made["added_tokens"])
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.generation = generation
        self.words = _Words({}, self._make)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """One encoder for each worker process and vocabulary."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _plain(self, stem: bytes) -> bool:
        """A run of letters that the normalizer leaves alone."""
        if stem.isalpha():  # ASCII
            return stem.islower()
        if stem.isascii():
            return False
        text = stem.decode("utf-8", "replace")
        return text.isalpha() and max(text) < PLAIN_BELOW and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def _make(self, word: bytes) -> bytes:
        """Ids of one word."""
        stem = word.rstrip(MARKS)
        if b"<|" not in word:  # a special token of the library
            if self._plain(stem):
                ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(stem.decode("latin-1").translate(self.letters))])
                return ids + self.words[word[len(stem) :]] if len(stem) < len(word) else ids
            if 0 < len(stem) < len(word) and stem[-1:].isalnum():
                return self.words[stem] + self.words[word[len(stem) :]]
        return self._library(word.decode("utf-8", "replace"))

    def encode(self, text: str) -> bytes:
        return self.encode_utf8(text.encode("utf-8", "replace"))

    def encode_utf8(self, data: bytes) -> bytes:
        if not self.by_word:
            return self._library(data.decode("utf-8", "replace"))
        # with a combining mark (U+0300 to U+033F) behind it a lower-case letter may compose where a capital does not
        data = data.translate(_BLANKS if b"\xcc" in data or b"<|" in data else _LOWER)
        if len(self.words) > self.generation:
            self.words = _Words(dict(self.words), self._make)
        return b"".join(map(self.words.__getitem__, data.split(b" ")))
