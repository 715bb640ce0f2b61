"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding by a byte-to-text state machine.

A text goes through three machines, each of which holds a bounded tail: one finds added tokens, one cuts the pre-tokenizer's
pieces (a run of letters, digits, marks or white space may go on over any number of chunks), one merges the bytes of a
piece. The last one uses the merge list's sufficient lookahead: what the list makes of a prefix is final for all tokens that
end at least so many bytes before the prefix's end, whatever follows (`sufficient_lookahead`).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, strings, table, with_schema
from .tokenization import _byte_letters, default_path

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a text that are fed at once, and pieces of one generation of a worker's cache (about 250 bytes each).
CHUNK, GENERATION, CACHE_CHARS = 1 << 16, 300_000, 64
#: A piece of more characters at the end of a chunk is handed on before its end is known.
HOLD = 128
#: A rule is its rank in the high bits and the new token in the low ones.
NEW_BITS = 24
NEW, NO_RULE = (1 << NEW_BITS) - 1, 1 << 62
#: Fixed: the byte-level pre-tokenizer's pieces.
PIECES = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Runs of one class: letters, digits, white space, marks.
RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s*"), "P": regex.compile(r"[^\s\p{L}\p{N}]*")}

_loaded: dict[str, "MergeList"] = {}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes behind a token of a prefix's encoding that make it final.

    Let two texts share a prefix, and let d be the last place up to which their tokens agree. Merging by rank, d first is
    the prefix's end, and only a rule (u, v) that merges over d in one text alone moves it, to d - |u|. The tokens at d
    then have u as their leftmost part, so the next rule (u', v') that moves d has a higher rank and u on the left spine
    of v'. Hence no text moves d further back than the heaviest chain of such rules, each weighing |u|.
    """
    left: dict[str, str] = {}
    heaviest: dict[str, int] = {}
    most = 0
    for u, v in merges:
        if any(len(x) > 1 and x not in left for x in (u, v)) or u + v in left:
            raise ValueError(f"the merge list is not in order at {u!r} {v!r}")
        behind, at = 0, v
        while at is not None:
            behind = max(behind, heaviest.get(at, 0))
            at = left.get(at)
        heaviest[u] = max(heaviest.get(u, 0), len(u) + behind)
        most = max(most, heaviest[u])
        left[u + v] = u
    return most


class _Cache(dict):
    """Ids by piece; a missing one is looked up in the older generation or merged."""

    def __init__(self, older: dict, make):
        super().__init__()
        self.older, self.make = older, make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece.encode())
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class MergeList:
    """A byte-level vocabulary with its merges by rank and its lookahead."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        made = json.loads(library.to_str())
        model, before = made["model"], made["pre_tokenizer"] or {}
        plain = not made["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path} is not a plain byte-level merge list")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        byte_of = {ord(c): b for b, c in _byte_letters().items()}
        raw = lambda token: bytes(byte_of[ord(c)] for c in token) if all(ord(c) in byte_of for c in token) else token.encode()
        self.start = [vocab[c] for _, c in sorted(_byte_letters().items())]
        self.rules = {(vocab[u], vocab[v]): rank << NEW_BITS | vocab[u + v] for rank, (u, v) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in (vocab | self.added).items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.lookahead = sufficient_lookahead(merges)
        self.window = 3 * self.lookahead + 2 * max(map(len, self.bytes_of.values()))
        self.cached = _Cache({}, self.merge)
        self._library = library

    @classmethod
    def of(cls, path: str) -> "MergeList":
        """One for each worker process and vocabulary."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    @cached_property
    def newer(self) -> dict[int, str]:
        """Letters and digits of the regex module that the library, of an older Unicode, takes for marks; to a mark."""
        split = self._library.pre_tokenizer.pre_tokenize_str
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        unsure = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN"]
        return {ord(c): "\ufffd" for c in unsure if len(split("a" + c)) > 1 and len(split("1" + c)) > 1}

    @cached_property
    def newer_set(self) -> frozenset[str]:
        return frozenset(map(chr, self.newer))

    def view(self, text: str) -> str:
        """The text as the patterns are to see it: each character of the library's class."""
        return text if text.isascii() or self.newer_set.isdisjoint(text) else text.translate(self.newer)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The tokens of a piece: the pair of the lowest rank first, the leftmost of equal ones."""
        ids, get = [self.start[b] for b in data], self.rules.get
        if len(ids) > 256:
            return self._merge_long(ids)
        found = [get(p, NO_RULE) for p in zip(ids, ids[1:])]
        while found and (rule := min(found)) != NO_RULE:
            i = found.index(rule)
            ids[i : i + 2] = [rule & NEW]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NO_RULE)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NO_RULE)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same by a heap of pairs over a linked list of tokens."""
        rules, n = self.rules, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1]), NO_RULE)) != NO_RULE]
        heapq.heapify(heap)
        while heap:
            rule, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rules.get((ids[i], ids[j])) != rule:
                continue
            ids[i], ids[j] = rule & NEW, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (ids[i], ids[k]) in rules:
                    heapq.heappush(heap, (rules[ids[i], ids[k]], i))
            if (h := before[i]) >= 0 and (ids[h], ids[i]) in rules:
                heapq.heappush(heap, (rules[ids[h], ids[i]], h))
        return tuple(x for x in ids if x >= 0)


class StreamEncoder:
    """feed(text) gives the ids that are final by then, finish() the others. Holds at most the start of an added token, HOLD
    characters of pieces and one window of bytes, however long the text or a piece of it is."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.tail = self.rest = ""
        self.run: str | None = None
        self.held = b""
        self.added = regex.compile("|".join(map(regex.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None

    def feed(self, text: str) -> list[int]:
        return self._text(self.tail + text, False)

    def finish(self, text: str = "") -> list[int]:
        """The ids of the rest, with the text's last chunk."""
        return self._text(self.tail + text, True)

    def _text(self, text: str, last: bool) -> list[int]:
        ids, at = [], 0
        if self.added is not None:
            for m in self.added.finditer(text):
                self._scan(text[at : m.start()], True, ids)
                ids.append(self.merges.added[m.group()])
                at = m.end()
        keep = 0
        if not last:
            for token in self.merges.added:
                keep = max(keep, next((n for n in range(min(len(token) - 1, len(text) - at), 0, -1) if text.endswith(token[:n])), 0))
        self.tail = text[len(text) - keep :] if keep else ""
        self._scan(text[at : len(text) - keep], last, ids)
        return ids

    def _scan(self, text: str, last: bool, ids: list[int]) -> None:
        """Cut pieces; the text ends here if last, as before an added token."""
        merges, s, at = self.merges, self.rest + text, 0
        seen = merges.view(s)
        self.rest = ""
        if len(merges.cached) > GENERATION:
            merges.cached = _Cache(dict(merges.cached), merges.merge)
        if self.run is not None:
            end = RUNS[self.run].match(seen).end()
            if end == len(s) and not last:
                keep = int(self.run == "S")  # the last blank may belong to the next piece
                self._bytes(s[: end - keep], False, ids)
                self.rest = s[end - keep :]
                return
            if self.run == "S" and end < len(s):
                end -= 1
            self._bytes(s[:end], True, ids)
            self.run, at = None, end
        pieces, n = PIECES.findall(seen, at), len(s)
        end = n
        # "'" and "r" may become "'re"; other pieces end where the next character is known
        while not last and pieces and not (end <= n - 3 or (end < n and len(pieces[-1]) > 3)):
            end -= len(pieces.pop())
        if seen is not s:
            ends = [*accumulate(map(len, pieces), initial=at)]
            pieces = [s[a:b] for a, b in zip(ends, ends[1:])]
        ids.extend(chain.from_iterable(map(merges.cached.__getitem__, pieces)))
        at = end
        if n - at > HOLD and not last:  # one piece up to the end
            self.run = next(k for k in "LNSP" if RUNS[k].match(seen, n - 1).end() == n)
            keep = int(self.run == "S")
            self._bytes(s[at : n - keep], False, ids)
            at = n - keep
        self.rest = s[at:]

    def _bytes(self, part: str, last: bool, ids: list[int]) -> None:
        """Bytes of an open piece: tokens that end the lookahead before the window's end are final."""
        merges, data, at = self.merges, self.held + part.encode(), 0
        while len(data) - at > merges.window:
            end, final = 0, merges.window - merges.lookahead
            for i in merges.merge(data[at : at + merges.window]):
                size = len(merges.bytes_of[i])
                if end + size > final:
                    break
                ids.append(i)
                end += size
            at += end
        self.held = data[at:]
        if last:
            ids.extend(merges.merge(self.held))
            self.held = b""


class StreamDecoder:
    """feed(ids) gives the text whose bytes are complete, finish() what is left; bytes that are no UTF-8 become U+FFFD. Holds
    three bytes at most. Unknown ids are nothing."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        get = self.bytes_of.get
        return self.machine.decode(b"".join([get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def encode_stream(merges: MergeList, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
    """The ids of a text, in lists as they become final."""
    encoder = StreamEncoder(merges)
    for at in range(0, len(text) - chunk, chunk):
        yield encoder.feed(text[at : at + chunk])
    yield encoder.finish(text[max(0, (len(text) - 1) // chunk) * chunk :])


def round_trip(docs: DataFrame, tokenizer: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document (doc_id, text), encoded and decoded chunk by chunk.
    Null texts are empty: no ids, the digests of nothing. Repeated rows and null doc_ids give rows of their own, an empty
    table none; other columns are left out."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = MergeList.of(path)
        names = merges.text_of
        for batch in batches:
            counts, ids_sums, text_sums = [], [], []
            for text in strings(batch, "text"):
                decoder, of_ids, of_text, n = StreamDecoder(merges), hashlib.sha256(), hashlib.sha256(), 0
                for ids in encode_stream(merges, text, chunk):
                    if ids:
                        listed = ",".join([names[i] for i in ids])
                        of_ids.update(f",{listed}".encode() if n else listed.encode())
                        of_text.update(decoder.feed(ids).encode())
                        n += len(ids)
                of_text.update(decoder.finish().encode())
                counts.append(n)
                ids_sums.append(of_ids.hexdigest())
                text_sums.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_schema(docs, "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe_stream(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the transducers; nulls, empty texts, repeats and empty tables as in round_trip."""
    return round_trip(table(spark, sf_dir, "documents"))
