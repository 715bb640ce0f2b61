"""Streaming byte-level BPE against the library."""

import hashlib
import random

import pytest

from corpusloom.llm import bpe_stream as B
from tests.llm import cases

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def merges():
    return B.MergeList.of(B.default_path(B.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.default_path(B.VOCABULARY))


def ids_of(merges, text, chunk=B.CHUNK):
    return [i for part in B.encode_stream(merges, text, chunk) for i in part]


def nasty():
    r = random.Random(5)
    parts = ["ing", "guar", "ant", "ee", "tion", "a", "e", "th", "er", "re", "guarantee"]
    return [
        "", "a", "a" * 4000, "aA" * 2500, " " * 900 + "x", "\n" * 700, " \n\t" * 300 + "b", "guarantee" * 700, "'re've'l'LL's" * 90, "<|endoftext|>" * 3 + "<|endo", "x <|endoftext|> \n", "<<|endoftext|>",
        "!" * 3000 + "'s", "漢字" * 700, "1" * 2000 + "½²", "é́" * 400, "".join(r.choice("' arse\n!1Ᲊ࢏꟎\U0001f600\x85\xa0") for _ in range(4000)),
        *("".join(r.choice(parts) for _ in range(1500)) for _ in range(4)), *(t for t in cases.texts() if t),
    ]


@pytest.mark.parametrize("chunk", [1, 3, 130, 1000, 1 << 16])
def test_ids_are_the_librarys_in_chunks_of_any_size(merges, library, chunk):
    for text in nasty():
        assert ids_of(merges, text if chunk > 3 else text[:2500], chunk) == library.encode(text if chunk > 3 else text[:2500], add_special_tokens=False).ids


def test_every_code_point(merges, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in points[at : at + 20_000])
        assert ids_of(merges, text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_suffices_and_memory_is_constant(merges):
    """Tokens of a prefix that end the lookahead before its end are those of any longer text."""
    r = random.Random(2)
    pieces = [merges.bytes_of[i] for i in range(256, 50_000) if merges.bytes_of[i].isalpha()]
    for _ in range(60):
        data = b"".join(r.choice(pieces) for _ in range(250))
        whole = merges.merge(data)
        for cut in r.sample(range(merges.lookahead, len(data)), 12):
            end = 0
            for i, j in zip(merges.merge(data[:cut]), whole):
                end += len(merges.bytes_of[i])
                if end > cut - merges.lookahead:
                    break
                assert i == j
    encoder = B.StreamEncoder(merges)
    for _ in range(300):
        encoder.feed("".join(r.choice("etaoin") for _ in range(700)))
        assert len(encoder.held) <= merges.window and len(encoder.rest) <= B.HOLD and len(encoder.tail) < 13


def test_lookahead_of_small_lists():
    assert B.sufficient_lookahead([]) == 0
    assert B.sufficient_lookahead([("a", "b")]) == 1
    # over "bc" a later rule reaches back over "a", one behind "ab" does not
    assert B.sufficient_lookahead([("b", "c"), ("a", "bc")]) == 2
    assert B.sufficient_lookahead([("a", "b"), ("ab", "c")]) == 2
    with pytest.raises(ValueError):
        B.sufficient_lookahead([("ab", "c"), ("a", "b")])


def test_small_alphabets_against_all_continuations():
    """The bound holds for short lists over two letters, by trying every prefix and continuation."""
    from itertools import product

    class Small(B.MergeList):
        def __init__(self, merges):
            tokens = ["a", "b", *(u + v for u, v in merges)]
            number = {t: i for i, t in enumerate(tokens)}
            self.start = {ord("a"): 0, ord("b"): 1}
            self.rules = {(number[u], number[v]): k << B.NEW_BITS | number[u + v] for k, (u, v) in enumerate(merges)}
            self.bytes_of = {i: t.encode() for t, i in number.items()}

    for merges in ([("a", "b"), ("b", "a"), ("ab", "a")], [("a", "a"), ("aa", "b"), ("b", "aab")], [("b", "a"), ("a", "ba"), ("aba", "b")]):
        need, small = B.sufficient_lookahead(merges), Small(merges)
        tails = ["".join(t).encode() for n in range(4) for t in product("ab", repeat=n)]
        for prefix in ("".join(p).encode() for p in product("ab", repeat=8)):
            end, final = 0, []
            for i in small.merge(prefix):
                end += len(small.bytes_of[i])
                if end <= len(prefix) - need:
                    final.append(i)
            assert all(list(small.merge(prefix + t)[: len(final)]) == final for t in tails)


def test_decoding_any_ids(merges, library):
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(50_257) for _ in range(r.randrange(60))]
        decoder = B.StreamDecoder(merges)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_query(spark, tmp_path, library):
    docs = cases.documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = B.op13_bpe_stream(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        want.append((row["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert B.round_trip(cases.empty(spark)).count() == 0
    assert sorted(map(tuple, B.round_trip(docs, chunk=100).collect()), key=str) == sorted(want, key=str)
