import io
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
import zstandard

from corpusloom.llm import packing, token_store
from corpusloom.llm.common import scratch_path
from corpusloom.llm.tokenization import WordEncoder, default_path

from .cases import documents, empty, texts, words

ODD = ["", "<|endoftext|>", "a<|startoftext|>b. C", "don't DON'T it's. x's!", "İstanbul ΣΑΣ ς. e\u0301 \u0301a  tab\tx\r\ny", "1234.5 ... a.b.c x..", "Ünï. ß! 漢字。 emoji😀!", "#$%" * 40 + " " + "ab" * 90 + ".", " .x"]


def library(text):
    return WordEncoder.of(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("generation", [5, 700_000])
def test_word_by_word_ids_are_those_of_the_library(generation):
    encoder = WordEncoder(default_path(), generation)
    assert encoder.by_word and encoder.type == "<u2"
    for text in [*ODD, *[t for t in texts() if t], *ODD]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library(text)


def test_ids_of_every_character_in_every_place_are_those_of_the_library():
    """All code points of the basic plane (and some above) behind and before letters, digits, marks and capitals."""
    encoder, plain = WordEncoder(default_path()), WordEncoder.of(default_path()).tokenizer
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + list(range(0x10000, 0x20000, 7))
    for shape in ("a{0}.", "{0}. b{0}", "A{0}Z, {0}T", "1{0}'s H{0}!", "{0}{0} 'S{0}"):
        some = [" ".join(shape.format(chr(c)) for c in points[at : at + 64]) for at in range(0, len(points), 64)]
        for text, found in zip(some, plain.encode_batch(some, add_special_tokens=False)):
            if np.frombuffer(encoder.encode(text), "<u2").tolist() != found.ids:
                bad = [hex(ord(c)) for c in text if np.frombuffer(encoder.encode(shape.format(c)), "<u2").tolist() != library(shape.format(c))]
                raise AssertionError(f"{shape}: {bad}")
    rng = np.random.default_rng(3)
    letters = list("abAB .,'\n\t19é\u0301\u0331ÿİßΣ<|>_क़\u0308şǰ")
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(1, 40))))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library(text), text
    for text in ("İ. TARİHİ, x", "H\u0331 T\u0308.", "<|ENDOFTEXT|> <|endoftext|>A", "क़. ড়, ब"):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library(text)


def test_other_vocabularies_get_whole_texts():
    encoder = WordEncoder(default_path("byte_bpe_50k.json"))
    assert not encoder.by_word
    for text in ODD:
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_file_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 60_000, n)) for i, n in enumerate([0, 3, 70, 64, 0, 1000, 1])]
    out = io.BytesIO()
    writer = token_store.TokenFileWriter(out, 2, frame_tokens=64)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.astype("<u2").tobytes())
    assert writer.close() == (7, 1138)
    data = out.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(data)

    store = token_store.TokenFile(Source(data))
    for i in (5, 0, 6, 1, 2, 3, 4):
        assert store.tokens(i).tolist() == docs[i][1].tolist()
    assert [x.tolist() for x in store.find(3)] == [docs[3][1].tolist()] and store.find(0) == []
    asked = []
    frame = store.frame
    store.frame = lambda k: asked.append(k) or frame(k)
    store.tokens(1)
    assert set(asked) == {0}  # only the frame that holds it
    plain = b"".join(d.read() for d in [zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)])
    assert plain == np.concatenate([d[1] for d in docs]).astype("<u2").tobytes()  # any decoder reads it
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_store.TokenFile(Source(bytes(broken)) if False else type("S", (io.BytesIO,), {"size": lambda self: len(broken)})(bytes(broken))).tokens(1)


def test_store_against_the_library(spark):
    path = scratch_path(spark, "tokens")
    docs = documents(spark)
    manifest = [tuple(r) for r in token_store.write_token_files(docs, path, default_path(), 2).collect()]
    got = [tuple(r) for r in token_store.read_token_files(spark, path, manifest).collect()]
    start = 0
    assert len(got) == docs.count()
    for doc_id, at, n, _ in sorted(got, key=lambda r: r[1]):  # gapless, in ascending order
        assert at == start
        start += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    want = []
    for row in docs.collect():
        ids = np.array([*library(row["text"]), 2], "<u4")
        want.append((row["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted([(r[0], *r[2:]) for r in got], key=str) == sorted(want, key=str)


def test_store_over_many_files_keeps_the_order(spark):
    docs = spark.createDataFrame([(i * 7 % 101, words(5 + i % 9, i)) for i in range(101)], "doc_id long, text string").repartition(5)
    path = scratch_path(spark, "tokens")
    manifest = [tuple(r) for r in token_store.write_token_files(docs, path, default_path(), 2, frame_tokens=50).collect()]
    rows = sorted(token_store.read_token_files(spark, path, manifest).collect())
    assert len(manifest) > 2 and [r["doc_id"] for r in rows] == list(range(101))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]


def test_store_of_an_empty_table(spark):
    path = scratch_path(spark, "tokens")
    manifest = token_store.write_token_files(empty(spark), path, default_path(), 2).collect()
    assert manifest == [] and token_store.read_token_files(spark, path, []).collect() == []


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(2)
    fit = packing.BestFit(100, open_bins=5)
    open_bins, closed, n = {}, {}, 0
    for length in rng.integers(1, 101, 3000).tolist():
        fitting = [(100 - used, -b) for b, used in open_bins.items() if used + length <= 100]
        number, offset = fit.place(length)
        if fitting:
            assert 100 - offset == min(fitting)[0] and open_bins[number] == offset  # the tightest one
        else:
            assert offset == 0 and number == n
            n += 1
        open_bins[number] = offset + length
        if open_bins[number] == 100:
            closed[number] = open_bins.pop(number)
        elif len(open_bins) > 5:
            fullest = max(open_bins.values())
            gone = [b for b in open_bins if open_bins[b] == fullest]
            left = [b for b in gone if any(b in bins for bins in fit.bins)]
            for b in set(gone) - set(left):
                closed[b] = open_bins.pop(b)
        assert len(open_bins) == fit.n_open <= 5
    with pytest.raises(ValueError):
        fit.place(0)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_whole_and_gapless(spark):
    docs = documents(spark)
    rows = packing.pack_documents(docs).collect()
    check_packing(rows, 2048)
    want = []
    for row in docs.collect():
        ids = np.array([*library(row["text"]), 0], "<u4")
        want += [(row["doc_id"], p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    assert packing.pack_documents(empty(spark)).collect() == []


def test_packing_is_tight(spark):
    docs = spark.createDataFrame([(i, words(20 + i * 37 % 900, i)) for i in range(300)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert check_packing(rows, 2048) <= 1.05 * sum(r["length"] for r in rows) / 2048 + 1


def test_paths_are_resolved_as_spark_does(spark, tmp_path, monkeypatch):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert token_store.qualified(spark, f"file:{tmp_path}/a") == f"file:{tmp_path}/a"
    try:
        conf.set("fs.defaultFS", "file:///")
        assert token_store.qualified(spark, f"{tmp_path}/a") == f"file:{tmp_path}/a"
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./data", f"file:{tmp_path}")
        assert token_store.qualified(spark, "/data/a") == "viewfs://cluster/data/a"  # not a folder of this machine
        with pytest.raises(ValueError, match="token files cannot be kept"):
            token_store._filesystem(token_store.qualified(spark, "/data/a"))
        assert token_store._filesystem(token_store.qualified(spark, f"file:{tmp_path}/a"))[1] == f"{tmp_path}/a"
    finally:
        conf.set("fs.defaultFS", before)
    monkeypatch.setattr(token_store, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: uri)))
    assert token_store._filesystem("s3a://bucket/a") == "s3://bucket/a"
