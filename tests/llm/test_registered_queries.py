"""The registered queries themselves, over awkward documents, against plain versions of their contracts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corpusloom.llm import queries
from corpusloom.llm.tokenization import default_path
from tests.llm import cases

tokenizers = pytest.importorskip("tokenizers")
OPS = queries.queries()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("registered"))
    docs = cases.documents(spark)
    docs.write.parquet(f"{at}/documents.parquet")
    item = " ".join(cases.words(120, 2).split()[30:60])
    spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, cases.words(40, 99), "x")], "item_id long, text string, doc_id string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(17)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def library():
    return tokenizers.Tokenizer.from_file(default_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folder):
    at, docs = folder
    out = OPS["op1_token_store"](spark, at)
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = [tuple(r)[:4] for r in out.orderBy("start").collect()]
    encoded = [(i, [*library().encode(t, add_special_tokens=False).ids, 2]) for i, t in docs]
    assert sorted(((i, n, c) for i, _, n, c in got), key=str) == sorted(((i, len(x), crc(x)) for i, x in encoded), key=str)
    starts = np.cumsum([0, *(r[2] for r in got)])
    assert [r[1] for r in got] == starts[:-1].tolist()
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known)


def test_op9(spark, folder):
    at, docs = folder
    rows = OPS["op9_best_fit_packing"](spark, at).collect()
    want = []
    for i, t in docs:
        ids = [*library().encode(t, add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 2048


def test_op3(spark, folder):
    at, docs = folder
    fingerprints = {}
    for i, t in docs:
        words = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        fingerprints.setdefault(i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    out = OPS["op3_simhash_near_dedup"](spark, at)
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    got = {r["doc_id"]: r for r in out.collect()}
    ids = [i for i in fingerprints if i is not None]
    assert all(got[i]["fingerprint"] == f"{fingerprints[i]:016x}" for i in ids)
    group = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    assert {i: got[i]["component_id"] for i in ids} == group


def test_op5(spark, folder):
    at, _ = folder
    out = OPS["op5_decontamination"](spark, at)
    assert "doc_id" in out.columns
    assert {5, 6, 7} <= {r["doc_id"] for r in out.collect()} <= {5, 6, 7}


def test_op10(spark, folder):
    at, docs = folder
    out = OPS["op10_toxicity"](spark, at)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(i) for i, _ in docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("name", ["op1_token_store", "op3_simhash_near_dedup", "op5_decontamination", "op6_quality_rules", "op8_line_dedup", "op9_best_fit_packing", "op10_toxicity", "op12_phrase_collocations", "op13_bpe_stream", "pipeline"])
def test_empty_tables(spark, folder, tmp_path, name):
    at, _ = folder
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{at}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert OPS[name](spark, str(tmp_path)).count() == 0
