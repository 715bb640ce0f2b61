import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.components import components
from corpusloom.llm.cuckoo import CuckooFilter
from corpusloom.llm.line_dedup import LineDedup, build_filters, count_references, dedup_lines, lines_of, op8_line_dedup, reference_state

from .cases import documents, empty, texts, words


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint():
    for t in texts():
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    for errors in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, errors, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        keys = [defaultdict(set), defaultdict(set)]
        for own, v in zip(keys, (x, y)):
            for k, i in zip(*(a.tolist() for a in simhash.golay_keys(v))):
                own[i].add(k)
        assert all(keys[0][i] & keys[1][i] for i in range(len(x)))


def near_set(seed, n=300):
    """Fingerprints in a dense ball, in chains, and far apart."""
    rng = np.random.default_rng(seed)
    flip = lambda v, k: v ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    centre = int(rng.integers(1 << 62))
    out = {flip(centre, int(rng.integers(0, 4))) for _ in range(n)} | {int(rng.integers(1 << 62)) for _ in range(n)} | {0}
    chain = centre ^ (1 << 63)
    for _ in range(20):
        chain = flip(chain, 4)
        out.add(chain)
    return out


@pytest.mark.parametrize("block", [7, 20_000])
def test_links_connect_what_brute_force_connects(spark, block):
    fps = near_set(4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots, _ = components(simhash.golay_links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block))
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in roots.collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({f: found.get(f, f) for f in fps}) == groups(plain_components(fps))


def test_near_duplicates(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = {plain_fingerprint(r["text"]) for r in rows}
    root = plain_components(fps)
    least = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None:
            least[root[plain_fingerprint(r["text"])]].append(r["doc_id"])
    want = Counter((r["doc_id"], plain_fingerprint(r["text"]), min(least[root[plain_fingerprint(r["text"])]], default=None)) for r in rows)
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (500, 400)]
    roots, _ = components(spark.createDataFrame(edges, "u long, v long"))
    want = {**{i: 0 for i in range(1, 41)}, **{101 + i: 100 for i in range(30)}, 500: 400}
    assert {r["node"]: r["root"] for r in roots.collect()} == want


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    low, high = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
    f = CuckooFilter.of(low[:4000], high[:4000])
    assert f.contains(low[:4000], high[:4000]).all()
    assert f.contains(low[4000:], high[4000:]).mean() < 0.01
    f.remove_all(low[:2000], high[:2000])
    assert f.contains(low[2000:4000], high[2000:4000]).all() and f.contains(low[:2000], high[:2000]).mean() < 0.01
    assert (CuckooFilter.from_bytes(f.to_bytes()).table == f.table).all()
    small = CuckooFilter(1)
    some = [small.add_all(low[i : i + 1], high[i : i + 1]) for i in range(6)]
    assert not all(some)
    assert all(small.contains(low[i : i + 1], high[i : i + 1])[0] for i, ok in enumerate(some) if ok)  # a failed add loses nothing


def plain_lines(rows, min_chars=20, min_docs=3):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).encode().lower().decode()
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                held[key(line)].add(doc_id)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or keeper.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in op8_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=str)
    assert got == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(r[2] for r in got)
    refs, filters, shards, _ = reference_state(docs)
    clean = dedup_lines(docs, refs, filters, shards)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert [r["text"] for r in clean.where("doc_id = 0").collect()] == [None]
    refs, filters, shards, _ = reference_state(empty(spark))
    assert dedup_lines(empty(spark), refs, filters, shards).collect() == []


def test_insertions_and_deletions_are_reversible(spark):
    shared = [f"shared line number {i} of the corpus" for i in range(6)]
    rows = [(i, "\n".join([shared[i % 6], shared[(i + 1) % 6], words(8, i)])) for i in range(12)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    state = LineDedup(spark, shard_keys=3).insert(frame(rows[:8]))
    facts = lambda s: (sorted(map(tuple, s.refs.select("k1", "k2", "n_docs", "keeper").collect())), sum(r["n_keys"] for r in s.filters.collect()))
    before = facts(state)
    state.insert(frame(rows[8:]))
    assert facts(state) == facts(LineDedup(spark, shard_keys=3).insert(frame(rows)))
    state.insert(frame(rows[8:]))  # known documents count once
    state.delete(frame(rows[8:]))
    assert facts(state) == before
    cleaned = {r["doc_id"]: r["text"] for r in state.clean(frame(rows[:8])).collect()}
    fresh = count_references(lines_of(frame(rows[:8])))
    assert cleaned == {r["doc_id"]: r["text"] for r in dedup_lines(frame(rows[:8]), fresh, build_filters(fresh, 2), 2).collect()}


def test_line_dedup_as_its_sql_says_with_null_and_repeated_ids(spark, tmp_path):
    import duckdb

    from corpusloom.llm import line_dedup

    line, other = "a line that three documents share", "another line that only two documents share"
    rows = [(1, f"{line}\nx"), (2, f"y\n{line}"), (None, line), (None, f"{line}\n{other}"), (4, other), (5, f"{other}\n{line.upper()} "), (5, f"{line}\nz"), (6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(line_dedup.SQL["op8_line_dedup"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in op8_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)
    assert sum(r[2] for r in got) == 2


def test_lines_sent_to_their_shards_lose_the_same(spark, monkeypatch):
    from corpusloom.llm import line_dedup

    rows = [(d, "\n".join([f"shared line number {k} of the whole corpus" for k in range(300) if (d * 7 + k) % 5 < 3] + ["a line of all the documents that there are", f"only in document number {d}"])) for d in range(40)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lost_id int, Lost_Lines int")
    refs = count_references(lines_of(docs)).cache()
    want = plain_lines(rows)
    for filter_bytes, hot_share in ((1 << 30, 2000), (0, 2000), (0, 20)):
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", filter_bytes)
        monkeypatch.setattr(line_dedup, "HOT_SHARE", hot_share)
        clean = dedup_lines(docs, refs, build_filters(refs, 16), 16)
        assert clean.columns == docs.columns
        assert sorted([(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in clean.collect()], key=str) == sorted([(w[0], w[3]) for w in want], key=str)
    # what passes a shard's filter: all held lines, few others
    filters = build_filters(refs, 16)
    passed = line_dedup.screen_by_shard(lines_of(docs), filters, 16)
    assert passed.join(refs.where("n_docs >= 3"), ["k1", "k2"]).count() == lines_of(docs).join(refs.where("n_docs >= 3"), ["k1", "k2"]).count()
    assert passed.join(refs.where("n_docs < 3"), ["k1", "k2"]).count() <= 4


def test_shards_grow_with_the_keys(spark):
    frame = lambda ids: spark.createDataFrame([(d, "\n".join(f"line number {k} of {d // 10} in the corpus" for k in range(60))) for d in ids], "doc_id long, text string")
    state = LineDedup(spark, shard_keys=20).insert(frame(range(10)))
    assert state.shards == 3
    state.insert(frame(range(10, 40)))
    assert state.shards == 12 and state.filters.count() == 12
    whole, refs = frame(range(40)), count_references(lines_of(frame(range(40))))
    assert {tuple(r) for r in state.clean(whole).collect()} == {tuple(r) for r in dedup_lines(whole, refs, build_filters(refs, 2), 2).collect()}
