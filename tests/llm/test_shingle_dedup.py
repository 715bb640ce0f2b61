from itertools import combinations

import numpy as np

import corpus_pipeline as P
from corpusloom.llm import shingle_dedup as S
from corpusloom.llm import simhash

from .cases import documents, words


def edited():
    """(doc_id, text): texts with a run of words replaced, similarity 0.7 to 0.99, and chains."""
    out = []
    for group in range(30):
        base = words(200, 1000 + group).split()
        out.append((group * 10, " ".join(base)))
        for k, n in enumerate((2, 10, 16, 21, 24, 34), 1):
            out.append((group * 10 + k, " ".join(base[: 5 * k] + words(n, 2000 + group * 10 + k).split() + base[5 * k + n :])))
    return out


def brute(rows):
    """The least id of each component of pairs with 5-word Jaccard similarity of 0.8 or more."""
    def grams(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [(i, grams(t or "")) for i, t in rows], {i: i for i, _ in rows}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if not a and not b or 5 * len(a & b) >= 4 * len(a | b) > 0:
            i2, j2 = of(i), of(j)
            root[max(i2, j2)] = min(i2, j2)
    return {i: of(i) for i, _ in rows}


def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_soft_decoding_finds_the_best_codewords():
    rng = np.random.default_rng(1)
    words_ = [0]
    for bit in range(12):
        words_ += [w ^ simhash.GOLAY << bit for w in words_]
    assert len(set(words_)) == 4096 and min(w.bit_count() for w in words_ if w) == 7
    signs = np.array([[1 if w >> k & 1 else -1 for k in range(23)] for w in words_])
    sums = rng.normal(size=(50, 23)).astype(np.float32)
    got = S.soft_indices(sums)
    assert len({tuple(sorted(x)) for x in got.tolist()}) == 50 and got.min() >= 0 and got.max() < 4096
    own = {}  # the number of each codeword, by decoding it
    for number, vector in zip(S.soft_indices(signs.astype(np.float32) + rng.normal(0, 1e-3, signs.shape).astype(np.float32)), signs):
        own.setdefault(tuple(vector), number)
    for row, numbers in zip(sums, got):
        best = np.argsort(-(signs @ row))[: S.NEAR]
        assert all(len(set(own[tuple(signs[b])].tolist()) & set(numbers.tolist())) for b in best)


def test_recall_at_the_least_similarity():
    """Of random pairs whose sums correlate as those of sets with similarity 0.8 the keys find 0.95, and the bits keep 0.99."""
    rng = np.random.default_rng(2)
    for similarity, least in ((0.8, 0.95), (0.9, 0.99)):
        a = 2 * similarity / (1 + similarity)
        x = rng.normal(size=(3000, 128)).astype(np.float32)
        y = (a * x + np.sqrt(1 - a * a) * rng.normal(size=x.shape)).astype(np.float32)
        kx, ky = S.golay_keys(x), S.golay_keys(y)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(kx, ky)]) >= least
        assert np.mean(((x > 0) != (y > 0)).sum(axis=1) <= S.MOST_BITS) >= 0.99


def test_stage_drops_edited_copies(spark):
    rows = edited()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()}
    right = set(want.values())
    assert right <= got and len(got - right) <= 0.05 * (len(rows) - len(right))  # a pair at 0.8 may be missed
    assert 30 < len(right) < len(rows)


def test_one_row_of_each_group_stays(spark):
    a, b, c = words(90, 1), words(90, 2), words(90, 3)
    rows = [(1, a, 1), (1, b, 2), (None, a, 3), (None, c, 4), (None, c, 5), (7, c + " x", 6), (8, b, 7), (1, a, 8), (9, None, 9), (10, " \n", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(tuple(r) for r in got.select("doc_id", "text").collect())
    assert kept == sorted([(1, a), (1, b), (7, c + " x"), (9, None)]) and {r["row"] for r in got.collect()} <= {1, 8, 2, 6, 9}
    assert P.near_dedup(spark, docs.limit(0), "").collect() == []


def test_components_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).where("doc_id is not null").select("doc_id", "text").distinct().collect()]
    rows += [(1000 + i, t) for i, t in edited()[:70]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = brute(rows), {i: grams(t) for i, t in rows}
    for block in (4000, 3):
        got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(docs, block).collect()}
        linked = [(i, j) for i, j in combinations(sets, 2) if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
        assert all(want[i] == want[got[i]] for i in got)  # nothing but similar pairs connects
        assert np.mean([got[i] == got[j] for i, j in linked]) >= 0.95
        assert all(got[i] == got[j] for i, j in linked if sets[i] == sets[j])
    assert S.similar_documents(docs.limit(0)).count() == 0
