"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from corpusloom.llm import whitening as W


def dense(vectors, k):
    """(n, deviation, whitened, explained) of quantized rows by a dense eigendecomposition."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ q / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(out, ids, vectors, k):
    n, deviation, whitened, explained = dense(vectors, k)
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(got) == len(ids) * k
    signs = np.sign([sum(got[i, c]["whitened"] * whitened[j, c - 1] for j, i in enumerate(ids)) for c in range(1, k + 1)])
    for j, i in enumerate(ids):
        for c in range(1, k + 1):
            r = got[i, c]
            assert (r["n"], r["deviation"]) == (n, deviation[j])
            assert r["whitened"] == pytest.approx(signs[c - 1] * whitened[j, c - 1], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9) and r["identity_error"] < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string, dim string")


def test_equals_the_dense_form_with_copies(spark):
    r = np.random.default_rng(1)
    vectors = r.standard_normal((80, 24)) * np.linspace(3, 0.4, 24)
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 60, axis=0)])
    rows = [(i, v.tolist(), 0, "x", "d") for i, v in enumerate(vectors)]
    check(W.whiten_embeddings(frame(spark, rows)), range(len(rows)), vectors, 16)


def test_a_block_narrower_than_the_vectors_iterates(spark):
    r = np.random.default_rng(2)
    vectors = r.standard_normal((120, 40)) * np.geomspace(40, 0.5, 40)
    rows = frame(spark, [(i, v.tolist(), 0, None, None) for i, v in enumerate(vectors)])
    fit = W.quantize(rows.select("vec_id", "embedding")).select("dim", "x").distinct()
    found = W.fit_whitening(fit, 40, k=5, guard=6)
    assert found.passes > 3
    values = dense(vectors, 5)[3]
    assert found.eigenvalues / found.trace == pytest.approx(values, rel=1e-9) and found.identity_error < 1e-9
    with pytest.raises(ValueError, match="residuals"):
        W.fit_whitening(fit, 40, k=5, guard=6, max_passes=2)
    check(W.whiten_embeddings(rows, k=5, guard=6), range(120), vectors, 5)


def test_tied_eigenvalues_and_low_rank(spark):
    """Four directions of equal variance, the others without any: four components, orthonormal whatever their basis."""
    vectors = [np.eye(20)[i % 4] * (2.0 if i < 4 else -2.0) for i in range(8)]
    out = W.whiten_embeddings(frame(spark, [(i, v.tolist(), 0, None, None) for i, v in enumerate(vectors)])).toPandas()
    assert sorted(set(out.component)) == [1, 2, 3, 4] and out.identity_error.max() < 1e-12
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.T @ w / 8 == pytest.approx(np.eye(4), abs=1e-9) and out.explained.unique() == pytest.approx([0.25] * len(out.explained.unique()))


def test_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [[0.1 * i, -0.3 * i * i, 1.0] for i in range(5)]
    rows = [(i, v, 0, None, None) for i, v in enumerate(good)] + [(None, good[2], 1, "x", "d"), (2, good[2], 1, "x", "d")]
    rows += [(10, None, 0, None, None), (11, [1.0, None, 2.0], 0, None, None), (12, [nan, 1.0, 1.0], 0, None, None), (13, [inf, 1.0, 1.0], 0, None, None), (14, [], 0, None, None)]
    rows += [(20, [1.0, 2.0], 0, None, None), (21, [2.0, 5.0], 0, None, None), (30, [7.0], 0, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = W.op11_embedding_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    # the third entry never varies; two vectors of length two span one direction; a single vector none
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted([(str(i), c, 5) for i in (0, 1, 2, 2, 3, 4, None) for c in (1, 2)] + [("20", 1, 2), ("21", 1, 2)])
    assert len({r["whitened"] for r in got if r["vec_id"] in (2, None) and r["component"] == 1}) == 1
    assert W.whiten_embeddings(frame(spark, [])).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 2.0**55
    rows = frame(spark, [(1, [big, 0.5], 0, None, None), (2, [-big, 0.25], 0, None, None), (3, [3e300, 1.0], 0, None, None), (4, [0.0, 0.0], 0, None, None)])
    x = {1: ((1 << 61) + 1_000_000, 1_000_032), 2: (-(1 << 61) + 1_000_000, 1_000_016), 3: ((1 << 61) + 1_000_000, 1_000_064), 4: (1_000_000, 1_000_000)}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    fit = W.quantize(rows.select("vec_id", "embedding")).select("dim", "x").distinct()
    assert W._sums(fit, 2) == sums
    assert {r["deviation"] for r in W.whiten_embeddings(rows).collect()} == {None}  # 64 bits cannot hold them
    assert W._deviation(np.array([[3, 4], [1 << 31, 1 << 31]], dtype=object)) == [25, None]
