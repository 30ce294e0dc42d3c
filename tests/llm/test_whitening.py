"""Whitening against exact arithmetic and another eigen-solver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from warraq.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def exact_fit(rows: list[list[float]]) -> tuple[list[list[int]], list[int], np.ndarray]:
    """(whole numbers, sums, covariance), the last rounded once from fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return x, s, np.array([[float(c) for c in r] for r in v])


def check(got: list, rows: dict[int, list[float]]) -> None:
    x, s, v = exact_fit(list(rows.values()))
    n, d = len(x), len(s)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == n * min(8, d) and {r.component for r in got} == set(range(1, min(8, d) + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(min(8, d)):
        want = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in x]) / n @ axes[:, k] / math.sqrt(e[k])
        mine = np.array([by[i, k + 1].whitened for i in rows])
        sign = math.copysign(1, float(want @ mine))
        assert np.abs(want * sign - mine).max() < 1e-7
        assert all(abs(by[i, k + 1].explained - e[k] / e.sum()) <= 1e-10 for i in rows)
    for i, r in zip(rows, x, strict=True):
        assert by[i, 1].n == n and by[i, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))


def test_query(spark):
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()}
    rows = {i: v for i, v in data.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    sample = dict(list(rows.items())[:40])
    df = spark.createDataFrame(list(sample.items()), "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whiten(df).collect(), sample)
    got = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert len(got) == 8 * len(rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in rows.values()])
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    first = {r.component: r.explained for r in got}
    assert all(abs(first[k + 1] - e[k] / e.sum()) < 1e-9 for k in range(8))
    off = len(x) * x - x.sum(axis=0)
    assert {r.vec_id: r.deviation for r in got} == dict(zip(rows, (off * off).sum(axis=1).tolist(), strict=True))


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=5).tolist() for i in range(30)}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]), (104, [float("inf")] * 5)]
    data = [(i, v, 1, None) for i, v in [*rows.items(), *odd]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n int, component string").repartition(7)
    check(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 100")).count() == 0


def test_no_variance(spark):
    """One vector, repeated rows and a null identifier; then one dimension that varies."""
    df = spark.createDataFrame([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [0.5, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got), key=repr) == sorted(
        [(i, k, 3, 0, None, None, None) for i in (1, 1, None) for k in (1, 2)], key=repr
    )
    df = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 3.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert got[1, 1].whitened == pytest.approx(-got[2, 1].whitened) and abs(got[1, 1].whitened) == pytest.approx(1)
    assert got[1, 2].whitened is None and (got[1, 1].explained, got[1, 2].explained) == (1.0, 0.0)


def test_vectors_of_different_lengths(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(df.coalesce(1)).collect()


@pytest.mark.parametrize("block", [1, 100, 1 << 20])
def test_moments_do_not_depend_on_the_deal(monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    x = np.random.default_rng(1).integers(99_000, 101_000, size=(200, 7))
    want = np.cov(x.T, bias=True)
    whole = whitening.add_rows(whitening.no_moments(7, np.int64), x)
    parts = [whitening.add_rows(whitening.no_moments(7, np.int64), x[a:b]) for a, b in ((0, 1), (1, 120), (120, 120), (120, 200))]
    merged = parts[0]
    for p in parts[1:]:
        merged = whitening.merge(merged, p)
    for m in (whole, merged):
        assert m.n == 200 and (m.sums == x.sum(axis=0)).all() and np.allclose(m.covariance, want, rtol=1e-12, atol=1e-6)


def test_symmetric_qr():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 64):
        for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.ones((n, n)), np.diag(np.arange(n) % 3.0), 1e6 * rng.normal(size=(n, n))):
            a = a @ a.T
            e, q = whitening.symmetric_qr(a)
            scale = max(1.0, np.abs(a).max())
            assert np.allclose(q.T @ q, np.eye(n), atol=1e-12) and np.allclose((q * e) @ q.T, a, atol=1e-12 * n * scale)
            assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * n * scale)
