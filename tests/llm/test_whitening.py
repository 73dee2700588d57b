import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlens.llm import whitening
from reachlens.llm.whitening import Whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, *vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors], schema)


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]


def check(df, rule=Whitening(), tolerance=1e-9, least=1e-9):
    """Against whole-number sums in Python and the eigenvectors of the exact covariance in doubles."""
    rows = usable([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()])
    found = whitening.whiten(df, rule).collect()
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in rows]
    n, size = len(x), len(x[0])
    sums = [sum(column) for column in zip(*x)]
    y = [[n * a - s for a, s in zip(row, sums)] for row in x]
    v = np.array([[float(Fraction(sum(row[i] * row[j] for row in y), n**3)) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(rule.components, size)
    assert len(found) == n * kept and {r.n for r in found} == {n}
    deviations = sorted((i is None, i or 0, sum(a * a for a in row)) for (i, _), row in zip(rows, y))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in found if r.component == 1) == [
        (a, b, d if d < 1 << 63 else None) for a, b, d in deviations
    ]
    centred = np.array([[float(Fraction(a, n)) for a in row] for row in y])
    for k in range(kept):
        own = [r for r in found if r.component == k + 1]
        if values[k] <= least * values.sum():
            assert all(r.whitened is None for r in own)
            continue
        assert own[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        expected = centred @ vectors[:, k] / math.sqrt(values[k])
        by_id = {}
        for (i, _), w in zip(rows, expected):
            by_id.setdefault(i, []).append(w)
        got = {}
        for r in own:
            got.setdefault(r.vec_id, []).append(r.whitened)
        sign = np.sign(sum(a * b for i in got for a, b in zip(sorted(got[i]), sorted(by_id[i])) if len(got[i]) == 1)) or 1
        for i, w in got.items():
            assert sorted(w) == pytest.approx(sorted(sign * e for e in by_id[i]), abs=tolerance)
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and (errors == {None} or errors.pop() < 1e-9)
    return found


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/embeddings.parquet"))


def test_same_however_rows_are_dealt(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    one, other = (whitening.fit(whitening.usable_vectors(d, Whitening(), "vec_id", "embedding"), Whitening()) for d in (df.coalesce(1), df.repartition(7)))
    assert one.found.sums == other.found.sums and (one.directions == other.directions).all() and (one.values == other.values).all()


def test_odd_rows(spark):
    chance = np.random.default_rng(3)
    good = [(i, chance.normal(size=3).tolist()) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    ties = [(None, [0.5, 0.5, 0.5]), (7, [0.25, 1.0, 2.0]), (7, [0.25, 1.0, 2.0]), (200, [0.0, 0.0, 0.0])]
    df = frame(spark, *good, *odd[:5], *ties).select("*", *[F.lit(1).alias(c) for c in ("vector", "component", "n", "i", "upper")])
    check(df)
    found = whitening.whiten(frame(spark, *good, *odd))
    assert {r.vec_id for r in found.collect()} == set(range(30))


def test_rows_without_variance(spark):
    found = whitening.whiten(frame(spark, (1, [0.5, 2.0]), (2, [0.5, 2.0]))).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [(0, None, None, None)] * 4
    check(frame(spark, (1, [0.5, 2.0, 7.0]), (2, [0.5, 3.0, 9.0]), (3, [0.5, 1.0, -4.0])))


def test_large_entries(spark):
    """Sums beyond 64 bits stay exact; a deviation that no long holds is null."""
    chance = np.random.default_rng(4)
    rows = [(i, (chance.normal(size=4) * 10.0 ** chance.integers(0, 9, 4)).tolist()) for i in range(40)]
    check(frame(spark, *rows), tolerance=1e-6, least=1e-14)
    rows = [(i, (chance.normal(size=3) * 1e15).tolist()) for i in range(20)]
    assert {r.deviation for r in check(frame(spark, *rows), tolerance=1e-6)} == {None}
    assert whitening.whiten(frame(spark, (1, [3e38]))).collect() == []


def test_empty_table(spark):
    assert whitening.whiten(frame(spark)).collect() == []


def orthogonal(size, seed):
    q = np.random.default_rng(seed).normal(size=(size, size)).astype(np.longdouble)
    for _ in range(2):
        for k in range(size):
            q[:, k] -= q[:, :k] @ (q[:, :k].T @ q[:, k])
            q[:, k] /= np.sqrt(q[:, k] @ q[:, k])
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 21.0),
        [1, 1, 1, 2, 2, 5, 5.0000001, 9],
        [1, 1 + 1e-9, 1 + 3e-9, 1 + 9e-9, 4, 4 + 1e-8],
        [0, 0, 0, 1e-6, 1e-6 + 1e-13, 1],
        [3.0] * 6,
        [0.0] * 4,
    ],
)
def test_clustered_eigenvalues(values):
    """More digits than doubles have, and directions told apart within clusters."""
    values = np.array(values, dtype=np.longdouble)
    q = orthogonal(len(values), len(values))
    v = (q * values) @ q.T
    found, x = whitening.eigenvectors((v + v.T) / 2)
    assert np.abs(found - values).max() <= 1e-17 * max(1, values.max())
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(v @ x - x * found).max() < 1e-17 * max(1, values.max())
    for k, value in enumerate(values):
        gap = np.abs(np.delete(values, k) - value).min()
        if gap > 1e-14:
            assert 1 - abs(q[:, k] @ x[:, k]) < max(1e-18, (1e-17 * values.max() / gap) ** 2)
