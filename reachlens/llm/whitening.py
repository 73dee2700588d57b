"""Whitening of embeddings: eigenvectors of the covariance in low precision, refined by matrix multiplications in higher.

Entries become whole numbers first. Their sums, and the sums of products of entries less the nearest whole mean, are exact:
each task multiplies matrices of limbs so small that doubles hold every sum, and Spark adds whole numbers. So the covariance
(centred, divisor n) is known to more than double precision and does not depend on how rows are dealt out or computed again.

The matrix has one row and column per dimension, whatever the number of vectors, and is decomposed on the driver:

* eigenvectors of the matrix rounded to 32-bit floats;
* Ogita-Aishima iterations in extended precision: with ``R = I - X'X`` and ``S = X'VX``, ``X`` gets ``X E``, where E
  removes the error to first order, so the number of right digits doubles with each step;
* eigenvalues closer than the error bound of the step form a cluster. Only the space spanned by its vectors is refined by
  the step; the directions within come from a sub-solve, the small eigenproblem of ``X_k' (V - m I) X_k`` with the shift m at
  the middle of the cluster, which makes their relative gaps large. Iterations go on on the rotated vectors.

Rows are then centred, projected and scaled where they lie. What is sent to tasks is one matrix of the size of the dimensions
by the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_LIMB = 22
#: A whole number travels as four parts to base 2 ** 40, the last one signed, so that Spark can add the parts.
_PARTS = ["p0", "p1", "p2", "p3"]
_PART_BITS = 40
_BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """``scale`` and ``shift``: an entry c becomes floor(scale * c) + shift. ``components`` at most are returned."""

    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    steps: int = 30


def _usable(vector: Column, rule: Whitening) -> Column:
    """No null vector, no null or non-finite entry, and every entry becomes a long."""
    limit = float(1 << 62) / rule.scale
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False)))


def _whole(batch: pa.RecordBatch, rule: Whitening) -> np.ndarray:
    """The vectors as rows of whole numbers. NaN never gets here."""
    column = batch.column(1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(rule.scale * flat).astype(np.int64).reshape(len(column), -1) + rule.shift


def _parts(totals: list[int]) -> list[list[int]]:
    low = (1 << _PART_BITS) - 1
    return [[t >> _PART_BITS * k & low if k < 3 else t >> _PART_BITS * k for t in totals] for k in range(4)]


def _joined(row: Row) -> int:
    return sum(row[name] << _PART_BITS * k for k, name in enumerate(_PARTS))


def _sums(rule: Whitening):
    """Per dimension: rows, smallest and largest entry, exact sum."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, low, high = 0, None, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = _whole(batch, rule)
            own = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            if sums is None:
                sums, low, high = own, x.min(axis=0), x.max(axis=0)
            else:
                sums, low, high = sums + own, np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
            count += len(x)
        if count:
            columns = [range(len(sums)), [count] * len(sums), low.tolist(), high.tolist(), *_parts([int(s) for s in sums])]
            names = ["i", "n", "low", "high", *_PARTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return function


def _limbs(z: np.ndarray, count: int) -> list[np.ndarray]:
    """``z`` as a sum of signed limbs times powers of 2 ** 22, each below 2 ** 21 in size, as doubles."""
    parts = []
    for _ in range(count - 1):
        part = ((z + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1))
        parts.append(part.astype(np.float64))
        z = (z - part) >> _LIMB
    return [*parts, z.astype(np.float64)]


def _products(rule: Whitening, centre: np.ndarray, limbs: int):
    """Exact sums of products of centred entries, upper triangle.

    A product of limbs is below 2 ** 42, and 1024 of them below 2 ** 52: doubles add them without rounding.
    """

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, seen = len(centre), 0
        total = np.zeros((size, size), dtype=object)
        sums = {(a, b): np.zeros((size, size), dtype=np.int64) for a in range(limbs) for b in range(a, limbs)}
        pending = 0

        def settle() -> None:
            nonlocal total
            for (a, b), held in sums.items():
                both = held.astype(object) if a == b else (held + held.T).astype(object)
                total = total + both * (1 << (_LIMB * (a + b)))
                held[:] = 0

        for batch in batches:
            if not len(batch):
                continue
            z = _whole(batch, rule) - centre
            for low in range(0, len(z), 1024):
                parts = _limbs(z[low : low + 1024], limbs)
                for a, b in sums:
                    sums[a, b] += (parts[a].T @ parts[b]).astype(np.int64)
                pending += 1
                if pending == 512:
                    settle()
                    pending = 0
            seen += len(z)
        if seen:
            settle()
            i, j = np.triu_indices(size)
            columns = [i, j, *_parts([int(v) for v in total[i, j]])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", *_PARTS])

    return function


@dataclass
class Covariance:
    """Rows, exact sums, and the exact sums of products around ``centre``."""

    n: int
    sums: list[int]
    centre: np.ndarray
    products: np.ndarray

    def matrix(self) -> np.ndarray:
        """The covariance in extended precision: (n Z'Z - s s') / n^2 with s the sums around the centre."""
        s = np.array([total - self.n * int(c) for total, c in zip(self.sums, self.centre)], dtype=object)
        exact = self.n * self.products - np.outer(s, s)
        return np.array([[_extended(v, self.n * self.n) for v in row] for row in exact], dtype=np.longdouble).reshape(exact.shape)


def _extended(numerator: int, denominator: int) -> np.longdouble:
    """A quotient of whole numbers, correct to about 63 bits."""
    shift = max(0, 64 - (abs(numerator).bit_length() - denominator.bit_length()))
    whole = (abs(numerator) << shift) // denominator
    excess = max(0, whole.bit_length() - 63)
    found = np.ldexp(np.longdouble(whole >> excess), excess - shift)
    return -found if numerator < 0 else found


def covariance(vectors: DataFrame, rule: Whitening) -> Covariance | None:
    """Exact covariance of the (equally long) vectors; None without rows. One row per task and pair of dimensions is shuffled."""
    as_longs = [f"{name} long" for name in _PARTS]
    parts = vectors.mapInArrow(_sums(rule), ", ".join(["i long, n long, low long, high long", *as_longs]))
    added = [F.sum(name).alias(name) for name in ("n", *_PARTS)]
    merged = parts.groupBy("i").agg(*added, F.min("low").alias("low"), F.max("high").alias("high"))
    rows = merged.orderBy("i").collect()  # one row per dimension
    if not rows:
        return None
    n, sums = rows[0].n, [_joined(r) for r in rows]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    widest = max(max(r.high - int(c), int(c) - r.low) for r, c in zip(rows, centre))
    limbs = max(1, -(-(widest.bit_length() + 1) // _LIMB))
    found = vectors.mapInArrow(_products(rule, centre, limbs), ", ".join(["i long, j long", *as_longs]))
    products = np.zeros((len(rows), len(rows)), dtype=object)
    for r in found.groupBy("i", "j").agg(*added[1:]).collect():  # a matrix of the dimensions
        products[r.i, r.j] = products[r.j, r.i] = _joined(r)
    return Covariance(n, sums, centre, products)


def _clusters(values: np.ndarray, bound: np.longdouble) -> list[slice]:
    """Runs of sorted values whose neighbours are no farther apart than the bound."""
    cuts = np.flatnonzero(np.diff(values) > bound) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def eigenvectors(matrix: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and unit eigenvectors of a symmetric matrix in extended precision."""
    size, scale = len(matrix), np.abs(matrix).max() if matrix.size else 0
    if not scale:
        return np.zeros(size, np.longdouble), np.eye(size, dtype=np.longdouble)
    v = matrix / scale
    one = np.eye(size, dtype=np.longdouble)
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(np.longdouble)
    norm = np.linalg.norm(v.astype(np.float64), 2)
    noise = 64 * size * norm * np.finfo(np.longdouble).eps
    for _ in range(steps):
        r, s = one - x.T @ x, x.T @ (v @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else their rounding, divided by small gaps, costs orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = np.linalg.norm((s - np.diag(values)).astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2)
        if off <= noise:
            break
        clustered, groups = np.zeros((size, size), dtype=bool), _clusters(values, 2 * off)
        for group in groups:
            clustered[group, group] = True
        gaps = np.where(clustered, 1, values[None, :] - values[:, None])
        x = x + x @ np.where(clustered, r / 2, (s + values[None, :] * r) / gaps)
        for group in groups:
            if group.stop - group.start > 1:
                x[:, group] = _sub_solve(v, x[:, group], noise)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, v @ x)
    order = np.argsort(values, kind="stable")
    return values[order] * scale, x[:, order]


def _sub_solve(v: np.ndarray, x: np.ndarray, noise: float) -> np.ndarray:
    """The vectors of a cluster, turned within the space they span to the eigenvectors of the shifted small problem.

    What is diagonal up to the rounding of the extended numbers stays: equal eigenvalues have no directions of their own.
    """
    middle = np.einsum("ij,ij->j", x, v @ x).mean()
    small = x.T @ (v @ x - middle * x)
    small = (small + small.T) / 2
    if np.abs(small - np.diag(np.diag(small))).max() <= noise / len(v):
        return x
    turn = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))[1].astype(np.longdouble)
    return x @ turn


@dataclass
class Fitted:
    """What rows are whitened with. ``values`` fall; ``directions`` has a unit vector per column."""

    found: Covariance
    values: np.ndarray
    directions: np.ndarray
    trace: np.longdouble

    def matrix(self) -> np.ndarray:
        """Directions over the roots of their eigenvalues; NaN where the eigenvalue is zero."""
        tiny = self.trace * len(self.found.sums) * np.finfo(np.float64).eps
        roots = np.sqrt(np.where(self.values > tiny, self.values, np.nan))
        return (self.directions / roots).astype(np.float64)

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace else None for e in np.maximum(self.values, 0)]


def fit(vectors: DataFrame, rule: Whitening) -> Fitted | None:
    found = covariance(vectors, rule)
    if found is None:
        return None
    matrix = found.matrix()
    values, directions = eigenvectors(matrix, rule.steps)
    kept = min(rule.components, len(values))
    return Fitted(found, values[::-1][:kept], directions[:, ::-1][:, :kept], np.trace(matrix))


def _centred(batch: pa.RecordBatch, rule: Whitening, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S as whole numbers: longs if they fit, else Python's."""
    x = _whole(batch, rule)
    largest = max(abs(int(x.max())), abs(int(x.min())), 1)
    if n * largest + max(abs(int(s)) for s in sums) >= 1 << 62:
        y = x.astype(object) * n - sums
        return y, np.array([[float(np.longdouble(v) / n) for v in row] for row in y]).reshape(y.shape)
    y = x * n - sums.astype(np.int64)
    return y, (y.astype(np.longdouble) / n).astype(np.float64)


def _deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null if no long holds them."""
    if y.dtype != object:
        widest = int(np.abs(y).max()) if y.size else 0
        if widest * widest * max(1, y.shape[1]) < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        y = y.astype(object)
    return [total if total < 1 << 63 else None for total in (int((row * row).sum()) for row in y)]


def _moments(rule: Whitening, fitted: Fitted, means: np.ndarray | None):
    """Sums of the whitened values, or with their means the sums of centred products, a row per entry and task."""
    matrix, n, sums = fitted.matrix(), fitted.found.n, np.array(fitted.found.sums, dtype=object)

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for low in range(0, len(batch), _BLOCK):
                w = _centred(batch.slice(low, _BLOCK), rule, n, sums)[1] @ matrix
                total = total + (w.sum(axis=0)[None, :] if means is None else (w - means).T @ (w - means)).astype(np.longdouble)
        if isinstance(total, np.ndarray):
            i, j = np.indices(total.shape).reshape(2, -1)
            columns = [pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total.reshape(-1).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "total"])

    return function


def identity_error(vectors: DataFrame, fitted: Fitted, rule: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on all rows.

    Components without variance are left out; null if none has any.
    """
    kept = np.flatnonzero(~np.isnan(fitted.matrix()).any(axis=0))
    if not len(kept):
        return None
    part = Fitted(fitted.found, fitted.values[kept], fitted.directions[:, kept], fitted.trace)
    shape, means = (1, len(kept)), None
    for _ in range(2):
        sums = np.zeros(shape)
        found = vectors.mapInArrow(_moments(rule, part, means), "i long, j long, total double")
        for i, j, total in found.groupBy("i", "j").agg(F.sum("total")).collect():  # components by components at most
            sums[i, j] = total
        means, shape = sums[0] / fitted.found.n, (len(kept), len(kept))
    return float(np.abs(sums / fitted.found.n - np.eye(len(kept))).max())


def _apply(rule: Whitening, fitted: Fitted, error: float | None):
    matrix, explained, n = fitted.matrix(), fitted.explained(), fitted.found.n
    sums, kept = np.array(fitted.found.sums, dtype=object), fitted.matrix().shape[1]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), _BLOCK):
                part = batch.slice(low, _BLOCK)
                y, centred = _centred(part, rule, n, sums)
                size = len(part) * kept
                whitened = (centred @ matrix).reshape(-1)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(part)), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(size, n)),
                    pa.array(_deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), kept))),
                    pc.if_else(pa.array(np.isnan(whitened)), pa.scalar(None, pa.float64()), pa.array(whitened)),
                    pa.array(explained * len(part), pa.float64()),
                    pa.array([error] * size, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return function


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]


def usable_vectors(df: DataFrame, rule: Whitening, id_column: str, vector_column: str) -> DataFrame:
    """Id and vector of the rows that take part, all of the length that most of them have (of ties the smallest)."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    rows = rows.where(_usable(F.col("vector"), rule) & (F.size("vector") > 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), "length").first()
    return rows.where(F.size("vector") == (most.length if most else 0))


def whiten(df: DataFrame, rule: Whitening = Whitening(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Null vectors and those with a null or non-finite entry take no part, nor do empty ones, those of another length than most,
    and entries so large that no long holds them. Null and repeated ids keep their rows. A component without
    variance has null in ``whitened``; ``explained`` is null if no component has any. A deviation that no long holds is
    null. Without usable vectors there are no rows.
    """
    vectors = usable_vectors(df, rule, id_column, vector_column)
    fitted = fit(vectors, rule)
    if fitted is None:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    return vectors.mapInArrow(_apply(rule, fitted, identity_error(vectors, fitted, rule)), _SCHEMA)
