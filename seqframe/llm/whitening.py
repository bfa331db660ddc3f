"""Whitening of embeddings by LOBPCG over distributed covariance-block products.

1. Vectors become whole numbers x and are packed, thousands to a row, into a stored table; counts and sums are exact.
2. One product V B of the covariance V with a block B of a few columns is one pass: B is broadcast, a task multiplies its centred
   rows, (n x - S) / n with n x - S exact, by B and again by themselves, and returns one dims x columns matrix, which Spark adds up.
   V is never formed.
3. LOBPCG (Knyazev, 2001): each step makes an orthonormal basis of the iterate X, its residuals R = V X - X E and the previous
   directions P, takes one product with it, and solves the small problem in that basis (Rayleigh-Ritz); its leading
   vectors are the next X, and their parts outside the old X the next P.  X is wider than the components asked for.
4. Once residuals stop falling, a pass of its own multiplies the components themselves: |V u - e u| bounds the distance of
   each e to an eigenvalue.  Components whose residual isn't below the limit raise an error.
5. Rows are projected; a last pass over the projected rows takes their covariance, whose distance to the identity is reported.

The driver holds matrices of dims x 3 * block numbers, never rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored

#: Vectors to a packed row, spare columns of the iterate, steps at most, and the largest residual, as a share of the largest eigenvalue.
PACK, SPARE, STEPS, LIMIT = 4096, 8, 500, 1e-11
#: Whole numbers up to this size are taken.
LARGEST = float(1 << 52)


def _pack(batches, dims: int, scale: int, shift: int):
    """Batches of vectors as packed rows: their ids as a list, and their numbers as bytes of little-endian 64-bit integers, row by row."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            part = batch.slice(at, PACK)
            v = part.column("v")
            c = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            x = np.floor(c * scale).astype("<i8") + shift
            ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column("vec_id"))
            yield pa.record_batch([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])


def _blocks(batches, dims: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("ids")[i].values if "ids" in batch.schema.names else None, np.frombuffer(batch.column("x")[i].as_buffer(), dtype="<i8").reshape(-1, dims)


def _added(parts: DataFrame, columns: int) -> np.ndarray:
    """The sum of the tasks' matrices, whose rows come as (i, c0, c1, ..)."""
    rows = parts.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(columns)]).collect()
    out = np.zeros((len(rows), columns))
    for r in rows:
        out[r["i"]] = r[1:]
    return out


def _matrix_rows(m: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.arange(len(m), dtype=np.int32)), *[pa.array(m[:, j]) for j in range(m.shape[1])]], names=["i", *[f"c{j}" for j in range(m.shape[1])]])


def _matrix_schema(columns: int) -> str:
    return "i int, " + ", ".join(f"c{j} double" for j in range(columns))


class Covariance:
    """The covariance (divisor n) of a packed table, by products."""

    def __init__(self, packed: DataFrame, dims: int):
        self.packed, self.dims = packed, dims

        def sums(batches):
            total, n = [0] * dims, 0
            for _, x in _blocks(batches, dims):  # a block's sums fit 64 bits: PACK numbers below 2**52
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
                n += len(x)
            yield pa.record_batch([pa.array(np.arange(dims, dtype=np.int32)), pa.array([str(t) for t in total]), pa.array([n] * dims, pa.int64())], names=["i", "s", "n"])

        found = packed.select("x").mapInArrow(sums, "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        by_dim = {r["i"]: r for r in found}
        self.n = by_dim[0]["n"] if by_dim else 0
        self.sums = [int(by_dim[i]["s"]) for i in range(dims)] if self.n else [0] * dims

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function of a block: its rows less the means; n x - S is exact, in 64 bits where it fits."""
        n, sums = self.n, self.sums

        def centre(x: np.ndarray) -> np.ndarray:
            return deviations(x, n, sums).astype(np.float64) / n

        return centre

    def times(self, b: np.ndarray) -> np.ndarray:
        """V b, one pass."""
        centre, dims, columns, n = self.centred(), self.dims, b.shape[1], self.n

        def product(batches):
            total = np.zeros((dims, columns))
            for _, x in _blocks(batches, dims):
                c = centre(x)
                total += c.T @ (c @ b)
            yield _matrix_rows(total)

        return _added(self.packed.select("x").mapInArrow(product, _matrix_schema(columns)), columns) / n

    def trace(self) -> float:
        centre, dims = self.centred(), self.dims

        def squares(batches):
            total = np.zeros((dims, 1))
            for _, x in _blocks(batches, dims):
                total += (centre(x) ** 2).sum(axis=0)[:, None]
            yield _matrix_rows(total)

        return float(_added(self.packed.select("x").mapInArrow(squares, _matrix_schema(1)), 1).sum()) / self.n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they do, or Python's own."""
    if len(x) and max(int(np.abs(x).max()) * n, max(map(abs, sums))) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, the first block's first; columns that the others span already are left out.

    Columns come at length one and are made orthogonal twice, so that what is left of them is so to the last digits."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if not size or basis.shape[1] == len(column):
                continue
            column = column / size
            for _ in range(2):
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size > 1e-10:
                column = column / size
                column = column - basis @ (basis.T @ column)
                basis = np.column_stack([basis, column / np.linalg.norm(column)])
    return basis


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, spare: int = SPARE, steps: int = STEPS, limit: float = LIMIT, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns; residual norms) of the leading `wanted` components, given products with blocks.

    Steps end once every wanted residual is within rounding of zero, or is below the limit and hasn't halved for six steps.
    """
    width = min(dims, wanted + spare)
    x = orthonormal(np.random.default_rng(seed).standard_normal((dims, width)))
    p = np.zeros((dims, 0))
    vx = times(x)
    best, since = np.inf, 0
    for _ in range(steps):
        e = (x * vx).sum(axis=0)
        r = vx - x * e
        basis = orthonormal(x, r, p)
        product = times(basis)
        small = basis.T @ product
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        lead = vectors[:, ::-1][:, :width]
        outside = lead.copy()
        outside[: x.shape[1]] = 0
        p, x, vx = basis @ outside, basis @ lead, product @ lead
        e = values[::-1][:width]
        worst = np.linalg.norm((vx - x * e)[:, :wanted], axis=0).max() / max(e[0], np.finfo(float).tiny)
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if worst < 4 * np.finfo(float).eps or basis.shape[1] == dims or (best < limit and since >= 6):
            break
    u = orthonormal(x[:, :wanted])
    vu = times(u)  # the certificate: a product of the components themselves
    e = (u * vu).sum(axis=0)
    residual = np.linalg.norm(vu - u * e, axis=0)
    if (residual > limit * max(e.max(initial=0.0), 0.0)).any():
        raise ArithmeticError(f"residuals {residual} of eigenvalues {e} are above the limit after {steps} steps")
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order], residual[order]


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, dims: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual.

    A component c of a vector, as double, becomes x = floor(scale * c) + shift.  n vectors have sums S; V is the covariance of x,
    divisor n.  Components are V's leading unit eigenvectors, from 1 by falling eigenvalue e, either sign; tied eigenvalues share
    any orthonormal basis of their space.  deviation: the sum over dimensions of (n x - S)^2, exact, as decimal.  whitened:
    (x - S/n) projected, over sqrt(e); explained: e / trace(V); identity_error: the largest absolute entry of whitened's covariance
    less the identity; residual: |V u - e u| / e_1, certified by a product of its own.
    Left out are null vectors, those with a null or non-finite component or one that is 2**52 or more once scaled, and those of another
    length than dims (default: the commonest, of equally common ones the smallest).  Components whose eigenvalue is zero to
    rounding have no whitened values and are left out, so vectors that are all equal, or fewer than two, give no rows, as does an empty
    table.  Rows that repeat a vec_id, or lack one, count each; other columns are ignored.
    """
    v = F.col("v")
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double"
    spark = vectors.sparkSession
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * scale) + abs(shift) < LARGEST, F.lit(False)))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).filter(v.isNotNull() & (F.size("v") > 0) & fine)
    if dims is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if most is None:
            return spark.createDataFrame([], schema)
        dims = most["d"]
    packed = Stored(rows.filter(F.size("v") == dims).mapInArrow(lambda it: _pack(it, dims, scale, shift), f"ids array<{kind}>, x binary"), "packed").df
    cov = Covariance(packed, dims)
    trace = cov.trace() if cov.n else 0.0
    if not trace > 0:
        return spark.createDataFrame([], schema)
    e, u, residual = lobpcg(cov.times, dims, min(components, dims))
    some = e > dims * np.finfo(float).eps * max(trace, e[0])
    e, u, residual = e[some], u[:, some], residual[some]
    n, sums, centre, wide = cov.n, cov.sums, cov.centred(), len(e)

    def project(x: np.ndarray) -> np.ndarray:
        return centre(x) @ u / np.sqrt(e)

    def moments(batches):
        total = np.zeros((wide, wide + 1))
        for _, x in _blocks(batches, dims):
            w = project(x)
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        yield _matrix_rows(total)

    seen = _added(packed.select("x").mapInArrow(moments, _matrix_schema(wide + 1)), wide + 1) / n
    error = float(np.abs(seen[:, :wide] - np.outer(seen[:, wide], seen[:, wide]) - np.eye(wide)).max())

    def out(batches):
        for ids, x in _blocks(batches, dims):
            d = deviations(x, n, sums)
            if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * dims >= 1 << 63:
                d = d.astype(object)
            squares = [int(s) for s in (d * d).sum(axis=1)]
            m = len(x)
            yield pa.record_batch(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), wide))),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * wide, n, dtype=np.int64)),
                    pa.array(squares, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), wide))),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(e / trace, m)),
                    pa.array(np.full(m * wide, error)),
                    pa.array(np.tile(residual / e[0], m)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    return packed.mapInArrow(out, schema)
