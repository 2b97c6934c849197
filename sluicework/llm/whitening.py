"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Vectors are put on a grid of 1/256, and the distinct ones are the fit list.  Tasks sum the centred products of
their vectors, the sums of all tasks are added row by row of the matrix, and the driver turns the matrix (its
size is the dimension squared, whatever the number of vectors) by symmetric rotations until nothing is left
off its diagonal.  That keeps small eigenvalues accurate relative to their own size.  The whitening matrix is
broadcast, and every vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import mapped, tabled

#: Steps of the grid between two integers.
GRID = 256
#: Sweeps after which the rotations end at the latest; six to ten are usual.
SWEEPS = 60
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def grid_codes(column) -> list[bytes | None]:  # noqa: ANN001
    """Each vector of an Arrow list column as the bytes of its grid points floor(256 c), 8 of each; null for vectors that are null, or hold null or non-finite entries.

    Grid points outside 64 bits become the nearest inside.
    """
    import pyarrow as pa

    values = column.flatten()
    flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    fine = np.isfinite(flat)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(np.where(fine, flat, 0.0) * GRID)
    most = np.float64(2**63)
    whole = np.where(x >= most, 2**63 - 1, np.where(x < -most, -(2**63), np.clip(x, -most, np.nextafter(most, 0)).astype(np.int64)))
    lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0), np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    ok = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - lengths])
    raw = whole.astype("<i8").tobytes()
    return [raw[8 * (e - n) : 8 * e] if k else None for k, e, n in zip(ok.tolist(), ends.tolist(), lengths.tolist(), strict=True)]


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, columns of unit eigenvectors) of a symmetric matrix, by falling eigenvalue.

    A sweep meets every pair of indexes once, in rounds of disjoint pairs, whose rotations are applied together.
    It ends when every entry off the diagonal is nothing beside the geometric mean of its two diagonal entries.
    The greatest entry of each vector is positive.
    """
    d = len(a)
    a, v = np.array(a, np.float64), np.eye(d)
    seats = np.arange(d + d % 2)
    tiny = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            off, x, y = a[p, q], a[p, p], a[q, q]
            big = np.abs(off) > tiny * np.sqrt(np.abs(x) * np.abs(y))
            if big.any():
                turned = True
                p, q, off, x, y = p[big], q[big], off[big], x[big], y[big]
                with np.errstate(over="ignore"):
                    tau = (y - x) / (2 * off)
                    t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s = t * c
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
                for m in (a, v):
                    cp, cq = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * cp - s * cq, s * cp + c * cq
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = x - t * off, y + t * off
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    e, v = e[order], v[:, order]
    return e, v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


def coded(vectors: DataFrame, vector_col: str) -> DataFrame:
    """``vectors`` without ``vector_col`` and with its grid points ``_x`` (bytes); unusable vectors are dropped."""
    kept = [f for f in vectors.schema.fields if f.name != vector_col and f.name.lower() not in ADDED]
    names = [f.name for f in kept]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            codes = pa.array(grid_codes(b.column(len(names))), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), codes], names=[*names, "_x"])

    schema = StructType([*kept, StructField("_x", BinaryType())])
    out = mapped(vectors.select(*(vectors[f"`{c}`"] for c in names), vectors[f"`{vector_col}`"].alias("_vector")), run, schema)
    return out.where("octet_length(_x) > 0")


def _matrix(codes, d: int) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(b"".join(codes.to_pylist()), "<i8").reshape(-1, d)


def fit_list(codes: DataFrame) -> tuple[DataFrame, int, int]:
    """(the distinct grid vectors, their number, their dimension), written to the shared folder.

    Where vectors differ in length, the dimension is the length that most distinct ones have, the shorter of two.
    """
    fit = tabled(codes.select("_x").distinct())
    sizes = fit.groupBy((F.octet_length("_x") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return (fit.where(F.octet_length("_x") == 8 * sizes[0]["d"]), sizes[0]["n"], sizes[0]["d"]) if sizes else (fit, 0, 0)


def sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums of each dimension: each task's own first, then those of all tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            wide = len(x) and max(abs(int(x.max())), abs(int(x.min()))) > 2**31
            total = [t + int(s) for t, s in zip(total, x.astype(object).sum(0) if wide else x.sum(0), strict=True)]
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["j", "s"])

    found = mapped(fit, run, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect()
    out = [0] * d
    for r in found:
        out[r["j"]] = int(r["s"])
    return out


def scatter(fit: DataFrame, mean: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of the products of all pairs of entries, centred first; of ``weights``-projected ones if given.

    Each task adds up its own vectors; the tasks' matrices are added row by row, so no task holds more than its
    share of the rows and the driver receives one matrix.
    """
    d, k = len(mean), len(mean) if weights is None else weights.shape[1]

    def products(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, seen = np.zeros((k, k)), False
        for b in batches:
            y = _matrix(b.column(0), d) - mean
            y = y if weights is None else y @ weights
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "v"])

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.frombuffer(v)
                held[i] = held[i] + row if i in held else row
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["i", "v"])

    out = np.zeros((k, k))
    for r in mapped(mapped(fit, products, "i int, v binary").repartition("i"), added, "i int, v binary").collect():
        out[r["i"]] = np.frombuffer(r["v"])
    return (out + out.T) / 2


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``vectors`` without ``vector_col``, a row for each usable vector and component (from 1, by falling eigenvalue).

    Added are ``component``, ``n`` (distinct vectors), ``deviation`` (sum of (n x - S)^2, S the sums over the fit
    list; null where 64 bits can't hold it), ``whitened``, ``explained`` and ``identity_error``.  Vectors that are
    null or empty, hold null or non-finite entries, or whose length isn't the fit list's are dropped.  Equal
    vectors count once in the fit and are rows each; null ids are rows like others.  A component whose eigenvalue is no more than
    rounding (as with a single distinct vector) has no direction: ``whitened`` is null.  Fewer dimensions than
    components give fewer rows, an empty table none.  Input columns named like those added are replaced.
    """
    codes = coded(vectors, vector_col)
    fit, n, d = fit_list(codes)
    kept = [f for f in codes.schema.fields if f.name != "_x"]
    names = [f.name for f in kept]
    types = [IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()]
    schema = StructType([*kept, *(StructField(c, t) for c, t in zip(ADDED, types, strict=True))])
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    total = sums(fit, d)
    mean = np.array([s / n for s in total])
    e, v = jacobi(scatter(fit, mean) / n)
    k = min(components, d)
    trace = float(e.sum())
    solid = e[:k] > d * np.finfo(np.float64).eps * e[0]
    w = v[:, :k] / np.sqrt(np.where(solid, e[:k], 1.0))
    error = None
    if solid.any():
        within = scatter(fit, mean, w)[np.ix_(solid, solid)] / n
        error = float(np.abs(within - np.eye(len(within))).max())
    share = [float(x) / trace if trace > 0 else None for x in e[:k]]
    shared = vectors.sparkSession.sparkContext.broadcast((w, mean, total, solid))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w, mean, total, solid = shared.value
        for b in batches:
            x = _matrix(b.column(len(names)), d)
            y = (x - mean) @ w
            far = [max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(0), x.max(0), total, strict=True)] if len(x) else []
            if d * max(far, default=0) ** 2 < 2**63:
                z = n * x - np.array(total)
                deviation = (z * z).sum(1).tolist()
            else:
                z = n * x.astype(object) - np.array(total, object)
                deviation = [t if t < 2**63 else None for t in (z * z).sum(1)]
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x)
            put = [pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(deviation, pa.int64()).take(rows)]
            put += [pa.array(y.ravel(), pa.float64(), mask=np.tile(~solid, m)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(len(names))), *put], names=[*names, *ADDED])

    return mapped(codes.where(F.octet_length("_x") == 8 * d), run, schema)
