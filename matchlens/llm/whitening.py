"""Whitening by Jacobi-Davidson: leading eigenvectors of a covariance that is never formed.

Vectors become integers once, and the mean is known exactly as (sum, count). A product of the
covariance with a block of vectors is one pass over the stored fit list: every task centres its rows,
multiplies, and returns one small array; arrays are added in tasks before the driver sees about the
square root of their number. The driver holds the subspace only: dimensions by a few dozen columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import stored

COMPONENTS, SCALE, OFFSET, SEED = 16, 64, 1_000_000, 42
#: Ritz vectors carried beside the wanted ones.
GUARD = 8
#: Inner MINRES steps for one correction.
INNER_STEPS = 4
#: Columns of the subspace, as a multiple of the wanted and guard vectors, before it is restarted.
WIDEST = 4
#: A residual is done at this share of the largest Ritz value ...
TOLERANCE = 2e-15
#: ... or, where sums round worse, at this one once it no longer falls.
STAGNANT = 1e-12
ROUNDS = 200
#: Rows that a task centres and multiplies at a time.
ROWS = 4096
#: Entries beyond this are pulled in to it, so that integers stay exact.
LARGEST = 1 << 50


def _rows_of(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fit: DataFrame, width: int, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the `width` doubles that `task` makes of its batches.

    Each task gives one array; arrays are added in about as many tasks as the root of their number.
    """
    groups = max(1, int(fit.rdd.getNumPartitions() ** 0.5))  # plans the scan, runs nothing

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": [part], "grp": [part % groups], "v": [task(batches).tobytes()]})

    def second(key: tuple, rows: pa.Table) -> pa.Table:
        parts = rows.sort_by("part").column("v").to_pylist()
        return pa.table({"grp": [key[0].as_py()], "v": [_added(parts).tobytes()]})

    arrays = fit.mapInArrow(first, "part long, grp long, v binary")
    if groups > 4:
        arrays = arrays.groupBy("grp").applyInArrow(second, "grp long, v binary")
    found = [bytes(r.v) for r in sorted(arrays.select("grp", "v").collect(), key=lambda r: r.grp)]
    return _added(found) if found else np.zeros(width)


def _added(parts: list[bytes]) -> np.ndarray:
    """Sum of arrays with the rounding errors of the additions carried along."""
    total = np.frombuffer(parts[0]).copy()
    lost = np.zeros_like(total)
    for part in parts[1:]:
        x = np.frombuffer(part)
        new = total + x
        back = new - total
        lost += (total - (new - back)) + (x - back)
        total = new
    return total + lost


class Centre:
    """Exact mean of `n` integer vectors with per-dimension sums `sums`."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, as doubles: whole and fractional part are subtracted apart, so nothing cancels."""
        return (x - self.base).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it exceeds a long."""
        z = x - self.base
        reach = (float(np.abs(z).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 2.0**62:
            whole = self.n * z - self.rest
            return (whole * whole).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in z.tolist()]
        return [v if v < 2**63 else None for v in exact]


def _product(fit: DataFrame, centre: Centre, dims: int, w: np.ndarray) -> np.ndarray:
    """Covariance times the columns of `w`: one pass, centred before multiplying."""

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, lost = np.zeros(w.shape), np.zeros(w.shape)
        for batch in batches:
            x = _rows_of(batch, "x", dims)
            for at in range(0, len(x), ROWS):
                y = centre.centred(x[at : at + ROWS])
                add = y.T @ (y @ w)
                new = total + add
                back = new - total
                lost += (total - (new - back)) + (add - back)
                total = new
        return (total + lost).ravel()

    return _summed(fit, w.size, task).reshape(w.shape) / centre.n


def _minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """`steps` MINRES steps for every column of `b` at once; `apply` is symmetric and works column by column.

    Lanczos vectors of each column with Givens rotations of its tridiagonal matrix.
    """
    x, norm = np.zeros_like(b), np.linalg.norm(b, axis=0)
    safe = np.where(norm > 0, norm, 1)
    v_old, v, beta = np.zeros_like(b), b / safe, np.zeros_like(norm)
    w_old, w, eta = np.zeros_like(b), np.zeros_like(b), norm.copy()
    c_old, c, s_old, s = (np.ones_like(norm), np.ones_like(norm), np.zeros_like(norm), np.zeros_like(norm))
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p -= v * alpha + v_old * beta
        beta_new = np.linalg.norm(p, axis=0)
        delta, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r1 = np.hypot(delta, beta_new)
        ok = r1 > 1e-300
        r1 = np.where(ok, r1, 1)
        c_old, s_old = c, s
        c, s = np.where(ok, delta / r1, 1), np.where(ok, beta_new / r1, 0)
        w_old, w = w, (v - w_old * r3 - w * r2) / r1
        x += np.where(ok, c * eta, 0) * w
        eta = -s * eta
        tiny = beta_new <= 1e-14 * np.maximum(norm, 1e-300)
        v_old, v, beta = v, np.where(tiny, 0, p / np.where(tiny, 1, beta_new)), np.where(tiny, 0, beta_new)
    return x


def _orthonormal(new: np.ndarray, against: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of what the columns of `new` add to those of `against`."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - against @ (against.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > least]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = SEED, guard: int = GUARD, inner: int = INNER_STEPS,
    widest: int = WIDEST, tolerance: float = TOLERANCE, stagnant: float = STAGNANT, rounds: int = ROUNDS,
) -> tuple[np.ndarray, np.ndarray, dict]:
    """The `wanted` largest eigenvalues, falling, with their vectors, of a symmetric matrix known by its products.

    A round takes Ritz pairs from the subspace, locks the leading ones whose residual is down to
    rounding, and widens the subspace by the corrections of the others: MINRES solves each pair's
    equation, projected off the locked and current vectors, all pairs in one product per step. Too
    wide a subspace is restarted from its leading Ritz vectors.
    """
    wanted = min(wanted, dims)
    size = min(dims, wanted + guard)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, size)))[0]
    image, products = product(basis), 1
    locked, values = np.zeros((dims, 0)), []
    before, largest = None, 0.0
    for number in range(rounds):
        left = wanted - len(values)
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        largest = max(largest, abs(theta[0]), *map(abs, values[:1]))
        residual = image[:, :left] - basis[:, :left] * theta[:left]
        residual -= locked @ (locked.T @ residual)
        size_of = np.linalg.norm(residual, axis=0) / (largest or 1)
        full = basis.shape[1] + locked.shape[1] >= dims
        stuck = before is not None and len(before) == left and (size_of > before / 2) & (size_of <= stagnant)
        done = (size_of <= tolerance) | stuck | (full & (size_of <= stagnant))
        n_done = left if done.all() else int(np.argmin(done))  # leading ones only: none of a smaller value overtakes
        before = None if n_done else size_of
        values += theta[:n_done].tolist()
        locked = np.hstack([locked, basis[:, :n_done]])
        basis, image = basis[:, n_done:], image[:, n_done:]
        if len(values) == wanted:
            return np.array(values), locked, {
                "rounds": number + 1, "products": products, "residual": float(size_of.max(initial=0)),
            }
        residual, theta = residual[:, n_done:], theta[n_done:]
        left = wanted - len(values)
        if basis.shape[1] > max(widest * (wanted + guard) - left, 2 * left):
            keep = left + guard
            basis, image, theta = basis[:, :keep], image[:, :keep], theta[:keep]
        off = np.hstack([locked, basis[:, :left]])

        def projected(t: np.ndarray, off: np.ndarray = off, shift: np.ndarray = theta[:left]) -> np.ndarray:
            t = t - off @ (off.T @ t)
            t = product(t) - t * shift
            return t - off @ (off.T @ t)

        wide = basis.shape[1] + locked.shape[1]
        if wide >= dims:  # nothing is left to add: the images are taken afresh, so only their rounding remains
            image, products = product(basis), products + 1
            continue
        correction = _minres(projected, -(residual - off @ (off.T @ residual)), inner)
        new = _orthonormal(correction, np.hstack([locked, basis]))[:, : dims - wide]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng([seed, number]).standard_normal((dims, 1)), np.hstack([locked, basis]))
        basis, image, products = np.hstack([basis, new]), np.hstack([image, product(new)]), products + inner + 1
    raise RuntimeError(f"no convergence in {rounds} rounds")


def _integers(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole and finite; x = floor(64 c) + 1000000."""
    v = F.col(f"`{vector}`").cast("array<double>")
    kept = rows.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    bound = F.lit(float(LARGEST))
    near = lambda c: F.greatest(F.least(F.floor(c * SCALE).cast("double"), bound), -bound)
    return kept.select("id", F.transform("v", lambda c: near(c).cast("long") + OFFSET).alias("x"))


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _rows_of(batch, "x", dims)
            n += len(x)
            for at in range(0, len(x), ROWS):  # so few entries of at most 2^50 that a long holds their sum
                total = [a + b for a, b in zip(total, x[at : at + ROWS].sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": list(range(dims)), "n": [n] * dims, "s": [str(t) for t in total]})

    found = fit.mapInArrow(task, "at long, n long, s string").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    ).orderBy("at").collect()
    return found[0].n, [int(r.s) for r in found]


def _trace(fit: DataFrame, centre: Centre, dims: int) -> float:
    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        parts = [float((centre.centred(_rows_of(b, "x", dims)) ** 2).sum()) for b in batches]
        return np.array([sum(parts)])

    return float(_summed(fit, 1, task)[0]) / centre.n


def _identity_error(fit: DataFrame, centre: Centre, dims: int, turn: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened fit list differs from the identity."""
    k = turn.shape[1]

    def task(batches: Iterator[pa.RecordBatch], mean: np.ndarray, power: int) -> np.ndarray:
        total = np.zeros(k if power == 1 else k * k)
        for batch in batches:
            y = centre.centred(_rows_of(batch, "x", dims)) @ turn - mean
            total += y.sum(axis=0) if power == 1 else (y.T @ y).ravel()
        return total

    mean = _summed(fit, k, partial(task, mean=np.zeros(k), power=1)) / centre.n
    spread = _summed(fit, k * k, partial(task, mean=mean, power=2)).reshape(k, k) / centre.n
    return float(np.abs(spread - np.eye(k)).max(initial=0))


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS, **settings) -> dict:
    """Centre, directions over roots of eigenvalues, shares of variance and checks for one table of integer vectors ``x``."""
    n, sums = _sums(fit, dims)
    centre = Centre(n, sums)
    trace = _trace(fit, centre, dims)
    values, vectors, told = jacobi_davidson(lambda w: _product(fit, centre, dims, w), dims, components, **settings) if trace else (np.zeros(0), np.zeros((dims, 0)), {})
    some = values > 1e-13 * trace  # a direction without variance has no whitening
    values, vectors = values[some], vectors[:, some]
    turn = vectors / np.sqrt(values)
    return {
        "centre": centre, "turn": turn, "explained": values / trace if trace else values,
        "identity_error": _identity_error(fit, centre, dims, turn), **told,
    }


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, **settings
) -> DataFrame:
    """A row per kept row and component: id, ``component`` (1 has the largest variance), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; entries become
    integers, those beyond 2^50 are pulled in to it. Mean and covariance are those of the distinct
    integer vectors. Vectors of each length have a fit of their own. A direction without variance
    has no component, so a single distinct vector gives no rows. Repeated rows and null ids are rows
    like others; ``deviation`` is null where it exceeds a long. Other columns and their names play no
    part. An empty table gives an empty one.
    """
    kept = stored(_integers(rows, id_col, vector).withColumn("dims", F.size("x")), "integers")
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = kept.sparkSession.createDataFrame([], schema)
    lengths = sorted(r.dims for r in kept.where("dims > 0").select("dims").distinct().collect())
    for dims in lengths:
        own = kept.where(F.col("dims") == dims)
        fit = stored(own.select("x").distinct(), "fit")
        out = out.union(own.select("id", "x").mapInArrow(_projecting(fitted(fit, dims, components, **settings), dims), schema))
    return out.withColumnRenamed("id", id_col)


def _projecting(model: dict, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    centre, turn, k = model["centre"], model["turn"], model["turn"].shape[1]
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch, "x", dims)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            arrays = [
                batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, centre.n, np.int64)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array((centre.centred(x) @ turn).ravel()), pa.array(np.tile(model["explained"], m)),
                pa.array(np.full(m * k, model["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run
