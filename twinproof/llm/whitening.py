"""Whitening of embeddings by their leading principal components, found with a block Jacobi-Davidson method.

The covariance is never built. It acts on a block of directions through one pass over the centred vectors, spread over tasks,
and everything else works on the block alone: the search space, its Rayleigh-Ritz step, and the projected correction
equations, which MINRES solves for all open pairs at once, one pass a step. Converged pairs are locked. It ends when all
residuals are at rounding level.

Entries become integers, so the sums are exact, and n*x - S is an exact integer: a vector is centred before anything is
rounded, whatever its offset.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import map_arrow, saved

SCALE, OFFSET = 64, 1_000_000
#: Entries are held to this size, in units of 1/SCALE; beyond it a double has no fractions left.
LARGEST = 1 << 52
#: Rows of a stored block.
ROWS = 1024
#: Partial sums that the driver reads at once.
FAN_IN = 64


def packed(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """ids, width, data: blocks of floor(SCALE * entry) as little-endian integers of 4 or, if needed, 8 bytes.

    Rows whose vector is null or has a null, NaN or infinite entry are left out. In a block, shorter vectors end in zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                entries = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                lengths = pc.list_value_length(part.column(1)).to_numpy()
                width = int(lengths.max())
                full = np.zeros((len(part), width))
                full[np.arange(width) < lengths[:, None]] = entries
                good = np.isfinite(full).all(1)
                if good.any():
                    x = np.clip(np.floor(full[good] * SCALE), -LARGEST, LARGEST)
                    kind = "<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<i8"
                    ids = part.column(0).filter(pa.array(good))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())],
                        ["ids", "width", "data"],
                    )

    rows = vectors.select(F.col(id_column).cast("long"), F.col(column).cast("array<double>"))
    return map_arrow(rows, run, "ids array<long>, width int, data binary")


def block(count: int, width: int, data: bytes) -> np.ndarray:
    """The stored integers, a row a vector."""
    size = len(data) // max(1, count * width)
    return np.frombuffer(data, "<i4" if size <= 4 else "<i8").astype(np.int64).reshape(count, width)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of each stored block."""
    for batch in batches:
        for i in range(len(batch)):
            ids = batch.column("ids").slice(i, 1).flatten()
            yield ids, block(len(ids), batch.column("width")[i].as_py(), batch.column("data")[i].as_py())


@dataclass
class Vectors:
    """Stored vectors with what centring needs: n, and each dimension's exact sum of integers (without OFFSET)."""

    blocks: DataFrame
    parts: int  # partitions of a scan
    n: int
    sums: list[int]
    largest: int  # absolute value of an integer

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: as int64 where that holds it, else as Python integers. Missing dimensions count as zero."""
        wide = len(self.sums)
        if x.shape[1] < wide:
            x = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
        if 2 * self.n * self.largest < 1 << 62:
            return self.n * x - np.asarray(self.sums, np.int64)
        return self.n * x.astype(object) - np.asarray(self.sums, object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, each entry rounded once from its exact numerator."""
        return self.centred(x).astype(float) / self.n


def merged(rows: DataFrame, parts: int, add: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """All rows' ``value`` added up: in tasks, level by level, until the driver reads at most FAN_IN of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                total = value.as_py() if total is None else add(total, value.as_py())
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], ["value"])

    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        rows = map_arrow(rows.repartition(parts), run, "value binary")
    total = None
    for r in rows.collect():
        total = bytes(r.value) if total is None else add(total, bytes(r.value))
    return total


def _add_doubles(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def _add_totals(a: bytes, b: bytes) -> bytes:
    x, y = json.loads(a), json.loads(b)
    longer, shorter = (x["sums"], y["sums"]) if len(x["sums"]) >= len(y["sums"]) else (y["sums"], x["sums"])
    sums = [s + t for s, t in zip(longer, shorter + [0] * (len(longer) - len(shorter)))]
    return json.dumps({"n": x["n"] + y["n"], "sums": sums, "largest": max(x["largest"], y["largest"])}).encode()


def measured(stored: DataFrame) -> Vectors:
    """Count and exact sums of the stored vectors, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = json.dumps({"n": 0, "sums": [], "largest": 0}).encode()
        for ids, x in blocks(batches):
            own = {"n": len(ids), "sums": x.sum(0).tolist(), "largest": int(np.abs(x).max(initial=0))}
            total = _add_totals(total, json.dumps(own).encode())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], ["value"])

    parts = stored.rdd.getNumPartitions()
    total = merged(map_arrow(stored, run, "value binary"), parts, _add_totals)
    return Vectors(stored, parts, **(json.loads(total) if total else {"n": 0, "sums": [], "largest": 0}))


def summed(vectors: Vectors, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all blocks of ``each(centred block)``: one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in blocks(batches):
            total += each(bare.scaled(x))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["value"])

    bare = Vectors(None, 0, vectors.n, vectors.sums, vectors.largest)
    out = merged(map_arrow(vectors.blocks.select("ids", "width", "data"), run, "value binary"), vectors.parts, _add_doubles)
    return np.zeros(shape) if out is None else np.frombuffer(out).reshape(shape)


def covariance_product(vectors: Vectors, u: np.ndarray) -> np.ndarray:
    """Covariance times the columns of ``u``, without the covariance."""
    return summed(vectors, lambda y: y.T @ (y @ u), u.shape) / vectors.n


# -- Jacobi-Davidson ---------------------------------------------------------------------------------


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of a symmetric system for each column of ``right``, all advanced by one product a step."""

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > tiny)

    size = np.linalg.norm(right, axis=0)
    tiny = 1e-300
    x = np.zeros_like(right)
    v, before = over(right, size), np.zeros_like(right)
    beta, left = np.zeros_like(size), size.copy()
    cos, cos0, sin, sin0 = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    w, w0 = np.zeros_like(right), np.zeros_like(right)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * before
        longer = np.linalg.norm(p, axis=0)
        delta = cos * alpha - cos0 * sin * beta
        r1, r2, r3 = np.hypot(delta, longer), sin * alpha + cos0 * cos * beta, sin0 * beta
        cos0, cos = cos, over(delta, r1)
        sin0, sin = sin, over(longer, r1)
        w, w0 = over(v - r3 * w0 - r2 * w, r1), w
        x += cos * left * w
        left = -sin * left
        before, v, beta = v, over(p, longer), longer
        if (np.abs(left) <= enough * size).all():
            break
    return x


def orthonormal(new: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the orthonormal ``known``; nothing of theirs twice."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(3):
        for basis in known:
            new = new - basis @ (basis.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    new = u[:, s > 1e-8]
    for _ in range(2):
        for basis in known:
            new = new - basis @ (basis.T @ new)
        new, _ = np.linalg.qr(new)
    return new


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, inner: int = 6, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric operator of dimension d, unit eigenvectors and residual norms.

    ``product`` gives the operator's image of a block of columns. Ends when every residual is at most 4 * sqrt(d) roundings of the
    largest eigenvalue, checked on fresh products; raises if ``rounds`` rounds don't get there.
    """
    k = min(k, d)
    guard = min(d, k + 8)
    widest = min(d, max(2 * guard, guard + 2 * k))
    level = 4 * math.sqrt(d) * np.finfo(float).eps
    locked = np.zeros((d, 0))
    basis = orthonormal(np.random.default_rng(7).standard_normal((d, guard)))
    image = product(basis)
    largest = 0.0
    for _ in range(rounds):
        theta, s = np.linalg.eigh((lambda h: (h + h.T) / 2)(basis.T @ image))
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        largest = max(largest, float(np.abs(theta).max(initial=0)))
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        norm = np.linalg.norm(residual, axis=0)
        open_pairs = k - locked.shape[1]
        full = locked.shape[1] + basis.shape[1] == d
        good = int(np.argmin(np.append(norm[:open_pairs] <= level * largest, False))) if not full else open_pairs
        if good:
            locked = np.hstack([locked, basis[:, :good]])
            basis, image, theta, residual, norm = basis[:, good:], image[:, good:], theta[good:], residual[:, good:], norm[good:]
        if locked.shape[1] == k:
            fresh = product(locked)
            theta, s = np.linalg.eigh((lambda h: (h + h.T) / 2)(locked.T @ fresh))
            locked, fresh, theta = locked @ s[:, ::-1], fresh @ s[:, ::-1], theta[::-1]
            norm = np.linalg.norm(fresh - locked * theta, axis=0)
            if full or (norm <= 4 * level * largest).all():
                return theta, locked, norm
            basis, image, locked = orthonormal(np.hstack([locked, basis])), None, np.zeros((d, 0))
            image = product(basis)
            continue
        wanted = k - locked.shape[1]
        if basis.shape[1] + wanted > widest - locked.shape[1]:  # thick restart
            keep = max(wanted, guard - locked.shape[1])
            basis, image, theta, residual, norm = basis[:, :keep], image[:, :keep], theta[:keep], residual[:, :keep], norm[:keep]
        bad = np.flatnonzero(norm[:wanted] > level * largest)
        out = np.hstack([locked, basis[:, :wanted]])

        def project(t: np.ndarray, out: np.ndarray = out) -> np.ndarray:
            return t - out @ (out.T @ t)

        def correction(t: np.ndarray, shift: np.ndarray = theta[bad]) -> np.ndarray:
            t = project(t)
            return project(product(t) - t * shift)

        found = minres(correction, -project(residual[:, bad]), inner, 0.05)
        new = orthonormal(found, locked, basis)
        if new.shape[1] == 0:
            new = orthonormal(np.random.default_rng(11).standard_normal((d, 4)), locked, basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    raise RuntimeError("the residuals did not reach rounding level")


# -- Whitening ---------------------------------------------------------------------------------------


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, digits for each vector and leading component.

    An entry c counts as floor(64*c) + 1000000. Rows without a whole finite vector are left out; repeated rows and ids count each
    time; a null id stays null. The dimension is the longest vector's, shorter ones end in zeros, and there are as many
    components as dimensions at most. Entries beyond 2^52/64 are held there. A component without variance (a constant
    dimension, fewer vectors than dimensions) has a null ``whitened``, and identity_error is over the others (null if there are
    none). ``deviation`` is null where it exceeds a long; ``digits`` then holds it. No vectors: no rows. Other
    columns are not read.
    """
    data = measured(saved(packed(vectors, id_column, column), "vectors"))
    n, d = data.n, len(data.sums)
    k = min(components, d)
    trace = float(summed(data, lambda y: np.asarray([np.square(y).sum()]), (1,))[0] / n) if n else 0.0
    if trace > 0:
        values, u, _ = leading_pairs(lambda b: covariance_product(data, b), d, k)
    else:
        values, u = np.zeros(k), np.eye(d, k)
    real = values > d * np.finfo(float).eps * max(values.max(initial=0), 0)
    turn = u[:, real] / np.sqrt(values[real])
    m = turn.shape[1]
    error = None
    if m:
        # Of the whitened vectors with a one beside them: second moments, and in the last row the sums.
        moments = summed(data, lambda y: (lambda z: z.T @ z)(np.hstack([y @ turn, np.ones((len(y), 1))])), (m + 1, m + 1)) / n
        error = float(np.abs(moments[:m, :m] - np.outer(moments[m, :m], moments[m, :m]) - np.eye(m)).max())
    explained = values / trace if trace > 0 else values
    bare = Vectors(None, 0, n, data.sums, data.largest)
    long = 2 * d * (2 * n * data.largest) ** 2 < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches):
            whole = bare.centred(x)
            y = whole.astype(float) / n
            z = np.full((len(ids), k), np.nan)
            z[:, real] = y @ turn
            exact = np.square(whole if long else whole.astype(object)).sum(1)
            fits = [0 <= int(e) < 1 << 63 for e in exact]
            row = pa.array(np.repeat(np.arange(len(ids)), k))
            columns = [
                ids.take(row),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                pa.array(np.full(len(row), n, np.int64)),
                pa.array([int(e) if f else None for e, f in zip(exact, fits)], pa.int64()).take(row),
                pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())),
                pa.array(np.tile(explained, len(ids))),
                pa.array([error] * len(row), pa.float64()),
                pa.array([None if f else str(int(e)) for e, f in zip(exact, fits)], pa.string()).take(row),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "digits"])

    return map_arrow(data.blocks, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, digits string")
