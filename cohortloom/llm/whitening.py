"""Whitening of embeddings; the components come from FEAST contour integration.

Vectors become whole numbers, 256 times their entries rounded down. The covariance of the
distinct vectors is added up exactly: centred on the nearest whole number to the mean, split
into 32-bit limbs, with the rest of the mean taken off at the end, so neither the order of the
rows nor the number of tasks shows in it. That matrix, as large as the square of the dimension
whatever the number of rows, is all that reaches the driver.

Its leading components are found by intervals of eigenvalues. Inertia counts (signs of the
pivots of a symmetric factorisation of the shifted matrix) place the interval bounds in gaps
of the spectrum and say how many eigenvalues lie between. Quadrature of the resolvent along a
circle through both bounds projects a block of vectors onto the wanted space, by solving with
the complex shifted covariance at every node; Rayleigh-Ritz on the projected block gives the
pairs. This repeats until the residuals are at rounding level and as many pairs lie in the
interval as the inertia says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

COMPONENTS = 4
SCALE = 256
#: Quadrature nodes on the half circle, eigenvalues of an interval, and rounds of projection.
NODES, INTERVAL, ROUNDS = 12, 16, 30
#: Limbs of an exact sum: four of 32 bits and a signed one.
LIMBS = 5
_MASK = (1 << 32) - 1
_SUMS = [f"l{k}" for k in range(LIMBS)]


# inertia, contour integration ------------------------------------------------------------

class Inertia:
    """Inertia counts of a symmetric matrix, which is made tridiagonal once by reflections."""

    def __init__(self, matrix: np.ndarray):
        rest, d = matrix.astype(float), len(matrix)
        for k in range(d - 2):
            mirror = rest[k + 1:, k].copy()
            size = np.linalg.norm(mirror)
            mirror[0] += size if mirror[0] >= 0 else -size
            length = np.linalg.norm(mirror)
            if length == 0:
                continue
            mirror /= length
            block = rest[k + 1:, k + 1:]
            turned = block @ mirror
            turned -= (mirror @ turned) * mirror
            block -= 2 * (np.outer(mirror, turned) + np.outer(turned, mirror))
            rest[k + 1:, k] -= 2 * mirror * (mirror @ rest[k + 1:, k])
        self.diagonal = np.diag(rest).tolist()
        self.squares = (np.diag(rest, -1) ** 2).tolist()
        self.least = np.finfo(float).tiny * max(1.0, max(self.squares, default=0.0))

    def above(self, shift: float) -> int:
        """Eigenvalues above ``shift``: positive pivots of the shifted matrix's L D L'."""
        positive, pivot, square = 0, 1.0, 0.0
        for entry, after in zip(self.diagonal, [*self.squares, 0.0], strict=True):
            pivot = entry - shift - square / pivot
            if abs(pivot) < self.least:
                pivot = -self.least
            positive += pivot > 0
            square = after
        return positive


def cut_below(inertia: Inertia, wanted: int, low: float, high: float) -> tuple[float, int]:
    """(shift, count): a shift in a gap of the spectrum with ``count`` eigenvalues above it.

    ``count`` is ``wanted`` unless eigenvalues there agree to rounding, which stay together.
    ``low`` must have at least as many above it, ``high`` fewer.
    """
    floor, tiny = low, 1e-13 * max(abs(low), abs(high))
    count = inertia.above(low)
    if count == wanted:
        inside = low
    else:
        while high - low > tiny:
            middle = (low + high) / 2
            n = inertia.above(middle)
            if n < wanted:
                high = middle
            else:
                low, count = middle, n
            if n == wanted:
                break
        inside = low
    # the ends of the gap: down to the next eigenvalue, up to the last one above
    down, up = floor, high
    above = inside
    for _ in range(12):
        middle = (down + inside) / 2
        if inertia.above(middle) == count:
            inside = middle
        else:
            down = middle
    for _ in range(12):
        middle = (above + up) / 2
        if inertia.above(middle) == count:
            above = middle
        else:
            up = middle
    return (inside + above) / 2, count


def feast(matrix: np.ndarray, low: float, high: float, count: int, nodes: int = NODES,
          seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix between two shifts, ascending."""
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = radius * np.exp(0.5j * np.pi * (points + 1))
    resolvents = [np.linalg.inv((centre + t) * np.eye(d) - matrix) for t in turns]
    size = min(d, count + max(4, count // 2))
    block = np.random.default_rng(seed).standard_normal((d, size))
    while True:
        best = None
        for _ in range(ROUNDS):
            if size < d:
                block = sum(0.5 * w * (t * (r @ block)).real
                            for w, t, r in zip(weights, turns, resolvents, strict=True))
            basis = np.linalg.qr(block)[0]
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turned
            inside = (values > low) & (values < high)
            gaps = np.linalg.norm(matrix @ block - block * values, axis=0)
            worst = float(gaps[inside].max(initial=0))
            if inside.sum() == count and worst <= 4e-15 * norm:
                return values[inside], block[:, inside]
            if best is not None and inside.sum() == count and worst <= 1e-13 * norm and \
                    worst >= 0.5 * best:
                return values[inside], block[:, inside]  # at rounding level
            best = worst if best is None else min(best, worst)
            if size == d:
                break
        if size == d:
            return values[inside], block[:, inside]
        # pairs are missing or slow: a larger block, at last the whole space
        size = min(d, 2 * size)
        more = np.random.default_rng(seed + size).standard_normal((d, size - block.shape[1]))
        block = np.concatenate([block, more], axis=1)


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors (columns).

    Eigenvalues at rounding level (of a space without variance) are left out. A vector's
    largest entry is positive.
    """
    d = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    least = 4 * d * np.finfo(float).eps * top
    inertia = Inertia(matrix)
    wanted = min(wanted, inertia.above(least)) if top > 0 else 0
    values, vectors, high, found = [], [], top, 0
    while found < wanted:
        target = min(wanted, found + INTERVAL)
        low, count = cut_below(inertia, target, least, high)
        own, block = feast(matrix, low, high, count - found)
        if own.size != count - found:
            raise ArithmeticError("eigenvalues are missing between two inertia counts")
        values.append(own[::-1])
        vectors.append(block[:, ::-1])
        high, found = low, count
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    values = np.concatenate(values)[:wanted]
    vectors, triangle = np.linalg.qr(np.concatenate(vectors, axis=1)[:, :wanted])
    vectors = vectors * np.sign(np.diag(triangle))  # intervals meet at right angles too
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values, vectors * sign


# exact sums ------------------------------------------------------------------------------

def limbs(values: np.ndarray) -> np.ndarray:
    """Whole numbers (int64 or Python's) as rows of five limbs that can be added up."""
    out = []
    for _ in range(LIMBS - 1):
        out.append((values & _MASK).astype(np.int64))
        values = values >> 32
    return np.stack([*out, values.astype(np.int64)], axis=-1)


def _number(row) -> int:
    return sum(int(row[name]) << (32 * k) for k, name in enumerate(_SUMS))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists of longs."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0]:offsets[-1]]
    return flat.reshape(len(column), -1)


def gram(rows: np.ndarray) -> np.ndarray:
    """Exact products of the columns: in floating point where no sum can reach 2**53."""
    most = int(np.abs(rows).max(initial=0)) if rows.dtype != object else 2**53
    step = 2**53 // max(1, most * most)
    if step == 0:
        rows = rows.astype(object)
        return rows.T @ rows
    total = np.zeros((rows.shape[1],) * 2, object)
    for lo in range(0, len(rows), step):
        part = rows[lo:lo + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _centred(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Rows minus whole numbers, in Python's numbers if they may not fit."""
    if max(int(np.abs(rows.astype(np.float64)).max(initial=0)),
           int(np.abs(centre.astype(np.float64)).max(initial=0))) >= 2**61:
        return rows.astype(object) - centre.astype(object)
    return rows - centre.astype(np.int64)


def _limb_rows(names: list[np.ndarray], values: np.ndarray) -> pa.RecordBatch:
    parts = limbs(values)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(n.astype(np.int32)) for n in names],
         *[pa.array(parts[:, k]) for k in range(LIMBS)]], ["i", "j", *_SUMS])


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            rows = matrix_of(batch.column("x"))
            own = (rows >> 32).sum(axis=0).astype(object) * 2**32 + (rows & _MASK).sum(axis=0)
            total, n = own if total is None else total + own, n + batch.num_rows
    if total is not None:
        at = np.arange(-1, total.size)  # row -1 counts the vectors
        yield _limb_rows([at, at], np.concatenate([np.array([n], object), total]))


def _products(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = gram(_centred(matrix_of(batch.column("x")), centre))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield _limb_rows([i, j], total[i, j])

    return run


_LIMB_SCHEMA = "i int, j int, " + ", ".join(f"{c} long" for c in _SUMS)


def _summed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j): as many rows as the matrix has entries."""
    found = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect()
    return {(r.i, r.j): _number(r) for r in found}


# whitening -------------------------------------------------------------------------------

@dataclass
class Whitening:
    """Mean (whole part and rest of sums), components and eigenvalues of a list of vectors."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def white(self, rows: np.ndarray) -> np.ndarray:
        """Centred rows projected on the components, each with unit variance."""
        shift = np.array([r / self.n for r in self.rest])
        near = _centred(rows, self.centre).astype(np.float64) - shift
        return near @ (self.vectors / np.sqrt(self.values))

    def deviations(self, rows: np.ndarray) -> list:
        """Sums of (n x - S)**2, exact; None where a long cannot hold it."""
        near, d = _centred(rows, self.centre), rows.shape[1]
        most = max(map(abs, self.rest), default=0)
        if near.dtype != object:
            most += self.n * int(np.abs(near).max(initial=0))
        if near.dtype == object or d * most * most >= 2**63:
            far = near.astype(object) * self.n - np.array(self.rest, object)
            return [int(v) if v < 2**63 else None for v in (far * far).sum(axis=1)]
        far = near * self.n - np.array(self.rest, np.int64)
        return (far * far).sum(axis=1).tolist()


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows without null or non-finite entries."""
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"),
                       F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", finite)).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def fit(fit_list: DataFrame, components: int) -> Whitening | None:
    """Mean and leading components of the distinct vectors ``x``; None if there are none."""
    sums = _summed(fit_list.mapInArrow(_column_sums, _LIMB_SCHEMA))
    if not sums:
        return None
    n, d = sums[-1, -1], len(sums) - 1
    totals = [sums[j, j] for j in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], object)
    rest = [s - n * int(c) for s, c in zip(totals, centre, strict=True)]
    products = _summed(fit_list.mapInArrow(_products(centre), _LIMB_SCHEMA))
    matrix = np.zeros((d, d))
    for (i, j), g in products.items():
        matrix[i, j] = matrix[j, i] = (n * g - rest[i] * rest[j]) / (n * n)
    values, vectors = leading_pairs(matrix, components)
    return Whitening(n, totals, centre, rest, values, vectors, float(np.trace(matrix)))


def _moments(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((model.values.size,) * 2)
        for batch in batches:
            if batch.num_rows:
                white = model.white(matrix_of(batch.column("x")))
                total += white.T @ white
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
             pa.array(total.ravel())], ["i", "j", "total"])

    return run


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened list's covariance minus the identity, measured on the rows."""
    found = fit_list.mapInArrow(_moments(model), "i int, j int, total double").groupBy(
        "i", "j").agg(F.sum("total").alias("total")).collect()
    return max((abs(r.total / model.n - (r.i == r.j)) for r in found), default=0.0)


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, "
           "explained double, identity_error double")


def _results(model: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.values.size
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            rows = matrix_of(batch.column("x"))
            at = np.repeat(np.arange(m), k)
            own = pa.array(model.deviations(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), own.take(pa.array(at)),
                 pa.array(model.white(rows).ravel()),
                 pa.array(np.tile(model.values / model.trace, m)),
                 pa.array(np.full(m * k, error))],
                [part.split()[0] for part in _RESULT.split(", ")])

    return run


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """One row per kept row of ``rows`` and component: its whitened coordinate and the fit's quality.

    Rows with a null vector, or null or non-finite entries, are dropped. The fit uses each
    distinct whole-number vector once. Shorter vectors are filled up with zeros to the longest
    one. Components without variance (all vectors equal, a single vector, fewer dimensions) are
    left out, so such a table may give no row at all; so does an empty table. Components of
    equal eigenvalues are some orthogonal choice, the same for all rows. Entries beyond the
    range of a long are held at its ends; a deviation that a long cannot hold is null. Null or
    repeated ids and repeated rows stay; other columns are ignored, whatever their names. No
    text is read, and a long vector only makes the matrix larger.
    """
    prepare(rows.sparkSession)
    kept = whole_vectors(rows, vec_id, vector)
    sizes = kept.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    none = rows.sparkSession.createDataFrame([], _RESULT)
    if not sizes.high:
        return none
    if sizes.low != sizes.high:
        fill = F.array_repeat(F.lit(0).cast("long"), F.lit(sizes.high) - F.size("x"))
        kept = kept.withColumn("x", F.concat("x", fill))
    fit_list = stored(kept.select("x").distinct())
    model = fit(fit_list, components)
    if model is None or not model.values.size:
        return none
    return kept.mapInArrow(_results(model, identity_error(fit_list, model)), _RESULT)
