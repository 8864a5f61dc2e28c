"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR factor.

Each task folds its centred rows, a block at a time, into one triangular factor R by QR of R stacked on the block; the tasks' factors are folded in the same way, FOLD at a time, so that what reaches the driver is at most FOLD matrices of dimension x dimension, however many rows there are. R has the singular values and right singular vectors of all centred rows, and no covariance is ever squared up. Plane rotations then make R's columns orthogonal, two by two, in sweeps of disjoint pairs, until all are so to working precision; the accumulated rotations are the components, the columns' lengths over sqrt(n) the standard deviations, accurate even where they are small.

Entries c become whole numbers x = floor(64 c) + 1000000, and the sums over rows are exact: n x - S is found without rounding as n (x - m) - r with m = S // n, r = S - n m. The rows are read five times (lengths, sums, factor, check, result) and never shuffle.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry, or one of 2**46 or more in size are left out. Of several lengths the most frequent counts (of equally frequent ones the longest); rows of other lengths are left out. Rows that repeat count as often as they occur; a null vec_id is kept. A component without variance (fewer rows than dimensions, or dependent ones) has explained 0 and a null whitened value, and takes no part in identity_error; if no component has any, explained and identity_error are null. A deviation that no long can hold (from about 10**8 rows on) is null. Tied eigenvalues have components that span their space. No rows left: an empty result. Columns other than vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.llm.shared import shared_table

#: The grid of whole numbers that entries are put on: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components in the result; rows folded at once; factors folded together.
COMPONENTS, BLOCK, FOLD = 32, 4096, 64
#: Rows of the input whose results are made at once.
AT_ONCE = 2048
_LARGE = 1 << 46
_PART = "n long, part binary"


@dataclass(frozen=True)
class Fit:
    """What the result is made from: rows, whole and remaining part of the mean (m, r), components as columns, singular values."""

    n: int
    m: np.ndarray
    r: np.ndarray
    components: np.ndarray
    singular: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        e = self.singular**2
        return e / e.sum() if e.sum() > 0 else np.full(len(e), np.nan)

    @property
    def varies(self) -> np.ndarray:
        """Which components have any variance, beyond rounding."""
        return self.singular > max(self.singular.max(initial=0.0), 1e-300) * len(self.m) * np.finfo(float).eps

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as 64-bit numbers where they hold it, else as Python's."""
        d = x - self.m
        wide = self.n * (int(np.abs(d).max(initial=0)) + 1) >= 1 << 62
        return (d.astype(object) if wide else d) * self.n - self.r

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x's coordinates along the components that vary, over their standard deviations."""
        y = self.deviations(x).astype(float) / self.n
        return y @ (self.components[:, self.varies] / (self.singular[self.varies] / np.sqrt(self.n)))


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values of a, falling; right singular vectors as columns): plane rotations of pairs of columns until all are orthogonal. The pairs of a step are disjoint and turn together."""
    a, d = np.array(a, float), a.shape[1]
    v, places = np.eye(d), list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(places) - 1):
            half = len(places) // 2
            pairs = np.array([(p, q) for p, q in zip(places[:half], places[half:][::-1]) if p < d and q < d], int).reshape(-1, 2)
            places = [places[0], places[-1], *places[1:-1]]
            p, q = pairs[:, 0], pairs[:, 1]
            pp, qq, pq = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            off = np.abs(pq) > 4 * max(d, 8) ** 0.5 * np.finfo(float).eps * np.sqrt(pp) * np.sqrt(qq)
            if not off.any():
                continue
            turned, p, q = True, p[off], q[off]
            with np.errstate(over="ignore"):  # columns of very different lengths hardly turn
                z = (qq[off] - pp[off]) / (2 * pq[off])
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    lengths = np.sqrt((a**2).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers x of a column of lists of length d."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _parts(rows: DataFrame, d: int, start: Callable[[], list[np.ndarray]], add: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]) -> DataFrame:
    """One row a task: its rows, added up block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = start(), 0
        for b in batches:
            for first in range(0, len(b), BLOCK):
                x = _matrix(b.column("embedding").slice(first, BLOCK), d)
                held, n = add(held, x), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_packed(held)], pa.binary())], ["n", "part"])

    return rows.select("embedding").mapInArrow(run, _PART)


def _packed(held: list[np.ndarray]) -> bytes:
    return b"".join(h.astype(np.float64 if h.dtype.kind == "f" else np.int64).tobytes() for h in held)


def _folded(parts: DataFrame, name: str, read: Callable[[bytes], list[np.ndarray]], fold: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> tuple[int, list[np.ndarray] | None]:
    """All tasks' parts folded into one, and how many rows they have: FOLD of them in a task, again and again, until the driver can fold the rest."""
    parts = shared_table(parts, name)
    count = parts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for b in batches:
            for own, part in zip(b.column("n"), b.column("part")):
                got = read(part.as_py())
                held, n = got if held is None else fold(held, got), n + own.as_py()
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_packed(held)], pa.binary())], ["n", "part"])

    while count > FOLD:
        parts = shared_table(parts.repartition(-(-count // FOLD)).mapInArrow(run, _PART), name)
        count = parts.count()
    held, n = None, 0
    for row in parts.collect():
        got = read(bytes(row["part"]))
        held, n = got if held is None else fold(held, got), n + row["n"]
    return n, held


def kept_rows(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that take part, as (vec_id, embedding), and their length; 0 if there are none."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < _LARGE))  # NaN is larger than any number
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & fits & (F.size("embedding") > 0))
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.where(F.size("embedding") == d), d


def _means(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and the mean as a whole part and a remainder out of rows. Sums are kept in two halves, so that none overflows."""

    def add(held: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        return [held[0] + (x >> 26).sum(axis=0), held[1] + (x & (1 << 26) - 1).sum(axis=0)]

    read = lambda b: list(np.frombuffer(b, np.int64).reshape(2, d))
    n, held = _folded(_parts(rows, d, lambda: [np.zeros(d, np.int64)] * 2, add), "whitening-sums", read, lambda a, b: [x + y for x, y in zip(a, b)])
    if held is None:
        return 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
    sums = [(int(high) << 26) + int(low) for high, low in zip(*held)]
    return n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def fit(rows: DataFrame, d: int) -> Fit:
    """The components of rows (embedding) of length d, all of them."""
    n, m, r = _means(rows, d)
    centre = Fit(n, m, r, np.eye(d), np.ones(d))

    def stacked(held: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
        return [np.linalg.qr(np.vstack([*held, *more]), mode="r")]

    def add(held: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        return stacked(held, [centre.deviations(x).astype(float) / n])

    read = lambda b: [np.frombuffer(b, float).reshape(-1, d)]
    _, held = _folded(_parts(rows, d, lambda: [np.zeros((0, d))], add), "whitening-factors", read, stacked)
    singular, components = one_sided_jacobi(held[0] if held else np.zeros((0, d)))
    return Fit(n, m, r, components, singular)


def identity_error(rows: DataFrame, found: Fit, components: int = COMPONENTS) -> float | None:
    """The largest entry, by size, of the whitened rows' covariance less the identity, over the first components that vary."""
    k, d = min(components, int(found.varies.sum())), len(found.m)

    def add(held: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        w = found.whitened(x)[:, :k]  # of centred rows
        return [held[0] + w.T @ w, held[1] + w.sum(axis=0)]

    def read(b: bytes) -> list[np.ndarray]:
        flat = np.frombuffer(b, float)
        return [flat[: k * k].reshape(k, k), flat[k * k :]]

    if not k:
        return None
    n, held = _folded(_parts(rows, d, lambda: [np.zeros((k, k)), np.zeros(k)], add), "whitening-check", read, lambda a, b: [x + y for x, y in zip(a, b)])
    mean = held[1] / n
    return float(np.abs(held[0] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of vectors (vec_id, embedding) that takes part and each of its first components, numbered from 1."""
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = kept_rows(vectors)
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    found = fit(rows, d)
    error, count = identity_error(rows, found, components), min(components, d)
    explained = found.explained[:count]
    seen = np.flatnonzero(found.varies[:count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), AT_ONCE):
                b = whole.slice(first, AT_ONCE)
                x = _matrix(b.column("embedding"), d)
                own = found.deviations(x)
                if own.dtype == object or len(own) and d * int(np.abs(own).max()) ** 2 >= 1 << 63:
                    own = own.astype(object)
                deviation = (own * own).sum(axis=1).tolist()
                deviation = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64())
                values = np.full((len(x), count), np.nan)
                values[:, seen] = found.whitened(x)[:, : len(seen)]
                at = pa.array(np.repeat(np.arange(len(x)), count))
                size = len(x) * count
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(size, found.n)), deviation.take(at),
                        pa.array(values.ravel(), from_pandas=True), pa.array(np.tile(explained, len(x)), from_pandas=True), pa.array(np.full(size, np.nan if error is None else error), from_pandas=True),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
