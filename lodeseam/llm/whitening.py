"""Whitening of embeddings by compensated covariance.

Entries become whole numbers ``x = floor(256 * c)``; the fit is over the distinct vectors. A first pass adds up each
dimension exactly. A second centres the vectors, multiplies them out and adds the products up in double-double: every
product and sum is an error-free transformation (Dekker's product with Veltkamp's splitting, Knuth's sum), so that a sum
is a high and a low part. A task gives one such pair for each row of its matrix; tasks' pairs are merged by matrix row,
high and low parts together, each row in one place, in a stream that holds one row of numbers a key. The covariance, once
rounded, goes to LAPACK's symmetric solver (numpy's ``eigh``, ``syevd``): Householder reduction to a tridiagonal matrix,
then divide and conquer. A third pass measures the whitened vectors' own covariance in the same way.

What reaches the driver are sums and one matrix for each length of vector: at most ``MOST_CELLS`` numbers, whatever the
rows. Copies of a vector, be they a third of all, are one after a distinct that sums up before it moves.

Rows whose vector is null or holds a null or an entry that isn't finite are left out; all others are returned, copies too.
Vectors of different lengths are spaces of their own, each fitted for itself; one of no entries gives no rows. A length of
d has min(4, d) components. Where an eigenvalue is 0 (fewer distinct vectors than components, a dimension without
variance) ``whitened`` is null, where the whole variance is 0 ``explained`` too; ``identity_error`` is over the
components that have one. ``deviation`` is null where it does not fit a long; ``deviation_exact`` has its digits. Numbers
beyond a long take its ends. Empty input gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import settle

COMPONENTS = 4
#: Numbers in the matrices of all lengths together: one of 4096 dimensions.
MOST_CELLS = 1 << 24
#: Numbers that a block of products holds.
BLOCK = 1 << 19
#: An eigenvalue below this share of the largest counts as 0.
NOTHING = 1e-12


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knuth: a + b = s + e exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dekker: a * b = p + e exactly, the factors split by Veltkamp."""

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = 134217729.0 * x  # 2 ** 27 + 1
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    return s + e, e - ((s + e) - s)


def products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangles, as one row of numbers, of the sum of the outer products of rows of double-doubles."""
    d = high.shape[1]
    i, j = np.triu_indices(d)
    total = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, BLOCK // max(len(i), 1))
    for at in range(0, len(high), step):
        h, o = high[at : at + step], low[at : at + step]
        ph, pl = two_product(h[:, i], h[:, j])
        pl = pl + (h[:, i] * o[:, j] + o[:, i] * h[:, j])
        while len(ph) > 1:  # halves are added, an odd row waits
            half = len(ph) // 2
            sh, sl = add(ph[:half], pl[:half], ph[half : 2 * half], pl[half : 2 * half])
            ph, pl = (np.concatenate([s, p[2 * half :]]) for s, p in ((sh, ph), (sl, pl)))
        total = add(*total, ph[0], pl[0])
    return total


@dataclass
class Space:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None  # a column each
    eigenvalues: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float | None = None

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """Double-doubles of the means."""
        exact = [Fraction(s, self.n) for s in self.sums]
        high = np.array([float(m) for m in exact])
        return high, np.array([float(m - Fraction(h)) for m, h in zip(exact, high.tolist())])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = x.astype(float)
        low = (x - np.clip(high, -(2.0**63), 2.0**63 - 1024).astype(np.int64)).astype(float)
        mh, ml = self.means()
        return add(high, low, *np.broadcast_arrays(-mh, high)[:1], *np.broadcast_arrays(-ml, high)[:1])

    def deviations(self, x: np.ndarray) -> list[int]:
        most = max(np.abs(x.astype(float)).max(initial=0), 1.0) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 2**62 else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        return (y * y).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.real(), (self.centred(x)[0] @ self.components) / np.sqrt(self.eigenvalues), np.nan)

    def real(self) -> np.ndarray:
        return self.eigenvalues > NOTHING * max(self.trace, np.finfo(float).tiny)


def clean(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(c * 256).cast("long"))
    return embeddings.where(vector.isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of a batch's vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def exact_sums(fit: DataFrame) -> dict[int, Space]:
    """How many vectors, and their sums, of each length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at, x in by_length(batch.column(0)):
                kind = np.int64 if len(at) * float(np.abs(x.astype(float)).max(initial=0)) < 2**62 else object
                old = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                held[x.shape[1]] = [old[0] + len(at), [a + b for a, b in zip(old[1], x.astype(kind).sum(axis=0).tolist())]]
        for d, (n, sums) in held.items():
            if d:
                yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["d", "i", "n", "s"])

    lengths = fit.select(F.size("x").cast("long").alias("d")).distinct().agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0
    if lengths > MOST_CELLS:
        raise ValueError(f"the matrices of all lengths of vector have {lengths} numbers; {MOST_CELLS} is the most")
    rows = fit.mapInArrow(work, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    out: dict[int, Space] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["d"], r["i"])):
        out.setdefault(r["d"], Space(r["n"], [])).sums.append(int(r["s"]))
    return out


def moments(fit: DataFrame, spaces: dict[int, Space], projected: bool) -> dict[int, np.ndarray]:
    """Covariances of the centred or of the whitened vectors: products are summed up by task, then by matrix row."""
    kind = "d int, i int, high array<double>, low array<double>"

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (d, i), (high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.float64()))], ["d", "i", "high", "low"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                if space := spaces.get(x.shape[1]):
                    if projected:
                        high = space.whitened(x)[:, space.real()]
                        low = np.zeros_like(high)
                    else:
                        high, low = space.centred(x)
                    new = products(high, low)
                    held[x.shape[1]] = add(*held[x.shape[1]], *new) if x.shape[1] in held else new
        for d, (high, low) in held.items():
            size = int((np.sqrt(8 * len(high) + 1) - 1) / 2)
            ends = np.cumsum(np.arange(size, 0, -1))
            yield from rows({(d, i): (high[e - size + i : e], low[e - size + i : e]) for i, e in enumerate(ends.tolist())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, i, high, low in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.array(high), np.array(low)
                held[d, i] = add(*held[d, i], *new) if (d, i) in held else new
        yield from rows(held)

    found = fit.mapInArrow(multiply, kind).repartition("d", "i").mapInArrow(merge, kind).collect()
    out: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = defaultdict(int)
    for r in found:
        sizes[r["d"]] += 1
    for r in found:
        d, i = r["d"], r["i"]
        whole = out.setdefault(d, np.zeros((sizes[d], sizes[d])))
        whole[i, i:] = whole[i:, i] = (np.array(r["high"]) + np.array(r["low"])) / spaces[d].n
    return out


def fit_spaces(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The components of each length of vector, from ``clean`` rows."""
    fit = settle(rows.select("x").distinct())
    spaces = exact_sums(fit)
    for d, v in moments(fit, spaces, projected=False).items():
        space, k = spaces[d], min(components, d)
        values, vectors = np.linalg.eigh(v)
        space.trace, space.eigenvalues, chosen = float(np.trace(v)), np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
        space.components = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    for d, v in moments(fit, spaces, projected=True).items():
        spaces[d].identity_error = float(np.abs(v - np.eye(len(v))).max())
    return spaces


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)``."""
    rows = clean(embeddings)
    spaces = fit_spaces(rows, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
            for at, x in by_length(batch.column(1)):
                if not (space := spaces.get(x.shape[1])):
                    continue
                k, m = len(space.eigenvalues), len(at)
                z, exact = space.whitened(x).ravel(), space.deviations(x)
                share = space.eigenvalues / space.trace if space.trace > 0 else np.full(k, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[at], k), pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, space.n), pa.int64()),
                        pa.array([e if e < 2**63 else None for e in exact for _ in range(k)], pa.int64()),
                        pa.array(z, pa.float64(), from_pandas=True),
                        pa.array(np.tile(share, m), pa.float64(), from_pandas=True),
                        pa.array([space.identity_error] * (m * k), pa.float64()),
                        pa.array([str(e) for e in exact for _ in range(k)], pa.string()),
                    ],
                    names,
                )

    return rows.mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
