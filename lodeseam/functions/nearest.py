"""The k nearest vectors of many questions, for tasks in Python: one matrix product for each pair of blocks finds who may be
among the k, and only these are scored as ``functions.vectors`` scores, term after term, so that scores are the same.

A block is some rows of a table and is at most ``BLOCK_BYTES`` of numbers, or one row. What cannot go through a product (nulls,
entries that are not finite, norms of zero or beyond ``NORMS``, another length) is scored pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of vectors in a block, rows of a block that are multiplied at a time, and pairs that are scored at a time.
BLOCK_BYTES, TILE, PAIRS = 4 << 20, 2048, 1 << 16
#: Squared norms for which no term of a product overflows or loses all its bits.
NORMS = (1e-200, 1e200)
#: Columns of a tile of which only the best counts when it is told how far the k best reach at least.
GROUP = 32


def written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int, key: str | None = None, k: int = 0) -> Iterator[pa.RecordBatch]:
    """``(at, block)``: the rows, written as blocks with a number each. With a key, rows go by it, and of rows with one vector
    only the first k stay, as no more can be among the k nearest of anything."""
    held, size, made = [], 0, TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if key is not None:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(key, "ascending")], null_placement="at_start"))
            rows = rows.take(pa.array(np.sort(firsts(rows.column(rows.schema.get_field_index(column)), k))))
        return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([written(rows)], pa.binary())], ["at", "block"])

    for batch in batches:
        start = 0
        while start < batch.num_rows:
            each = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // batch.num_rows)
            part = batch.slice(start, max(1, (limit - size) // each))
            start += part.num_rows
            held.append(part)
            size += part.num_rows * each
            if size + each > limit:
                yield block()
                held, size, made = [], 0, made + 1
    if held:
        yield block()


def firsts(column: pa.Array, k: int) -> np.ndarray:
    """The first k rows of each vector."""
    out = []
    for _, rows, matrix in matrices(column):
        if not matrix.shape[1]:
            out.append(rows[:k])
            continue
        name = np.unique(matrix.view(np.dtype((np.void, 8 * matrix.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(name, kind="stable")
        new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
        start = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        out.append(rows[order[place < k]])
    return np.concatenate(out)


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, matrix)`` for each length of vectors; null ones and those with a null entry have length -1."""
    values = column.flatten()
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    if values.null_count:
        nulls = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
        holed = (size > 0) & (nulls[start + np.maximum(size, 0)] > nulls[start])
    else:
        holed = np.zeros(len(size), bool)
    values = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    kind = np.where(holed, -1, size)
    for length in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == length)
        place = start[rows][:, None] + np.arange(max(length, 0))
        yield length, rows, np.ascontiguousarray(values[place], np.float64)


def in_order(terms: np.ndarray) -> np.ndarray:
    """Sums of the rows, one term after another from 0.0."""
    return np.add.accumulate(terms, axis=1)[:, -1] + 0.0 if terms.shape[1] else np.zeros(len(terms))


class Side:
    """The vectors of a block that have one length."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray):
        self.rows, self.matrix = rows, matrix
        with np.errstate(all="ignore"):
            square = in_order(matrix * matrix)
            self.norm = np.sqrt(square)
            self.plain = (square >= NORMS[0]) & (square <= NORMS[1])


def sides(column: pa.Array) -> dict[int, Side]:
    return {length: Side(rows, matrix) for length, rows, matrix in matrices(column)}


def scores(metric: str, a: Side, b: Side, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each pair, and whether it is null."""
    x, y = a.matrix[q], b.matrix[v]
    none = np.zeros(len(q), bool)
    with np.errstate(all="ignore"):
        if metric == "euclidean":
            gap = y - x
            return np.sqrt(in_order(gap * gap)), none
        dot = in_order(y * x)
        if metric == "dotproduct":
            return dot, none
        by = b.norm[v] * a.norm[q]
        return dot / by, by == 0


class Best:
    """The best k of each of n questions: question, place, score, whether that is null; by question, best first."""

    def __init__(self, n: int, k: int, largest: bool):
        self.n, self.k, self.sign = n, k, 1.0 if largest else -1.0
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, bool))

    def add(self, q: np.ndarray, place: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        q, place, score, null = (np.concatenate(x) for x in zip(self.rows, (q, place, score, null)))
        number = np.isnan(score)
        order = np.lexsort((place, np.where(null | number, 0.0, -self.sign * score), ~number, null, q))
        q = q[order]
        start = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - start[q] < self.k
        self.rows = (q[keep], place[order][keep], score[order][keep], null[order][keep])

    def reach(self) -> np.ndarray:
        """The signed score that one must have to be among the k, as far as it is known."""
        q, _, score, null = self.rows
        out = np.full(self.n, -np.inf)
        last = np.searchsorted(q, np.arange(self.n)) + self.k - 1
        full = np.bincount(q, minlength=self.n) == self.k
        known = np.flatnonzero(full)
        known = known[~null[last[known]] & ~np.isnan(score[last[known]])]
        out[known] = self.sign * score[last[known]]
        return out


def plain_pairs(metric: str, a: Side, b: Side, reach: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what may be among the k of the plain vectors' pairs. Both ways to sum up a product of d terms lie
    within d + 1 units in the last place of the norms' product, and ``slack`` is four times that and more for the rest."""
    questions, others = np.flatnonzero(a.plain), np.flatnonzero(b.plain)
    if not len(questions) or not len(others):
        return
    unit = (8 * a.matrix.shape[1] + 64) * 2.0**-53
    norm = a.norm[questions]
    left = a.matrix[questions]
    if metric == "cosine":
        left = left / norm[:, None]
    for t in range(0, len(others), TILE):
        tile = others[t : t + TILE]
        right = b.matrix[tile]
        top = b.norm[tile].max()
        goal = np.maximum(reach, best.reach())[a.rows[questions]]
        if metric == "cosine":
            near = left @ (right / b.norm[tile][:, None]).T
            slack = np.full(len(norm), unit)
        elif metric == "dotproduct":
            near = left @ right.T
            slack = unit * norm * top
        else:
            # the nearer, the larger is q * v - v * v / 2
            near = left @ right.T
            near -= b.norm[tile] ** 2 / 2
            known = np.where(np.isinf(goal), 0.0, goal)
            slack = unit * (norm**2 + top**2 + known**2)
            goal = np.where(np.isinf(goal), -np.inf, (norm**2 - known**2) / 2)
        floor = goal - slack
        if np.isinf(goal).any():
            groups = len(tile) // GROUP
            seen = near[:, : groups * GROUP].reshape(len(norm), GROUP, groups).max(axis=1) if groups >= best.k else near
            if seen.shape[1] >= best.k:
                least = np.partition(seen, seen.shape[1] - best.k, axis=1)[:, seen.shape[1] - best.k]
                floor = np.maximum(floor, least - 2 * slack)
        found = np.flatnonzero(near >= floor[:, None])
        for i in range(0, len(found), PAIRS):
            q, v = questions[found[i : i + PAIRS] // len(tile)], tile[found[i : i + PAIRS] % len(tile)]
            best.add(a.rows[q], b.rows[v], *scores(metric, a, b, q, v))


def other_pairs(metric: str, a: Side, b: Side, best: Best) -> None:
    """Adds to ``best`` the pairs of which one vector is not plain."""
    for questions, others in ((np.flatnonzero(~a.plain), np.arange(len(b.rows))), (np.flatnonzero(a.plain), np.flatnonzero(~b.plain))):
        for i in range(0, len(questions) * len(others), PAIRS):
            pair = np.arange(i, min(i + PAIRS, len(questions) * len(others)))
            q, v = questions[pair // len(others)], others[pair % len(others)]
            best.add(a.rows[q], b.rows[v], *scores(metric, a, b, q, v))


def block_best(metric: str, asked: dict[int, Side], held: dict[int, Side], best: Best, reach: np.ndarray) -> None:
    """Adds to ``best`` the k nearest in a block for each question of another."""
    for n, a in asked.items():
        for m, b in held.items():
            if n == m and n >= 0:
                plain_pairs(metric, a, b, reach, best)
                other_pairs(metric, a, b, best)
            else:
                # null scores, by key
                q, v = np.repeat(a.rows, min(best.k, len(b.rows))), np.tile(b.rows[: best.k], len(a.rows))
                best.add(q, v, np.zeros(len(q)), np.ones(len(q), bool))


def search(batches: Iterable[pa.RecordBatch], k: int, metric: str, largest: bool, key: str, vector: str, wanted: str) -> Iterator[pa.RecordBatch]:
    """From pairs of blocks ``(block, at, asked)`` of vectors and questions to the k nearest of each question among all
    vectors met: the columns of both but the vectors, and ``vector_score``. Holds k rows for each question met."""
    questions: dict[int, tuple[pa.RecordBatch, dict[int, Side]]] = {}
    bests: dict[int, tuple[Best, pa.Table | None]] = {}
    last, held, rows = None, {}, None
    for batch in batches:
        for n in range(batch.num_rows):
            block, at, asked = (batch.column(c)[n] for c in range(3))
            at = at.as_py()
            if at not in questions:
                table = opened(asked.as_py())
                questions[at] = (table.drop_columns([wanted]), sides(table.column(wanted)))
                bests[at] = (Best(table.num_rows, k, largest), None)
            data = block.as_buffer()
            if last is None or not last.equals(data):
                last, whole = data, opened(data)
                held, rows = sides(whole.column(vector)), whole.drop_columns([vector])
            before, taken = bests[at]
            own = Best(before.n, k, largest)
            block_best(metric, questions[at][1], held, own, before.reach())
            bests[at] = merged(before, taken, own, rows, key)
    for at, (best, taken) in bests.items():
        q, _, score, null = best.rows
        if len(q):
            more = questions[at][0].take(pa.array(q))
            score = pa.array(score, pa.float64(), mask=null)
            table = taken.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*table.columns, *more.columns, score], [*table.schema.names, *more.schema.names, "vector_score"])


def merged(before: Best, taken: pa.Table | None, own: Best, rows: pa.RecordBatch, key: str) -> tuple[Best, pa.Table]:
    """The best of two, and their vectors' other columns, a row for each. Places are those of the rows by key."""
    best = Best(own.n, own.k, own.sign > 0)
    more = pa.Table.from_batches([rows.take(pa.array(own.rows[1]))])
    every = more if taken is None else pa.concat_tables([taken, more])
    order = pc.sort_indices(every, sort_keys=[(key, "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    q, _, score, null = (np.concatenate(x) for x in zip(before.rows, own.rows))
    best.add(q, place, score, null)
    return best, every.take(pa.array(order[best.rows[1]]))
