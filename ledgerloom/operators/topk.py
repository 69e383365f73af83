"""Exact k nearest vectors of many queries, a task at a time: block products, cells with angle bounds, bounded pools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs of one block product, and centres of its cells.
PAIRS, CENTRES = 1 << 22, 32


def rounded(cosine: np.ndarray) -> np.ndarray:
    """Thousandths, halves away from zero."""
    return (np.sign(cosine) * np.floor(np.abs(cosine) * 1000 + 0.5)).astype(np.int32)


def unit_rows(vectors: list, size: int) -> np.ndarray:
    """Vectors as unit rows; zeros for those that are zero, of another size, or hold null or non-finite parts."""
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors, strict=True):
        if v is not None and len(v) == size:
            row[:] = np.asarray(v, np.float64)  # null becomes NaN
    out[~np.isfinite(out).all(axis=1)] = 0
    norms = np.sqrt((out * out).sum(axis=1))
    return np.divide(out, norms[:, None], out=out, where=norms[:, None] > 0)


class TopK:
    """The k best rows of each query among those that a task has seen: by thousandths of the cosine, then by id.

    Rows of a block fall into cells around some of them. A cell's members lie within an angle of its centre, so
    a query's cosine with them is at most that of its angle to the centre less this one; where that cannot reach the
    query's k-th best so far, the cell is left out for it. `pairs` and `compared` count what that saves.
    """

    def __init__(self, queries: list, own: dict[str, list], k: int):
        sizes = sorted({len(q) for q in queries if q is not None})
        self.by_size = {n: unit_rows(queries, n) for n in sizes}
        self.size_of = np.array([-1 if q is None else len(q) for q in queries])
        self.own, self.k, self.n = own, k, len(queries)
        #: Queries by the value of the first own column, where each asks for one.
        self.by_value: dict[object, np.ndarray] = {}
        first = next(iter(own.values()), [None])
        if None not in first:
            for k, value in enumerate(first):
                self.by_value.setdefault(value, []).append(k)
            self.by_value = {value: np.array(at) for value, at in self.by_value.items()}
        self.worst = np.full(self.n, -1001, np.int32)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []
        self.pairs = self.compared = 0

    def add(self, rows: pa.RecordBatch, ids: str, vectors: str) -> None:
        for part, asking, own in self._parts(rows):
            step = max(1, PAIRS // max(1, len(asking)))
            for at in range(0, part.num_rows, step):
                self._block(part.slice(at, step), asking, own, ids, vectors)
        self._prune()

    def _parts(self, rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[str]]]:
        """Rows, the queries that may take them, and the own columns still to be looked at: a part for each value of the first."""
        names = list(self.own)
        if not self.by_value:
            yield rows, np.arange(self.n), names
            return
        places: dict[object, list[int]] = {}
        for k, value in enumerate(rows.column(names[0]).to_pylist()):
            if value in self.by_value:
                places.setdefault(value, []).append(k)
        for value, at in places.items():
            yield rows.take(pa.array(at)), self.by_value[value], names[1:]

    def _allowed(self, rows: pa.RecordBatch, asking: np.ndarray, own: list[str]) -> np.ndarray | None:
        """Which row each query may take, by its own filters; a query's null asks for all."""
        out = None
        for name in own:
            held, wanted = rows.column(name).to_pylist(), self.own[name]
            codes = {v: k for k, v in enumerate(dict.fromkeys(held)) if v is not None}
            row = np.array([codes.get(v, -1) for v in held])
            query = np.array([-3 if wanted[k] is None else codes.get(wanted[k], -2) for k in asking.tolist()])
            fits = (row[:, None] == query[None]) | (query == -3)[None]
            out = fits if out is None else out & fits
        return out

    def _block(self, rows: pa.RecordBatch, asking: np.ndarray, own: list[str], ids: str, vectors: str) -> None:
        held, n = rows.column(vectors).to_pylist(), rows.num_rows
        allowed, worst = self._allowed(rows, asking, own), self.worst[asking]
        marks = np.zeros((n, len(asking)), np.int32)  # 0 where no angle is defined
        reach = np.ones((n, len(asking)), bool) if allowed is None else allowed
        self.pairs += int(reach.sum())
        for size, queries in self.by_size.items():
            asked = np.flatnonzero(self.size_of[asking] == size)
            x, q = unit_rows(held, size), queries[asking[asked]]
            real = np.flatnonzero(x.any(axis=1))
            if not len(real):
                continue
            centres = x[real[:: max(1, len(real) // CENTRES)][:CENTRES]]
            alike = x[real] @ centres.T
            cell = alike.argmax(axis=1)
            angle = np.arccos(np.clip(alike[np.arange(len(real)), cell], -1, 1))
            to_query = np.arccos(np.clip(centres @ q.T, -1, 1))
            for c in np.unique(cell):
                members = real[cell == c]
                most = np.cos(np.maximum(0, to_query[c] - angle[cell == c].max() - 1e-7))
                near = np.floor(most * 1000 + 0.5 + 1e-6) >= worst[asked]
                self.compared += len(members) * int(near.sum())
                marks[np.ix_(members, asked[near])] = rounded(x[members] @ q[near].T)
                reach[np.ix_(members, asked[~near])] = False
        row, query = np.nonzero(reach & (marks >= worst))
        if len(row):
            used, place = np.unique(row, return_inverse=True)
            kept = pa.Table.from_batches([rows]).drop_columns([vectors]).take(pa.array(used))
            id_of = np.asarray(rows.column(ids).to_numpy(zero_copy_only=False))
            self._held(asking[query], marks[row, query], id_of[row], kept, place)

    def _held(self, query: np.ndarray, mark: np.ndarray, key: np.ndarray, rows: pa.Table, place: np.ndarray) -> None:
        order = self._first(query, mark, key)
        self.pool.append((query[order], mark[order], key[order], rows.take(pa.array(place[order]))))

    def _first(self, query: np.ndarray, mark: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Positions of the k first of each query."""
        order = np.lexsort((key, -mark, query))
        sorted_query = query[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]]))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        return order[rank < self.k]

    def _prune(self) -> None:
        """Keep k rows a query, and know the worst of a full k."""
        if len(self.pool) < 2 and not (self.pool and len(self.pool[0][0])):
            return
        query, mark, key = (np.concatenate([p[i] for p in self.pool]) for i in range(3))
        order = self._first(query, mark, key)
        rows = pa.concat_tables([p[3] for p in self.pool]).take(pa.array(order))
        query, mark, key = query[order], mark[order], key[order]
        self.pool = [(query, mark, key, rows)]
        n = np.bincount(query, minlength=self.n)
        ends = np.cumsum(n)
        full = n >= self.k
        self.worst[full] = mark[ends[full] - 1]

    def results(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
        """(positions of queries, thousandths, rows) of what is kept."""
        for query, mark, _, rows in self.pool:
            yield query, mark, rows
