"""Pairs of vectors whose cosine lies in a band, by products of blocks: a task holds two blocks and passes pairs on as it goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import r

#: Blocks that a group's vectors beyond a block's rows are shared out to, and bytes of a block's vectors at most (from there, more blocks).
BLOCKS, BLOCK_BYTES = 8, 8 << 20
#: Rows of one product, those it meets at once, and pairs that a task gathers before it passes them on.
ROWS, OTHERS, PASSED = 512, 4096, 1 << 16
#: What rounding to four places may move a cosine by.
MARGIN = 6e-5


def block_count(vector: str, least: int) -> Column:
    """Aggregate: blocks of a group, of `least` rows or, in larger groups, of a share of the rows up to BLOCK_BYTES."""
    n, size = F.count("*"), 8 * F.greatest(F.max(F.size(vector)), F.lit(1))
    return F.greatest(F.lit(1), F.ceil(n / F.greatest(F.lit(least), F.least(F.ceil(n / BLOCKS), F.floor(F.lit(BLOCK_BYTES) / size)))))


def blocks_of(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def by_size(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by length; empty, null and partly null vectors are left out, as their cosine is 0; so is that of a zero vector."""
    held = vectors.combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    sizes = np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat, starts = held.flatten(), np.concatenate([[0], np.cumsum(sizes)])
    whole = np.ones(len(held), bool)
    if flat.null_count:
        missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole = missing[starts[1:]] == missing[starts[:-1]]
    values, out = flat.to_numpy(zero_copy_only=False).astype(np.float64), {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero((sizes == size) & whole)
        x = values[starts[rows][:, None] + np.arange(size)]
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        out[size] = rows, np.divide(x, norms[:, None], out=x, where=norms[:, None] != 0)  # with NaN there is no cosine
    return out


def in_band(left: pa.ChunkedArray, right: pa.ChunkedArray, lo: float, hi: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the left, of the right, cosines) of all pairs in the band, give or take MARGIN; a product of blocks at a time."""
    a, b = by_size(left), by_size(right)
    for at in range(0, len(left), ROWS):
        for to in range(0, len(right), OTHERS):
            n, m = min(ROWS, len(left) - at), min(OTHERS, len(right) - to)
            if lo - MARGIN <= 0 <= hi + MARGIN:  # pairs without a cosine count as 0
                cosines = np.zeros((n, m))
                for size in a.keys() & b.keys():
                    (i, x), (j, y) = (_slice(s[size], k, k + c) for s, k, c in ((a, at, n), (b, to, m)))
                    cosines[np.ix_(i - at, j - to)] = x @ y.T
                i, j = np.nonzero((cosines >= lo - MARGIN) & (cosines <= hi + MARGIN))
                yield i + at, j + to, cosines[i, j]
                continue
            for size in a.keys() & b.keys():
                (rows, x), (cols, y) = (_slice(s[size], k, k + c) for s, k, c in ((a, at, n), (b, to, m)))
                cosines = x @ y.T
                i, j = np.nonzero((cosines >= lo - MARGIN) & (cosines <= hi + MARGIN))
                yield rows[i], cols[j], cosines[i, j]


def _slice(held: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    rows, x = held
    a, b = np.searchsorted(rows, (start, stop))
    return rows[a:b], x[a:b]


def gathered(parts: Iterator[list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Parts of a few rows as batches of some PASSED rows."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(pa.RecordBatch.from_arrays(part, names))
            n += len(part[0])
        if n >= PASSED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def similar(pairs: DataFrame, lo: float, hi: float) -> DataFrame:
    """Pairs whose cosine, rounded to four places, is in the band: (..., similarity). Only near its ends is it rounded to decide."""
    inside = F.col("cosine").between(lo + MARGIN, hi - MARGIN)
    return pairs.where(inside | r(F.col("cosine"), 4).between(lo, hi)).withColumn("similarity", r(F.col("cosine"), 4)).drop("cosine")


def pairs_within(rows: DataFrame, lo: float, hi: float, block: int) -> DataFrame:
    """(g, x_id, y_id, cosine): pairs of rows (g, id, v) of one group, each once in either order, give or take MARGIN.

    A group's rows are dealt to blocks by a hash of the id; a task compares two of them, or one with itself.
    """
    rows = rows.where("g is not null and id is not null and v is not null")
    sizes = rows.groupBy("g").agg(block_count("v", block).alias("_n"))
    own = rows.join(sizes, "g").withColumn("s", F.pmod(F.xxhash64("id"), "_n")).withColumn("t", F.explode(blocks_of("_n")))
    dealt = own.select("g", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), (F.col("s") > F.col("t")).alias("second"), "id", "v")
    schema = f"g {rows.schema['g'].dataType.simpleString()}, x_id {rows.schema['id'].dataType.simpleString()}, y_id {rows.schema['id'].dataType.simpleString()}, cosine double"

    def compared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if same := key[1].as_py() == key[2].as_py():
            left = right = table.select(["id", "v"])
        else:
            second = table.column("second")
            left, right = table.filter(pa.compute.invert(second)).select(["id", "v"]), table.filter(second).select(["id", "v"])

        def parts() -> Iterator[list[pa.Array]]:
            for i, j, cosine in in_band(left.column("v"), right.column("v"), lo, hi):
                if same:
                    later = i < j
                    i, j, cosine = i[later], j[later], cosine[later]
                ids = [side.column("id").take(pa.array(k)).combine_chunks() for side, k in ((left, i), (right, j))]
                yield [pa.repeat(key[0], len(i)), *ids, pa.array(cosine)]

        yield from gathered(parts(), ["g", "x_id", "y_id", "cosine"])

    return dealt.groupBy("g", "a", "b").applyInArrow(compared, schema)


def pairs_across(rows: DataFrame, keys: list[str], lo: float, hi: float, block: int = 2000) -> DataFrame:
    """(keys..., a_id, b_id, cosine): pairs of a row of side 0 and one of side 1 with equal keys, other ids and other periods, give or take MARGIN.

    rows: (keys..., id, period, v, side). Of a pair the row of the earlier period, by its letters, comes first. Both sides
    of a group are dealt to blocks; a task compares a block of one with one of the other.
    """
    rows = rows.select(*keys, "id", F.encode("period", "utf-8").alias("period"), "v", "side").where(" and ".join(f"{c} is not null" for c in [*keys, "id", "period", "v"]))
    sizes = rows.groupBy(*keys, "side").agg(block_count("v", block).alias("_n"))
    sizes = sizes.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == k, F.col("_n"))).alias(f"_n{k}") for k in (0, 1)]).where("_n0 is not null and _n1 is not null")
    own = lambda k: F.pmod(F.xxhash64("id"), f"_n{k}")
    grid = F.when(F.col("side") == 0, F.transform(blocks_of("_n1"), lambda t: F.struct(own(0).alias("s"), t.alias("t"))))
    grid = grid.otherwise(F.transform(blocks_of("_n0"), lambda s: F.struct(s.alias("s"), own(1).alias("t"))))
    dealt = rows.join(sizes, keys).select(*keys, "id", "period", "v", "side", F.inline(grid))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys]
    kind = rows.schema["id"].dataType.simpleString()

    def compared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right = (table.filter(pa.compute.equal(table.column("side"), k)) for k in (0, 1))
        order = {p: k for k, p in enumerate(sorted(set(table.column("period").to_pylist())))}
        period = [np.array([order[p] for p in side.column("period").to_pylist()], np.int64) for side in (left, right)]
        ids = [side.column("id").combine_chunks() for side in (left, right)]

        def parts() -> Iterator[list[pa.Array]]:
            for i, j, cosine in in_band(left.column("v"), right.column("v"), lo, hi):
                other = period[0][i] != period[1][j]
                i, j, cosine = i[other], j[other], cosine[other]
                x, y = ids[0].take(pa.array(i)), ids[1].take(pa.array(j))
                first = pa.array(period[0][i] < period[1][j])
                a, b = pa.compute.if_else(first, x, y), pa.compute.if_else(first, y, x)
                cells = [*[pa.repeat(k, len(i)) for k in key[: len(keys)]], a, b, pa.array(cosine)]
                yield [c.filter(pa.compute.not_equal(x, y)) for c in cells]

        yield from gathered(parts(), [*keys, "a_id", "b_id", "cosine"])

    return dealt.groupBy(*keys, "s", "t").applyInArrow(compared, f"{', '.join(kinds)}, a_id {kind}, b_id {kind}, cosine double")
