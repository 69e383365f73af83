"""Exact near-duplicate vectors by dual traversal of cover trees.

Unit vectors with a cosine of at least t lie within sqrt(2 - 2t) of each other. Equal vectors are
collapsed first. A greedy net over a bounded sample gives centres; every vector goes to the cell of its
nearest centre, and to the cells that the halfspace bound leaves within reach. A task is a pair of cells,
cut into blocks. A block holds CELL vectors or, of larger tables, a share of them of up to BLOCK_BYTES, so that a vector
is sent to few blocks and no task grows beyond that. There, cover trees with
halving radii are built on both sides and walked together: node pairs further apart than their covering
radii allow are pruned, pairs wholly within the radius are counted at once, and leaves are compared: by products in
single precision with a margin for its error, and what passes in double precision. Where a net of half the radius does not thin a node out, as with vectors in random
directions, the node is a leaf.

A task returns a row a vector at most: its links there and the smallest node of its local group, never
its pairs. Groups are then joined by connected components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and so do rows with a null id; vectors of different lengths never link; repeated rows count as
vectors of their own; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import connected_components, staged

#: Vectors of one block, vectors sampled for the centres, most centres.
CELL, SAMPLE, CENTRES = 4000, 4096, 1024
#: Blocks that vectors beyond CELL are shared out to, and the bytes of a block's vectors at most (from there, more blocks).
BLOCKS, BLOCK_BYTES = 12, 32 << 20
#: Bytes of vectors that a task deals out at once.
DEALT_BYTES = 4 << 20
#: Vectors of a leaf, children of a node, rows compared at once, and with how many others.
LEAF, CHILDREN, ROWS, OTHERS = 48, 24, 512, 4096
#: Vectors that the balls of a net must hold on the average for a node to have children.
THIN = 3


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def build(x: np.ndarray, rows: np.ndarray, level: float = 2.0) -> Node:
    """A cover tree of x[rows]: the children of a node cover it by a net of half its level's radius."""
    centre = x[rows[0]]
    apart = np.sqrt(np.maximum(0, ((x[rows] - centre) ** 2).sum(axis=1)))
    node = Node(centre, float(apart.max()), rows)
    if len(rows) <= LEAF or node.radius < 1e-6:
        return node
    half = level / 2
    while half > node.radius:
        half /= 2
    left, parts = rows, []
    while len(left) and len(parts) < CHILDREN:
        near = ((x[left] - x[left[0]]) ** 2).sum(axis=1) <= half * half
        parts.append(left[near])
        left = left[~near]
    if len(left) and (len(rows) - len(left)) < THIN * len(parts):
        return node  # the net does not thin it out
    node.children = [build(x, p, half) for p in parts]
    if len(left):
        node.children.append(build(x, left, half * 2))
    return node


class Walk:
    """Dual traversal of two trees, or of one with itself."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.weight, self.threshold = x, weight, threshold
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.single = x.astype(np.float32)
        self.least = threshold - 1e-7 * (x.shape[1] + 8)  # what a product in single precision may be off
        self.links = np.zeros(len(x), np.int64)
        self.label = np.arange(len(x))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.compared = 0  # pairs whose cosine was taken

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append((a, b))
        self.held += len(a)
        if self.held > 500_000:
            self.settle()

    def settle(self) -> np.ndarray:
        """Smallest row of each local group so far."""
        if self.pairs:
            a, b = (np.concatenate(p) for p in zip(*self.pairs, strict=True))
            while True:
                low = np.minimum(self.label[a], self.label[b])
                before = self.label.copy()
                np.minimum.at(self.label, self.label[a], low)
                np.minimum.at(self.label, self.label[b], low)
                self.label = self.label[self.label]
                if (before == self.label).all():
                    break
            self.pairs, self.held = [], 0
        return self.label

    def _leaves(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for k in range(0, len(a), ROWS):
            own = a[k : k + ROWS]
            first = k if same else 0
            self.compared += len(own) * (len(b) - first)
            mine = self.single[own]
            for m in range(first, len(b), OTHERS):
                others = b[m : m + OTHERS]
                i, j = np.nonzero(mine @ self.single[others].T >= self.least)
                if same:
                    later = j + m > i + k
                    i, j = i[later], j[later]
                if len(i):
                    self._near(own[i], others[j])

    def _near(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link those of the pairs, of one block product, that reach the threshold in double precision."""
        (rows, i), (cols, j) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        near = (self.x[rows] @ self.x[cols].T)[i, j] >= self.threshold
        a, b = a[near], b[near]
        if len(a):
            self.links += np.bincount(a, self.weight[b], len(self.x)).astype(np.int64) + np.bincount(b, self.weight[a], len(self.x)).astype(np.int64)
            self._add(a, b)

    def across(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            apart = float(np.linalg.norm(a.centre - b.centre))
            if apart > a.radius + b.radius + self.reach + 1e-9:
                continue
            if apart + a.radius + b.radius < self.reach - 1e-9:
                self.links[a.rows] += self.weight[b.rows].sum()
                self.links[b.rows] += self.weight[a.rows].sum()
                every = np.concatenate([a.rows, b.rows])
                self._add(np.concatenate([a.rows, b.rows[1:]]), np.concatenate([np.full(len(a.rows), b.rows[0]), np.full(len(b.rows) - 1, a.rows[0])]))
                del every
            elif not a.children and not b.children:
                self._leaves(a.rows, b.rows, False)
            elif not b.children or (a.children and a.radius >= b.radius):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]

    def within(self, node: Node) -> None:
        stack = [node]
        while stack:
            a = stack.pop()
            if 2 * a.radius < self.reach - 1e-9:
                self.links[a.rows] += self.weight[a.rows].sum() - self.weight[a.rows]
                self._add(a.rows[1:], np.full(len(a.rows) - 1, a.rows[0]))
            elif not a.children:
                self._leaves(a.rows, a.rows, True)
            else:
                for k, c in enumerate(a.children):
                    stack.append(c)
                    for d in a.children[k + 1 :]:
                        self.across(c, d)


def units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def greedy_net(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` centres, each the point furthest from those before it."""
    picked = [0]
    apart = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(most, len(x)) and apart.max() > 1e-9:
        picked.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("id").isNotNull(), F.lit(False)))
    classes = staged(rows.where("sound").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")))

    def packed(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "n": pdf["n"], "dim": pdf["v"].map(len), "raw": [np.asarray(v, kind).tobytes() for v in pdf["v"]]})

    points = staged(classes.mapInPandas(packed, "node long, n long, dim int, raw binary"))
    count = points.count()
    sample = points.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("dim", "raw").toPandas()  # at most SAMPLE vectors
    size = 8 * max([1, *sample["dim"]])
    cell = max(cell, min(count // BLOCKS, BLOCK_BYTES // size))
    most = max(1, min(CENTRES, math.ceil(count / cell)))
    centres = {int(d): greedy_net(units(list(p["raw"]), kind), most) for d, p in sample.groupby("dim")}
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    shared = spark.sparkContext.broadcast(centres)

    def assigned(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                net = shared.value.get(int(dim))
                home, near = np.zeros(len(part), np.int64), [[0]] * len(part)
                if net is not None:
                    x = units(list(part["raw"]), kind)
                    square = np.maximum(0, 2 - 2 * x @ net.T)
                    home = square.argmin(axis=1)
                    between = np.sqrt(np.maximum(1e-18, 2 - 2 * net @ net.T))[home]
                    beyond = (square - square.min(axis=1)[:, None]) / (2 * between)
                    beyond[np.arange(len(part)), home] = 0
                    near = [np.flatnonzero(b <= reach).tolist() for b in beyond]
                yield part[["node", "n", "dim", "raw"]].assign(home=home, near=near)

    homes = staged(points.mapInPandas(assigned, "node long, n long, dim int, raw binary, home int, near array<int>"))
    blocks = {(r["dim"], r["home"]): max(1, math.ceil(r["count"] / cell)) for r in homes.where(F.col("dim").isin(list(centres))).groupBy("dim", "home").count().collect()}  # at most CENTRES rows a length
    others = homes.where(~F.col("dim").isin(list(centres))).groupBy("dim").count().where(F.col("count") > cell).limit(SAMPLE).collect()
    blocks |= {(r["dim"], 0): math.ceil(r["count"] / cell) for r in others}
    spread = spark.sparkContext.broadcast(blocks)

    def dealt(batches):
        """Every vector to the block pairs that it takes part in, some at a time; side 0 is the first block of a pair."""
        for batch in batches:
            node, dim, home = (batch.column(k).to_numpy() for k in (0, 2, 4))
            places = list(zip(dim.tolist(), home.tolist(), strict=True))
            count = np.array([spread.value.get(at, 1) for at in places], np.int64)
            ob = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % count.astype(np.uint64)
            near = batch.column(5)
            row = np.repeat(np.arange(batch.num_rows), near.value_lengths().to_numpy())
            cell = near.flatten().to_numpy()
            n = np.array([spread.value.get((d, c), 1) for d, c in zip(dim[row].tolist(), cell.tolist(), strict=True)], np.int64)
            row, cell, ends = np.repeat(row, n), np.repeat(cell, n), np.cumsum(n)
            block = np.arange(len(row)) - np.repeat(ends - n, n)
            own = np.stack([home[row].astype(np.int64), ob[row].astype(np.int64)])
            other = np.stack([cell.astype(np.int64), block])
            side = (other[0] < own[0]) | ((other[0] == own[0]) & (other[1] < own[1]))
            first, last = np.where(side, other, own), np.where(side, own, other)
            step = max(1, DEALT_BYTES // max(1, batch.column(3).nbytes // max(1, batch.num_rows)))
            for at in range(0, len(row), step):
                here = slice(at, at + step)
                ints = [pa.array(c[here].astype(np.int32)) for c in (dim[row], *first, *last, side)]
                names = ["dim", "a", "ab", "b", "bb", "side", "node", "n", "raw"]
                held = batch.select(["node", "n", "raw"]).take(pa.array(row[here]))
                yield pa.RecordBatch.from_arrays([*ints, *held.columns], names)

    def compared(table: pa.Table) -> pa.Table:
        side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
        x = units(table.column("raw").to_pylist(), kind)
        walk = Walk(x, table.column("n").to_numpy(), threshold)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = (table.column("a")[0], table.column("ab")[0]) == (table.column("b")[0], table.column("bb")[0])
        if same:
            walk.within(build(x, left))
        elif len(left) and len(right):
            walk.across(build(x, left), build(x, right))
        label = walk.settle()
        least = node.copy()
        np.minimum.at(least, label, node)
        on = np.flatnonzero(walk.links)
        return pa.table({"node": node[on], "links": walk.links[on], "root": least[label[on]]})

    tasks = homes.mapInArrow(dealt, "dim int, a int, ab int, b int, bb int, side int, node long, n long, raw binary")
    found = staged(tasks.groupBy("dim", "a", "ab", "b", "bb").applyInArrow(compared, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = staged(
        classes.join(links, "node", "left").join(parts, "node", "left")
        .select("v", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    joined = rows.where("sound").join(named, "v").select("id", "n_links", "component")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.union(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
