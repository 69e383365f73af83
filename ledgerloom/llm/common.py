"""Helpers that several operators share: reading, staging in the shared folder, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import new_folder, shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    """The named text column; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; Spark's cleaner may delete it once unreachable."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df as a compressed table in the shared folder, for as long as the block lasts.

    Nothing that is still to run may read it afterwards: stage what goes on.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(spark, path)


class Groups:
    """Groups of the numbers 0 to n - 1 that links join; each is named by its smallest number."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link for every number that is not the first of its group."""
        other = np.flatnonzero(self.root != np.arange(len(self.root)))
        return other, self.root[other]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around the smallest node of each part that they join."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if held:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        at = at.reshape(2, -1)
        groups = Groups(len(nodes))
        groups.join(at[0], at[1])
        hi, lo = groups.links()
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hi]), pa.array(nodes[lo])], ["hi", "lo"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component), both long.

    edges has long columns a and b, in any order, with repeats allowed; self edges and nulls are
    left out. Large-star and small-star rounds (Kiveris et al., 2014) run until nothing changes; between
    them each partition of edges is contracted by itself, which saves rounds. Minima are aggregated before
    the shuffle, and each join meets two plain exchanges, so that adaptive execution can split a node of
    very high degree.
    """
    contracted = lambda df: staged(df.where("hi <> lo").distinct().mapInArrow(_contracted, "hi long, lo long"))
    now = contracted(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if not state["n"] or (state["n"], state["x"]) == seen:
            break
        seen = (state["n"], state["x"])
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = staged(large.where("hi <> lo").distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = contracted(small.union(low.select("hi", F.col("m").alias("lo"))))
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    nodes = now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    roots = now.select(F.col("lo").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.union(roots.select("node", F.col("node").alias("component")))


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks; executors call it too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_threads() -> None:
    """One task, one core: keep native libraries from starting threads of their own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
