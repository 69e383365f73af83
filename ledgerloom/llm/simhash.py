"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint of its word shingles. For a radius r, each bit position is
given a nonzero vector of r + 1 bits; the table of a nonzero vector v masks the positions whose vector
has an odd product with v. Any r differing positions span too little to meet every v, so a pair within
the radius agrees on all masked bits of some table: no pair is missed (Pagh, 2016).

Documents of equal fingerprints are one class. The classes meet in the buckets of the 2^(r+1) - 1
tables. In a bucket of up to BUCKET classes each is compared with those after it. A fuller bucket is
never expanded into pairs: its classes go to cells, one for each way to clear up to half the radius of
the unmasked bits. Two classes within the radius share a cell and two of one cell are within it, so
linking each with the smallest of its cell keeps the components whole.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links as
any other; repeated rows each give a row; rows with a null id take the component of their class, and
link nothing where the class has no other; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from ledgerloom.llm.common import connected_components, staged, text_or_empty

BITS, SEED = 64, 42
#: Classes of a bucket that are compared pair by pair.
BUCKET = 48
#: Shingles hashed at once, so that a very long text needs no more memory.
BLOCK = 50_000


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits, each set where more than half the shingles' hashes have it, as a signed number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        total, ones = 1, np.unpackbits(np.array([xxh64_intdigest(joined, SEED)], "<u8").view(np.uint8), bitorder="little").astype(np.int64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts, stops = np.concatenate([[0], ends[:-width]]).tolist(), (ends[width - 1 :] - 1).tolist()
        total, ones = len(starts), np.zeros(BITS, np.int64)
        for k in range(0, total, BLOCK):
            parts = [joined[a:b] for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)]
            hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every whole text."""

    def run(batches):
        for batch in batches:
            out = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "fp"])

    source = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return source.mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask of signed 64 bits for each nonzero vector."""
    size = 1 << (radius + 1)
    out = []
    for v in range(1, size):
        mask = sum(1 << p for p in range(bits) if ((1 + p % (size - 1)) & v).bit_count() % 2)
        out.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return out


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def class_links(classes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between class nodes that leave every component of near classes connected.

    classes: (node, fp), fp distinct. Every link lies within the radius.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mask")) for k, m in enumerate(masks)])
    keyed = classes.select("node", "fp", F.inline(tables)).select("node", "fp", "k", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = staged(sizes)
    keyed = staged(keyed.join(sizes, ["k", "key"]))
    # small buckets: each class with the later ones, up to `bucket` rows on
    order = Window.partitionBy("k", "key").orderBy("fp")
    near = F.collect_list(F.struct("node", "fp")).over(order.rowsBetween(1, bucket - 1))
    pairs = keyed.where(F.col("n") <= bucket).withColumn("near", near)
    hits = F.filter("near", lambda x: _distance(x["fp"], F.col("fp")) <= radius)
    small = pairs.select(F.col("node").alias("a"), F.explode(F.transform(hits, lambda x: x["node"])).alias("b"))
    # fuller ones: cells of fingerprints with up to radius / 2 unmasked bits flipped
    flips = {}
    for k, m in enumerate(masks):
        free = [p for p in range(BITS) if not (m >> p) & 1]
        ways = [c for r in range((radius + 1) // 2 + 1) for c in combinations(free, r)]
        flips[k] = [x - (1 << BITS) if (x := sum(1 << p for p in c)) >> (BITS - 1) else x for c in ways]
    by_table = F.create_map(*[x for k, f in flips.items() for x in (F.lit(k), F.array(*map(F.lit, f)))])
    cells = keyed.where(F.col("n") > bucket).select("node", "fp", "k", F.explode(by_table[F.col("k")]).alias("flip"))
    cells = cells.select("node", "fp", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("cell"))
    least = staged(cells.groupBy("k", "cell").agg(F.min_by(F.struct("node", "fp"), "node").alias("m"), F.count("*").alias("c")).where("c > 1"))
    full = cells.join(least, ["k", "cell"]).where((F.col("node") != F.col("m.node")) & (_distance(F.col("fp"), F.col("m.fp")) <= radius))
    full = full.select(F.col("node").alias("a"), F.col("m.node").alias("b"))
    return small.union(full)


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable by links)."""
    if radius % 2:
        raise ValueError("cells of fuller buckets are exact for an even radius")
    prints = staged(fingerprints(docs, width, id_col, text_col))
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("node")))
    components = connected_components(class_links(classes.where("node is not null"), radius, bucket))
    named = classes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(staged(named), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
