"""Exact duplicates across an immutable snapshot and a new batch, screened by static binary-fuse filters.

Each side is grouped by its whole text first, with copies collapsed before the shuffle, so new-batch
duplicates are settled among themselves and a text that a third of all rows have is one group row.
The snapshot's digests fall into buckets by prefix; each bucket gets one binary-fuse filter of 16-bit
fingerprints, built once. Digests of the batch are screened by the filter of their bucket. Only the
positives, and the snapshot groups that the positives' own filters let through, meet in a join that
compares whole texts.

Defined results: a null text counts as empty; texts are equal when every byte is; of equal texts the
row with the largest id stays (rows with a null id only if there is no other, and then all of them
count as one group); rows that repeat an id are counted each; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, text_or_empty, written

#: Digests for one filter, about; a filter takes some 2.3 bytes for each.
BUCKET_DIGESTS = 400_000


# --- binary-fuse filter -------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Spread 64-bit keys anew for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _slots(mixed: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots in three segments that follow each other."""
    first = ((mixed >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    out = [(first + np.uint64(k)) * np.uint64(segment) + ((mixed >> np.uint64(shift)) & mask) for k, shift in enumerate((0, 18, 36))]
    return tuple(x.astype(np.int64) for x in out)


def build_filter(keys: np.ndarray) -> bytes:
    """Serialized filter of distinct 64-bit keys: seed, segment length, segments, 16-bit fingerprints.

    Keys are peeled in rounds: every slot that just one key uses takes that key out. Slots of one
    round have no key in common, so a round is filled at once, last round first.
    """
    n = len(keys)
    segment = 1 << max(2, min(17, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 10))) + 32
    segments = max(3, math.ceil(room / segment) + 2)
    for seed in range(1, 1000):
        mixed = _mix(keys, seed)
        slots = _slots(mixed, segment, segments)
        uses, held = np.zeros(segment * segments, np.int64), np.zeros(segment * segments, np.int64)
        index = np.arange(n)
        for s in slots:
            np.add.at(uses, s, 1)
            np.bitwise_xor.at(held, s, index)
        rounds, left = [], n
        single = np.flatnonzero(uses == 1)
        while len(single):
            key, pick = np.unique(held[single], return_index=True)
            rounds.append((key, single[pick]))
            left -= len(key)
            touched = np.concatenate([s[key] for s in slots])
            for s in slots:
                np.subtract.at(uses, s[key], 1)
                np.bitwise_xor.at(held, s[key], key)
            touched = np.unique(touched)
            single = touched[uses[touched] == 1]
        if not left:
            break
        if seed % 10 == 0:
            segments += max(1, segments // 8)
    else:
        raise ValueError("keys are not distinct")
    prints = (mixed ^ (mixed >> np.uint64(32))).astype(np.uint16)
    table = np.zeros(segment * segments, np.uint16)
    for key, at in reversed(rounds):
        table[at] = 0
        table[at] = prints[key] ^ table[slots[0][key]] ^ table[slots[1][key]] ^ table[slots[2][key]]
    return np.array([seed, segment, segments], "<u4").tobytes() + table.tobytes()


def in_filter(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one other in 65,536."""
    seed, segment, segments = map(int, np.frombuffer(raw, "<u4", 3))
    table = np.frombuffer(raw, np.uint16, offset=12)
    mixed = _mix(keys, seed)
    a, b, c = _slots(mixed, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == (mixed ^ (mixed >> np.uint64(32))).astype(np.uint16)


# --- the operator -------------------------------------------------------------------------------


def _bucket(digest: Column, bits: int) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").bitwiseAND((1 << bits) - 1)


def _key(digest: str) -> Column:
    """64 bits of a digest, apart from those that chose the bucket."""
    return F.xxhash64(digest)


def filters_of(digests: DataFrame, bits: int, digest: str = "digest") -> DataFrame:
    """One filter a bucket: (bucket, filter). The digests must be distinct."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "filter": [build_filter(keys)]})

    return digests.select(_bucket(F.col(digest), bits).alias("bucket"), _key(digest).alias("key")).groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screened(digests: DataFrame, filters: DataFrame, bits: int, digest: str = "digest") -> DataFrame:
    """The digests that the filter of their bucket lets through: all that are in it and very few others."""

    def screen(key, own: pa.Table, filters: pa.Table) -> pa.Table:
        out = own.select([digest])
        if not filters.num_rows or not own.num_rows:
            return out.slice(0, 0)
        keys = own.column("key").to_numpy().astype(np.int64).view(np.uint64)
        return out.filter(pa.array(in_filter(filters.column("filter")[0].as_py(), keys)))

    left = digests.select(_bucket(F.col(digest), bits).alias("bucket"), digest, _key(digest).alias("key"))
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(screen, f"{digest} string")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of equal text collapsed: (digest, t, keep_id, group_size)."""
    text = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    groups = text.groupBy("t").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select(F.sha2("t", 256).alias("digest"), "t", "keep_id", "group_size")


def bucket_bits(*counts: int) -> int:
    """Bits that choose a digest's bucket, so that neither side has more than about BUCKET_DIGESTS in one."""
    return max(0, min(16, math.ceil(math.log2(max(1, max(counts) / BUCKET_DIGESTS)))))


def store_filters(snapshot: DataFrame, path: str, bits: int) -> DataFrame:
    """Write the filters of an immutable snapshot beside it, once; later batches read them. snapshot: (digest), distinct."""
    filters_of(snapshot.select("digest"), bits).withColumn("bits", F.lit(bits)).write.mode("errorifexists").parquet(path)
    return snapshot.sparkSession.read.parquet(path)


def merge_batch(snapshot: DataFrame, batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The batch's groups that the snapshot holds too: (digest, keep_id, group_size) of both together.

    Both come from text_groups. Digests that agree while texts don't are not merged. stored: the snapshot's
    filters from `store_filters`; without them they are built here.
    """
    if stored is None:
        bits = bucket_bits(snapshot.count(), batch.count())
        filters = filters_of(snapshot.select("digest"), bits)
    else:
        bits = stored.agg(F.coalesce(F.max("bits"), F.lit(0)).alias("b")).first()["b"]
        filters = stored.select("bucket", "filter")
    positive = staged(screened(batch.select("digest"), filters, bits))
    back = screened(snapshot.select("digest"), filters_of(positive, bits), bits)
    new = batch.join(positive, "digest", "left_semi").select("digest", "t", F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    old = snapshot.join(back, "digest", "left_semi").select(F.col("digest").alias("d"), F.col("t").alias("old_t"), "keep_id", "group_size")
    same = new.join(old, (F.col("digest") == F.col("d")) & (F.col("t") == F.col("old_t")))
    return same.select("digest", F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("group_size") + F.col("new_size")).alias("group_size"))


def duplicate_groups(docs: DataFrame, in_batch: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, keep_id, group_size) of every distinct text, snapshot and batch together."""
    new = F.coalesce(in_batch, F.lit(False))
    groups = (
        text_groups(docs.where(~new), id_col, text_col).withColumn("new", F.lit(False))
        .unionByName(text_groups(docs.where(new), id_col, text_col).withColumn("new", F.lit(True)))
    )
    with written(groups) as kept:
        both = staged(merge_batch(kept.where("not new"), kept.where("new")))
        single = kept.select("digest", "keep_id", "group_size").join(both.select("digest"), "digest", "left_anti")
        return staged(single.unionByName(both))


def exact_duplicates(docs: DataFrame, in_batch: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row; in_batch tells the new rows from the snapshot."""
    final = duplicate_groups(docs, in_batch, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.sha2(text_or_empty(text_col), 256).alias("digest"))
    return rows.join(final, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"),
    )
