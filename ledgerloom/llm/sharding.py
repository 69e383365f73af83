"""Shards by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

The bytes of all buckets of a round's depth come from one aggregation, and the sums of their ancestors
from those; a bucket's depth is the shallowest at which its ancestor fits the limit. Buckets that are
still too large at the round's end go on, alone, with the next bits. After the last bit, rows of one key
are left together: those, however many a hot key has, go on by the bits of a hash of their own row, and
what still agrees then, repeats of one row, is cut into pages by running sums within parts.

A directory entry stands for about the limit's bytes, so the directory stays in tables, is joined and
never sent to the driver.

Defined results: a null text counts as empty and a null key is a key of its own; a single row larger
than the limit has a shard to itself; an empty table has no shards; repeated rows are placed each; other
columns are kept by `assign_shards` only where asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import staged, text_or_empty

#: Bits of a key's hash, then of a row's hash.
KEY_BITS, ROW_BITS = 32, 32


def _bits(*columns: Column) -> Column:
    """32 bits as text, from the md5 of columns."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, 8), 16, 2), 32, "0")


def directory(rows: DataFrame, limit: int, first_bits: int) -> tuple[DataFrame, DataFrame]:
    """(shards by prefix, rest): rows has (path, size), path the bits as text.

    shards: (prefix, depth, n_rows, n_bytes), no one a prefix of another; rest: rows under no shard.
    """
    width = KEY_BITS + ROW_BITS
    shards, at, todo = None, 0, rows
    while at < width:
        to = min(width, first_bits if at == 0 else at + 8)
        leaves = todo.groupBy(F.substring("path", 1, to).alias("leaf")).agg(F.sum("size").alias("s"), F.count("*").alias("c"))
        leaves = staged(leaves)
        depths = F.explode(F.sequence(F.lit(at if at == 0 else at + 1), F.lit(to)))
        sums = leaves.select("leaf", "s", "c", depths.alias("depth")).groupBy("depth", F.expr("substring(leaf, 1, depth)").alias("prefix")).agg(F.sum("s").alias("n_bytes"), F.sum("c").alias("n_rows"))
        fits = sums.where((F.col("n_bytes") <= limit) | (F.col("n_rows") == 1))
        fits = staged(fits)
        parent = fits.select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("below"))
        tops = fits.join(parent, (F.col("up") == F.expr("substring(prefix, 1, depth - 1)")) & (F.col("depth") == F.col("below")), "left_anti")
        tops = tops.select("prefix", "depth", "n_rows", "n_bytes")
        shards = tops if shards is None else shards.union(tops)
        over = staged(sums.where((F.col("depth") == to) & (F.col("n_bytes") > limit) & (F.col("n_rows") > 1)).select(F.col("prefix").alias("leaf")))
        if over.isEmpty():
            return staged(shards), rows.limit(0)
        todo = staged(todo.withColumn("leaf", F.substring("path", 1, to)).join(over, "leaf", "left_semi").drop("leaf"))
        at = to
    return staged(shards), todo


def assign_shards(docs: DataFrame, limit: int, key_cols: tuple[str, ...] = ("doc_id",), size: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep columns, shard_id, depth, n_bytes, shard_rows, shard_bytes).

    shard_id is the hash prefix in bits; pages of repeats of one row have "/page" behind it. size gives
    the bytes of a row, the UTF-8 bytes of `text` where it is not given.
    """
    size = F.octet_length(text_or_empty("text")) if size is None else size
    keys = [docs[c] for c in key_cols]
    row = _bits(*[docs[c] for c in docs.columns if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int", "double", "date", "timestamp", "boolean")])
    path = F.concat(_bits(*keys), row).alias("_path")
    placed = staged(docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], path, size.cast("long").alias("_size")))
    rows = placed.select(F.col("_path").alias("path"), F.col("_size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    first_bits = max(4, min(KEY_BITS, math.ceil(math.log2(max(1, total / limit))) + 6))
    shards, rest = directory(rows, limit, first_bits)
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    depths = [r["depth"] for r in shards.select("depth").distinct().collect()]  # at most 65
    tried = placed.withColumn("_depth", F.explode(F.array(*map(F.lit, sorted(depths))))) if depths else placed.withColumn("_depth", F.lit(-1))
    hit = tried.join(shards.withColumnsRenamed({"n_rows": "shard_rows", "n_bytes": "shard_bytes", "prefix": "shard_id"}), (F.expr("substring(_path, 1, _depth)") == F.col("shard_id")) & (F.col("_depth") == F.col("depth")))
    out = hit.select(*named, "shard_id", "depth", F.col("_size").alias("n_bytes"), "shard_rows", "shard_bytes")
    if rest.isEmpty():
        return out
    # repeats of one row: equal sizes, so a page holds limit / size of them in each part
    paths = staged(rest.select(F.col("path").alias("_path")).distinct())
    parts = placed.join(paths, "_path", "left_semi").withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy("_path", "_part").orderBy(F.lit(1))
    paged = parts.withColumn("_page", F.floor((F.row_number().over(order) - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("_size"))))))
    paged = staged(paged.withColumn("shard_id", F.concat_ws("/", "_path", F.col("_part").cast("string"), F.col("_page").cast("string"))))
    sizes = paged.groupBy("shard_id").agg(F.count("*").alias("shard_rows"), F.sum("_size").alias("shard_bytes"))
    more = paged.join(sizes, "shard_id").select(*named, "shard_id", F.lit(KEY_BITS + ROW_BITS).alias("depth"), F.col("_size").alias("n_bytes"), "shard_rows", "shard_bytes")
    return out.union(more)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One folder a shard below path, holding every column of docs; ids must be unique there."""
    place = assigned.select(F.col(id_col).alias("_id"), F.col("shard_id").alias("_shard"))
    rows = docs.join(place, docs[id_col] == F.col("_id")).drop("_id")
    rows.repartition("_shard").write.mode("overwrite").partitionBy("_shard").parquet(path)
