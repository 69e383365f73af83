"""Near copies by word shingles: SimHash and covering tables find candidates, whole texts decide.

Two texts are linked where the Jaccard similarity of their five-word shingles reaches the threshold.

A text's SimHash, of its distinct words, has PIECES x 64 bits. Every piece has the covering tables of
`simhash.covering_masks`, so two texts that differ in at most `radius` bits of some piece meet in a bucket.
By the pigeonhole principle that holds for every pair within PIECES x (radius + 1) - 1 bits of the whole
fingerprint. Buckets emit no pairs: those of up to BUCKET texts give a spanning forest of their pairs
within the radius, fuller ones are strung together. The connected parts are clusters.

Clusters are compared on whole texts, so a cluster that is too wide costs time and links nothing wrong.
Small clusters share tasks. A large one is cut into blocks; each is compared within itself and with the
cluster's first text. What is not linked to the cluster's main part after that, and only that, is compared
with all blocks. So every pair of a cluster is linked, or already connected, or compared; a task holds at
most two blocks, and gives a row a text, never its pairs.

Defined results: a null text counts as empty; texts without words are near copies of each other; texts of
fewer words than a shingle are one shingle; rows of equal text are one node, whatever their ids; of each
group the text of the smallest id stays (of null ids alone, or of repeats of one id, the text of the
smallest digest); other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerloom.llm.common import Groups, connected_components, staged, text_or_empty
from ledgerloom.llm.simhash import SEED, covering_masks

#: Pieces of the fingerprint, and bits that may differ in one of them.
PIECES, RADIUS = 4, 5
#: Texts of a bucket whose pairs are looked at there; texts of one table in a slot and tables of a slot;
#: texts dealt by one task, about.
BUCKET, SLOT, TOGETHER, DEALT = 1024, 200_000, 8, 8_000
#: Texts and bytes of a block.
BLOCK, BLOCK_BYTES = 512, 8_000_000


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() or [b""]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pieces_of(text: str, pieces: int = PIECES) -> bytes:
    """The SimHash of the distinct words, 64 bits a piece."""
    words = set(_words(text))
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for salt in range(1, pieces + 1):
        ones = np.unpackbits(_mixed(hashes, salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(words), bitorder="little").tobytes())
    return b"".join(out)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of word shingles; the whole sequence where it is shorter."""
    words = _words(text)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate([[0], ends[:-width]]).tolist(), (ends[width - 1 :] - 1).tolist()
    hashes = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def met(node: np.ndarray, piece: np.ndarray, mask: int, radius: int, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of one table that join those of a bucket within the radius, and all of a fuller bucket."""
    key = piece & np.int64(mask)
    order = np.lexsort((piece, key))
    node, piece, key = node[order], piece[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))
    groups = Groups(len(key))
    left, ahead = np.flatnonzero(size > 1), 1
    while len(left):
        left = left[left + ahead < len(key)]
        left = left[key[left + ahead] == key[left]]
        full = size[left] > bucket
        near = np.bitwise_count((piece[left] ^ piece[left + ahead]).view(np.uint64)) <= radius
        hit = left[near | full]
        groups.join(hit, hit + ahead)
        left, ahead = left[~full], ahead + 1
    a, b = groups.links()
    return node[a], node[b]


def clusters(classes: DataFrame, count: int, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(node, component) of all nodes that share a cluster with another. classes: (node, fp), fp PIECES x 8 bytes."""
    masks = covering_masks(radius)
    parts = max(1, math.ceil(count / SLOT))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes and pieces that fall in each part of each table; TOGETHER tables share a slot for each part."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            pieces = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(len(node), -1)
            for p in range(pieces.shape[1]):
                own = np.ascontiguousarray(pieces[:, p])
                for k, mask in enumerate(masks):
                    part = (_mixed((own & np.int64(mask)).view(np.uint64), k) % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1))
                    nodes, values, table = node[order], own[order], p * len(masks) + k
                    used = [s for s in range(parts) if cut[s] < cut[s + 1]]
                    slot = [table // TOGETHER * parts + s for s in used]
                    blobs = [[x[cut[s] : cut[s + 1]].tobytes() for s in used] for x in (nodes, values)]
                    columns = [pa.array(slot, pa.int64()), pa.array([table] * len(used), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "number", "nodes", "pieces"])

    def linked(rows: pa.Table) -> pa.Table:
        """A link for every node that the slot's tables join to a smaller one."""
        number = rows.column("number").to_numpy()
        nodes, pieces = (rows.column(c).to_pylist() for c in ("nodes", "pieces"))
        left, right = [], []
        for n in np.unique(number).tolist():
            own = np.flatnonzero(number == n).tolist()
            node, piece = (np.frombuffer(b"".join([x[k] for k in own]), "<i8") for x in (nodes, pieces))
            a, b = met(node, piece, masks[n % len(masks)], radius, bucket)
            left.append(a)
            right.append(b)
        joined, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        groups = Groups(len(joined))
        groups.join(*at.reshape(2, -1))
        a, b = groups.links()
        return pa.table({"a": joined[a], "b": joined[b]})

    even = classes.repartition(max(1, math.ceil(count / DEALT)), "node")
    links = even.mapInArrow(dealt, "slot long, number int, nodes binary, pieces binary").groupBy("slot").applyInArrow(linked, "a long, b long")
    return connected_components(links)


def similar(sets: list[np.ndarray], similarity: float, first: int = 0) -> Groups:
    """Groups of sets linked by pairs at or above the similarity; pairs of two sets below `first` are not tried.

    Sets are compared through an index from hashes to the sets that hold them, so what shares nothing costs nothing.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, at = owner[order], np.searchsorted(token[order], np.arange(len(every) + 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    groups = Groups(len(sets))
    for i in range(first, len(sets)):
        own = token[begins[i] : begins[i + 1]]
        own = own[at[own + 1] - at[own] > 1]
        if not len(own):
            continue
        start, n = at[own], at[own + 1] - at[own]
        flat = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(holders[flat], minlength=len(sets))[: i]
        j = np.flatnonzero(shared >= similarity * (sizes[i] + sizes[:i] - shared))
        j = j[shared[j] > 0]
        groups.join(np.full(len(j), i), j)
    return groups


def _compared(similarity: float):
    """A group function: every cluster in a task, those of side 0 with all, or all with all where no side is given."""

    def run(table: pa.Table) -> pa.Table:
        cluster, side, node = (table.column(c).to_numpy() for c in ("cluster", "side", "node"))
        raw = table.column("s")
        order = np.lexsort((node, side, cluster))
        cuts = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]]))
        left, right = [], []
        for k, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[k:end]
            # the first text of a cluster, or one of the rest, may have come twice
            own = own[np.sort(np.unique(node[own], return_index=True)[1])]
            own = own[np.argsort(-side[own], kind="stable")]
            groups = similar([np.frombuffer(raw[int(x)].as_py(), np.uint64) for x in own], similarity, int((side[own] == 1).sum()))
            a, b = groups.links()
            left.append(node[own[a]])
            right.append(node[own[b]])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def _part(name: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(7)), n)


def links_in_clusters(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that leave the similar texts of every cluster connected. members: (node, cluster, s), s a shingle set."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.octet_length("s")).cast("long").alias("bytes"), F.min("node").alias("first"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
    sizes = staged(sizes.where("m > 1").withColumn("blocks", blocks))
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("bytes"))), F.lit(0)).alias("b")).first()["b"]
    compare = _compared(similarity)
    small = members.join(sizes.where("blocks = 1").select("cluster"), "cluster")
    tasks = F.pmod(F.xxhash64("cluster"), F.lit(max(1, math.ceil(total / BLOCK_BYTES)) * 4))
    one = small.select(tasks.alias("task"), "cluster", F.lit(0).alias("side"), "node", "s")
    large = staged(members.join(sizes.where("blocks > 1").select("cluster", "blocks", "first"), "cluster"))
    if large.isEmpty():
        return one.groupBy("task").applyInArrow(compare, "a long, b long")
    key = lambda *c: F.xxhash64(*c).alias("task")  # noqa: E731  texts of different clusters may share a task
    own = large.withColumn("block", _part("node", F.col("blocks")))
    firsts = large.where("node = first").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = own.unionByName(firsts).select(key("cluster", "block"), "cluster", F.lit(0).alias("side"), "node", "s")
    links = staged(one.unionByName(dealt).groupBy("task").applyInArrow(compare, "a long, b long"))
    # what is not in the main part of its cluster is compared with everything there
    parts = connected_components(links)
    named = large.select("node", "cluster").join(parts, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("c"))
    main = named.groupBy("cluster", "c").count().groupBy("cluster").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    rest = staged(named.join(main, "cluster").where("c <> main").select("node", "cluster"))
    if rest.isEmpty():
        return links
    few = staged(rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("rows")).select("cluster", "rows"))
    open_ = own.join(few, "cluster")
    whole = open_.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).select(key("cluster", "row", "block"), "cluster", F.lit(1).alias("side"), "node", "s")
    sought = open_.join(rest.select("node"), "node").withColumn("row", _part("node", F.col("rows"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sought = sought.select(key("cluster", "row", "block"), "cluster", F.lit(0).alias("side"), "node", "s")
    return links.unionByName(staged(sought.unionByName(whole).groupBy("task").applyInArrow(compare, "a long, b long")))


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = RADIUS, pieces: int = PIECES, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, text_sha256, component_id, kept) of every row: the smallest id of its group, and whether its text stays."""
    source = docs.select(docs[id_col].cast("long").alias("id"), F.sha2(text_or_empty(text_col), 256).alias("digest"), text_or_empty(text_col).alias("t"))

    def printed(batches):
        for batch in batches:
            out = [pieces_of(t.as_py(), pieces) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "digest", "fp"])

    def hashed(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [shingle_set(t.as_py(), words).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["node", "cluster", "s"])

    texts = staged(source.mapInArrow(printed, "id long, digest string, fp binary").groupBy("digest", "fp").agg(F.min("id").alias("id")))
    texts = texts.withColumn("node", F.monotonically_increasing_id())  # the same each time: it numbers what is staged
    found = clusters(texts.select("node", "fp"), texts.count(), radius, bucket)
    named = staged(found.join(texts.select("node", "digest"), "node").select("digest", "node", F.col("component").alias("cluster")))
    members = source.join(named, "digest").select("node", "cluster", "t").distinct()
    links = links_in_clusters(staged(members.mapInArrow(hashed, "node long, cluster long, s binary")), similarity)
    groups = texts.join(connected_components(links), "node", "left").select("digest", "id", F.coalesce("component", "node").alias("c"))
    order = F.struct(F.col("id").isNull(), "id", "digest")
    best = groups.groupBy("c").agg(F.min("id").alias("component_id"), F.min_by("digest", order).alias("stays"))
    final = groups.join(best, "c").select("digest", "component_id", (F.col("digest") == F.col("stays")).alias("kept"))
    rows = source.select("id", "digest").join(staged(final), "digest")
    return rows.select(F.col("id").alias(id_col), F.col("digest").alias("text_sha256"), "component_id", "kept")
