"""Repeated passages across documents: a count-min prefilter, then exact grouping of what it lets through.

A window is WIDTH consecutive words of a document. A document's words are hashed once into two lanes of 64
bits; a window's two lanes are sums of its words' lanes, each times an odd factor of its place, so that
windows are made by array arithmetic; they are grouped by 96 bits of the two.

First pass: every task notes in how many of its documents each cell of a count-min sketch is met, as sorted
lists of cells in gaps of a byte, and never holds a sketch of its own. A document's id is noted too. The lists go to the slices of the sketch, where they
are added up; counts stop at two. A window's count is never under the number of documents that hold it, so
the cells that reach two, one bit each, are all that the second pass needs. The sketch has eight cells for
every window, up to MAX_CELLS: beyond that its bits stay at MAX_CELLS / 8 bytes and more windows pass by
mistake, which costs a shuffle and changes no result.

Second pass: only windows whose cells all reach two are grouped, exactly, in as many buckets of their lanes as
the input's size asks for; tasks send them in packed lists of columns. Where a task sees a window in several
documents, it decides all but the one with the smallest id itself, so a passage that a third of all documents
hold comes to its group as a few rows a task. Windows that a document with a smaller id holds are marked by their places; the words
that they cover are left out of the whole text.

Defined results: a null or empty text has no words; a text of fewer words than a window loses none; rows
with a null id lose nothing and count as no document; rows of equal id are judged each by its own text, and
take nothing from each other; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ledgerloom.llm.common import text_or_empty

WIDTH = 13
#: Rows of the sketch.
DEPTH = 2
#: Cells of a slice; a cell's place in its slice takes 16 bits.
SLICE_BITS = 16
#: Cells of the largest sketch: its bits take 64 MB.
MAX_CELLS = 1 << 29
#: Windows of the input for one bucket of the exact grouping.
BUCKET = 1 << 22
#: The sketch is broadcast in pieces of so many bytes.
PIECE = 1 << 23
#: Windows that a task of the first pass notes at once, and that one of the second sends at once.
NOTED, GROUPED = 1 << 22, 1 << 19
#: Words of the documents that a task takes at once, and that it hashes at once.
TAKEN, HASHED = 1 << 16, 1 << 16


class Hasher:
    """Lanes of windows of words. Words are hashed as they come, many documents at once; none is kept."""

    def __init__(self, width: int):
        self.width = width
        self.factors = np.frombuffer(b"".join(xxh3_128_digest(b"%d" % j, 7) for j in range(width)), np.uint64).reshape(-1, 2) | np.uint64(1)

    def windows(self, words: list[bytes]) -> np.ndarray:
        """The two lanes (rows) of every window of a document's words."""
        return self.of_documents([words])[0]

    def of_documents(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two lanes of every window, document after document; its place in its document; each document's number of windows."""
        sizes = np.array([len(words) for words in documents], np.int64)
        counts = np.maximum(sizes - self.width + 1, 0)
        if not counts.any():
            return np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), counts
        words = digests(documents)
        n = words.shape[1] - self.width + 1
        whole, part = np.zeros((2, n), np.uint64), np.empty(n, np.uint64)
        for lane in (0, 1):
            for j in range(self.width):
                whole[lane] += np.multiply(words[lane, j : j + n], self.factors[j, lane], out=part)
        del words, part
        place = np.arange(counts.sum())
        if len(documents) > 1:  # windows that go on into the next document are none
            place -= np.repeat(np.cumsum(counts) - counts, counts)
            whole = whole[:, place + np.repeat(np.cumsum(sizes) - sizes, counts)]
        return whole, place, counts


def digests(documents: list[list[bytes]]) -> np.ndarray:
    """The two lanes of every word of documents that follow each other."""
    words = documents[0] if len(documents) == 1 else list(chain.from_iterable(documents))
    out = np.empty((2, len(words)), np.uint64)
    for k in range(0, len(words), HASHED):
        out[:, k : k + HASHED] = np.frombuffer(b"".join(map(xxh3_128_digest, words[k : k + HASHED])), np.uint64).reshape(-1, 2).T
    return out


def of_ids(docs: list[int]) -> np.ndarray:
    """The lanes of ids."""
    return digests([[b"id %d" % doc for doc in docs]])


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows whose last column is a text, with its words instead, as many at once as hold TAKEN words."""
    rows, size = [], 0
    for batch in batches:
        for *own, t in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1], strict=True):
            words = words_of(t.as_py())
            rows.append((*own, words))
            size += len(words) + 1
            if size >= TAKEN:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def sketch_bits(total_bytes: int, max_cells: int = MAX_CELLS) -> int:
    """Number of bits of a cell's place in one row of the sketch: eight cells for each six bytes of text."""
    cells = min(max_cells, max(1 << 20, 8 * total_bytes // 6))
    return max(SLICE_BITS, (cells // DEPTH).bit_length() - 1)


def cells_of(windows: np.ndarray, bits: int) -> np.ndarray:
    """The cell of every window in each row of the sketch, numbered on from row to row."""
    shift, out = np.uint64(64 - bits), np.empty((DEPTH, windows.shape[1]), np.int64)
    for row in range(DEPTH):
        out[row] = ((windows[0] + np.uint64(row) * windows[1]) >> shift).astype(np.int64) + (row << bits)
    return out


def _gaps(cells: np.ndarray, new_slice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells as gaps of one byte, 255 standing for 255 without a cell, and where each cell's bytes end."""
    low = cells.astype(np.uint16)  # the place in its slice
    gap = low.copy()
    np.subtract(low[1:], low[:-1], out=gap[1:], where=~new_slice[1:])
    ends = np.cumsum(gap // 255 + 1, dtype=np.int64)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    return out, ends


def _from_gaps(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.int64)[data != 255]


def _noted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cells, each once for a document that meets it, as lists of one slice: met once, met again."""
    cells = np.concatenate(held)
    cells.sort()
    first = np.concatenate([[True], cells[1:] != cells[:-1]])
    many = np.append(~first[1:], False)[first]
    cells = cells[first]
    slices = cells >> SLICE_BITS
    new = np.concatenate([[True], slices[1:] != slices[:-1]])
    starts = np.flatnonzero(new)
    met, met_ends = _gaps(cells, new)
    again_cells = cells[many]
    again_slices = again_cells >> SLICE_BITS
    again_new = np.concatenate([[True], np.diff(again_slices) != 0])[: len(again_cells)]
    again, again_ends = _gaps(again_cells, again_new)
    # bytes before each slice, in either list
    cut = lambda ends, counts: [int(ends[k - 1]) if k else 0 for k in counts.tolist()]
    met_cut = cut(met_ends, np.append(starts, len(cells)))
    again_cut = cut(again_ends, np.append(np.searchsorted(again_slices, slices[starts]), len(again_cells)))
    for k in range(0, len(starts), 4096):
        part = range(k, min(k + 4096, len(starts)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slices[starts[k : k + 4096]].astype(np.int32)),
                pa.array([met[met_cut[i] : met_cut[i + 1]].tobytes() for i in part], pa.binary()),
                pa.array([again[again_cut[i] : again_cut[i + 1]].tobytes() for i in part], pa.binary()),
            ],
            ["slice", "met", "again"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of one partition added up; the cells that reach two, as bits."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, met, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if k not in counts:
                counts[k] = np.zeros(1 << SLICE_BITS, np.uint8)
            for noted in (met, again):
                at = _from_gaps(np.frombuffer(noted.as_buffer(), np.uint8))
                counts[k][at] = np.minimum(counts[k][at] + 1, 2)
    for k in sorted(counts):
        bits = np.packbits(counts.pop(k) > 1, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])


def repeated_cells(docs: DataFrame, bits: int, width: int = WIDTH) -> DataFrame:
    """(slice, bits) of the sketch's cells that at least two documents of (doc, t) meet, by a window or by their id."""

    def run(batches):
        hasher, held, size = Hasher(width), [], 0
        for rows in taken(batches):
            found, _, counts = hasher.of_documents([words for *_, words in rows])
            cells, of_row = cells_of(np.concatenate([found, of_ids([doc for doc, _ in rows])], axis=1), bits), np.arange(len(rows)) << 32
            cells += np.concatenate([np.repeat(of_row, counts), of_row])
            cells = cells.ravel()
            cells.sort()  # by row, then by cell: each cell once for a row
            held.append(cells[np.concatenate([[True], cells[1:] != cells[:-1]])].astype(np.uint32))
            size += found.shape[1] + len(rows)
            if size >= NOTED:
                yield from _noted(held)
                held, size = [], 0
        if held:
            yield from _noted(held)

    noted = docs.where("doc is not null").select("doc", "t").mapInArrow(run, "slice int, met binary, again binary")
    slices = DEPTH << max(0, bits - SLICE_BITS)
    return noted.repartition(max(1, min(4096, slices // 64)), "slice").mapInArrow(_merged, "slice int, bits binary")


class Sketch:
    """The cells that reach two, one bit each, as broadcast pieces."""

    def __init__(self, cells: DataFrame, bits: int):
        self.bits, step = bits, (1 << SLICE_BITS) // 8
        whole = bytearray((DEPTH << bits) // 8)
        for row in cells.toLocalIterator():  # bounded by the sketch's own size
            whole[row["slice"] * step : (row["slice"] + 1) * step] = row["bits"]
        context = cells.sparkSession.sparkContext
        self.pieces = [context.broadcast(bytes(whole[k : k + PIECE])) for k in range(0, len(whole), PIECE)]

    def reached(self, lanes: np.ndarray) -> np.ndarray:
        """Whether all cells of the given lanes reach two."""
        out = np.ones(lanes.shape[1], bool)
        for cells in cells_of(lanes, self.bits):
            place, mask = cells >> 3, (1 << (cells & 7)).astype(np.uint8)
            of_piece = place // PIECE
            for k in np.unique(of_piece):
                at = np.flatnonzero(of_piece == k)
                piece = np.frombuffer(self.pieces[k].value, np.uint8)
                out[at] &= (piece[place[at] - k * PIECE] & mask[at]) != 0
        return out


def _planes(column: np.ndarray) -> bytes:
    """A column's bytes, first bytes first: numbers in order or small ones then compress."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def _from_planes(data: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), at + n * size


#: Columns of a packed list: its documents, the marks of their texts and how many entries they have; of each entry, sorted by
#: document, the place, and of windows two lanes.
_OWN, _EACH = ("<i8", "<i8", "<u4"), ("<i4", ">u8", "<u4")


def _packed(doc: np.ndarray, mark: np.ndarray, place: np.ndarray, *lanes: np.ndarray) -> bytes:
    """Columns, sorted by doc, mark and place, as bytes."""
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
    own = (doc[starts], mark[starts], np.diff(np.append(starts, len(doc))))
    columns = [c.astype(k) for c, k in zip((*own, place, *lanes), (*_OWN, *_EACH), strict=False)]
    return np.array([len(starts), len(doc)], "<i8").tobytes() + b"".join(map(_planes, columns))


def _unpacked(data: memoryview, n_lanes: int) -> tuple[np.ndarray, ...]:
    """(id, mark, place, lanes...) of a packed list."""
    n_docs, n = np.frombuffer(data, "<i8", 2).tolist()
    at, columns = 16, []
    for count, kinds in ((n_docs, _OWN), (n, _EACH[: 1 + n_lanes])):
        for kind in kinds:
            column, at = _from_planes(data, at, count, kind)
            columns.append(column)
    doc, mark, size, *each = columns
    return np.repeat(doc, size), np.repeat(mark, size), *each


LISTS = "kind int, bucket int, data binary"
_WINDOWS, _PLACES = 0, 1


def _lists(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A packed list for each bucket of columns (doc, mark, place, lanes...)."""
    if len(bucket):
        order = np.lexsort((columns[2], columns[1], columns[0], bucket))
        bucket, columns = bucket[order], [c[order] for c in columns]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
            data = pa.array([_packed(*(c[a:b] for c in columns))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket[a]], pa.int32()), data], ["kind", "bucket", "data"])


def _doc_bucket(doc: np.ndarray, n_buckets: int) -> np.ndarray:
    mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)


def _spots(lanes: np.ndarray, doc: np.ndarray, mark: np.ndarray, place: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of one task, as lists for the buckets of their first lane.

    Of those that several of its documents hold, only the first document's go on to be compared; the places of the
    others are decided, and go as lists for the buckets of their ids.
    """
    order = np.lexsort((doc, lanes[1], lanes[0]))
    lanes, doc, mark, place = lanes[:, order], doc[order], mark[order], place[order]
    new = np.concatenate([[True], (lanes[:, 1:] != lanes[:, :-1]).any(axis=0)])
    open_ = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    yield from _lists(_PLACES, _doc_bucket(doc[~open_], n_buckets), doc[~open_], mark[~open_], place[~open_])
    h1, h2 = lanes[0, open_], lanes[1, open_] >> np.uint64(32)
    bucket = ((h1 >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
    yield from _lists(_WINDOWS, bucket, doc[open_], mark[open_], place[open_], h1, h2)


def _later(n_buckets: int):
    """Of windows whose buckets lie whole and sorted in a partition, the places that a smaller id holds too; places go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        for (kind, bucket), group in groupby(rows, key=itemgetter(0, 1)):
            if kind == _PLACES:
                for _, _, data in group:
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([data.as_py()], pa.binary())], ["kind", "bucket", "data"])
                continue
            doc, mark, place, h1, h2 = (np.concatenate(c) for c in zip(*(_unpacked(d.as_buffer(), 2) for *_, d in group), strict=True))
            order = np.lexsort((doc, h2, h1))
            h1, h2, sorted_doc = h1[order], h2[order], doc[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            at = order[sorted_doc > sorted_doc[np.flatnonzero(new)][np.cumsum(new) - 1]]
            yield from _lists(_PLACES, _doc_bucket(doc[at], n_buckets), doc[at], mark[at], place[at])

    return run


PLACES = "doc long, places array<struct<mark: bigint, places: binary>>"


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of places, whose buckets lie whole and sorted in a partition, as one row a document."""
    rows = (r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2), strict=True))
    for _, group in groupby(rows, key=itemgetter(0)):
        doc, mark, place = (np.concatenate(c) for c in zip(*(_unpacked(d.as_buffer(), 0) for _, d in group), strict=True))
        order = np.lexsort((place, mark, doc))
        doc, mark, place = doc[order], mark[order], place[order].astype("<i4")
        new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
        starts = np.flatnonzero(new_doc | np.concatenate([[True], mark[1:] != mark[:-1]]))
        offsets = np.append(starts, len(doc)) * 4
        packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(place.tobytes())]).cast(pa.binary())
        texts = pa.StructArray.from_arrays([pa.array(mark[starts]), packed], ["mark", "places"])
        firsts = np.flatnonzero(new_doc[starts])
        lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)), pa.int32()), texts)
        for k in range(0, len(firsts), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(doc[starts[firsts[k : k + 4096]]]), lists.slice(k, 4096)], ["doc", "places"])


def repeated_places(docs: DataFrame, width: int = WIDTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc, places) of (doc, mark, t): where windows start that a document with a smaller id holds.

    places: one list of packed 32-bit numbers for each mark, which tells rows of equal id apart, and is 0 where the
    sketch shows that no other row has the id.
    """
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits, n_buckets = sketch_bits(total, max_cells), 1 + total // 6 // BUCKET
    sketch = Sketch(repeated_cells(docs, bits, width), bits)

    def run(batches):
        hasher, tested, size = Hasher(width), [], 0
        spots = lambda: _spots(np.concatenate([t[0] for t in tested], axis=1), *(np.concatenate([t[k] for t in tested]) for k in (1, 2, 3)), n_buckets)
        for rows in taken(batches):
            doc, mark = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            mark[~sketch.reached(of_ids(doc.tolist()))] = 0
            lanes, place, counts = hasher.of_documents([words for *_, words in rows])
            at = np.flatnonzero(sketch.reached(lanes))
            tested.append((lanes[:, at], np.repeat(doc, counts)[at], np.repeat(mark, counts)[at], place[at].astype(np.int32)))
            size += len(at)
            if size >= GROUPED:
                yield from spots()
                tested, size = [], 0
        if size:
            yield from spots()

    windows = docs.where("doc is not null").select("doc", "mark", "t").mapInArrow(run, LISTS)
    dealt = lambda lists: lists.repartition(max(n_buckets, 8), "kind", "bucket").sortWithinPartitions("kind", "bucket")
    decided = dealt(windows).mapInArrow(_later(n_buckets), LISTS)
    return dealt(decided).mapInArrow(_by_document, PLACES)


def _kept(width: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for mark, t, places in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = words_of(t.as_py())
                out = np.zeros(len(words) + 1, np.int64)
                own = [p["places"] for p in places or () if p["mark"] in (0, mark)]
                if own:
                    at = np.unique(np.frombuffer(b"".join(own), "<i4"))
                    np.add.at(out, at, 1)
                    np.add.at(out, at + width, -1)
                stays = np.flatnonzero(np.cumsum(out[:-1]) == 0)
                n_words.append(len(words))
                n_removed.append(len(words) - len(stays))
                kept.append(b" ".join(words if len(stays) == len(words) else [words[i] for i in stays]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def drop_repeated_passages(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """(id, n_words, n_removed, kept): every whole text without the words that a repeated window covers."""
    text = text_or_empty(text_col)
    source = docs.select(docs[id_col].cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("t"))
    joined = source.join(repeated_places(source, width, max_cells), "doc", "left").select("doc", "mark", "t", "places")
    return joined.mapInArrow(_kept(width), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
