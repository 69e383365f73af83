"""Best-fit packing of documents into fixed-length training sequences by a configuration program.

A configuration is a multiset of piece lengths that fits one sequence. The linear program asks for
the fewest configurations that cover the length histogram, in groups of neighbouring lengths. It is
solved by multiplicative weights: every round prices the configurations with a bounded knapsack table
over the current weights, uses a little of those that are worth nearly as much as the best, and lowers
the weights of what they cover. The fractional solution is rounded to whole sequences in true lengths
within what is left of the histogram; the rest is solved again, and the last fraction is filled best-fit.

Only the histogram (at most `capacity` lengths times `SALTS`) comes to the driver, and the driver works on
runs of equal lengths, so its time and the list of configurations that goes back don't grow with the data.
Every piece then finds its place from its rank among the pieces of its length; ranks are counted
within salted parts, so a length that a third of all pieces have is not one task's work.

Defined results: a null text counts as empty, and an empty document still has its end mark, one
token; repeated rows are packed once each; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.bpe_stream import byte_letters
from ledgerloom.llm.common import local_threads, staged, text_or_empty, vocabulary_path

CAPACITY = 4096
#: Parts in which the pieces of one length are ranked.
SALTS = 64
#: Groups of lengths in a program, rounds that cover them about once (MOST_ROUNDS times as many at most),
#: configurations used in a round, and programs for one histogram.
GROUPS, ROUNDS, MOST_ROUNDS, COLUMNS, PROGRAMS = 64, 160, 8, 8, 4
#: How fast weights fall as a group is covered; share of worth, and of room, that a configuration may lack.
RATE, SLACK = 12.0, 0.01
MEMO_ENTRIES = 300_000
END_ID = 1


# --- tokens -------------------------------------------------------------------------------------


class Words:
    """The tokens of texts under a word vocabulary, looked up word by word in a bounded memo.

    Words that the memo lacks, and texts with special marks or letters beyond the western ones, go
    to the tokenizers library.
    """

    WESTERN = 0x250

    def __init__(self, path: str):
        local_threads()
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.odd = re.compile(f"[^\\x00-{chr(self.WESTERN - 1)}]|<\\|").search
        marks = "".join(chr(c) for c in range(self.WESTERN) if unicodedata.category(chr(c))[0] == "L")
        digits = "".join(chr(c) for c in range(self.WESTERN) if unicodedata.category(chr(c))[0] == "N")
        spaces = "\t-\r \x85\xa0"
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{marks}]+|[{digits}]|[^{spaces}{marks}{digits}]+").findall
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        spelled = "".join(map(self.letters.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if len(word) <= 64:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit numbers."""
        if self.odd(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, slow = self.memo.get, self.word
        return b"".join([get(w) or slow(w) for w in self.find(unicodedata.normalize("NFC", text).lower())])


@lru_cache(maxsize=2)
def words(name: str) -> Words:
    """One for each Python worker."""
    return Words(vocabulary_path(name))


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's tokens and its end mark, cut only where longer than capacity."""

    def run(batches):
        encode = words(vocabulary).ids
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(t.as_py()) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return source.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


# --- the program --------------------------------------------------------------------------------

#: A program: groups of lengths, and for each configuration (a tuple of group numbers) how often it is used.
Program = tuple[list[list[int]], dict[tuple[int, ...], float]]


def grouped(histogram: dict[int, int], most: int = GROUPS) -> list[list[int]]:
    """Lengths in up to `most` neighbouring groups, finer where lengths are short or hold many tokens."""
    sizes = sorted(s for s, n in histogram.items() if n)
    if len(sizes) <= most:
        return [[s] for s in sizes]
    tokens = np.cumsum([s * histogram[s] for s in sizes], dtype=float)
    place = tokens / tokens[-1] + np.log(np.array(sizes) / sizes[0]) / np.log(sizes[-1] / sizes[0])
    out: dict[int, list[int]] = {}
    for s, part in zip(sizes, np.minimum(most - 1, (place / 2 * most).astype(int)).tolist(), strict=True):
        out.setdefault(part, []).append(s)
    return list(out.values())


def price(values: np.ndarray, sizes: list[int], bounds: list[int], capacity: int) -> tuple[np.ndarray, list, list]:
    """Bounded knapsack: the most value that fits each room, with the choices that lead there.

    A size that may be taken up to b times is offered in lots of 1, 2, 4, ... that make up b.
    """
    best = np.zeros(capacity + 1)
    lots, taken = [], []
    for g, (value, size, bound) in enumerate(zip(values.tolist(), sizes, bounds, strict=True)):
        k = 1
        while bound > 0:
            k = min(k, bound)
            bound -= k
            if k * size <= capacity:
                offer = best[: capacity + 1 - k * size] + k * value
                more = offer > best[k * size :]
                best[k * size :] = np.where(more, offer, best[k * size :])
                lots.append((g, k))
                taken.append(more)
            k *= 2
    return best, lots, taken


def chosen(lots: list, taken: list, sizes: list[int], room: int) -> dict[int, int]:
    """How often each size stands in the best filling of a room."""
    out: dict[int, int] = {}
    for (g, k), more in zip(reversed(lots), reversed(taken), strict=True):
        at = room - k * sizes[g]
        if at >= 0 and more[at]:
            out[g] = out.get(g, 0) + k
            room = at
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Program:
    """A fractional cover of the histogram by configurations, near the least number of them.

    A group's weight falls exponentially with the share of it that is covered. Each round prices all
    configurations at once and uses a little of those worth nearly as much as the best, the least covered
    groups first, until every group is covered. A group's length is its mean; `rounded` deals in true lengths.
    """
    groups = grouped(histogram)
    need = np.array([sum(histogram[s] for s in g) for g in groups], float)
    sizes = [math.ceil(sum(s * histogram[s] for s in g) / n) for g, n in zip(groups, need, strict=True)]
    share = np.array(sizes, float) / capacity
    least = float(need @ share)
    # no more of a group than eight times what the average sequence holds of it
    bounds = [int(min(capacity // s, n, math.ceil(8 * n / least) + 1)) for s, n in zip(sizes, need, strict=True)]
    got, out = np.zeros(len(groups)), {}
    for _ in range(MOST_ROUNDS * rounds):
        lacking = got < 0.999 * need
        if not lacking.any():
            break
        cover = got / need
        values = share * np.exp(-RATE * (cover - cover[lacking].mean())) * lacking
        best, lots, taken = price(values, sizes, bounds, capacity)
        worth = values + best[capacity - np.array(sizes)]
        firsts = np.flatnonzero(lacking & (worth >= (1 - SLACK) * best[capacity]))
        firsts = firsts[np.argsort(cover[firsts], kind="stable")[:COLUMNS]]
        for g in firsts.tolist():
            config = chosen(lots, taken, sizes, capacity - sizes[g])
            config[g] = config.get(g, 0) + 1
            x = min(least / rounds / len(firsts), *(min(max(need[h] - got[h], 0.02 * need[h]), 0.1 * need[h]) / a for h, a in config.items()))
            key = tuple(sorted((h for h, a in config.items() for _ in range(a)), reverse=True))
            out[key] = out.get(key, 0.0) + x
            for h, a in config.items():
                got[h] += a * x
    return groups, out


def rounded(program: Program, left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations in true lengths, taken out of `left`; fractions are carried on to the next one.

    All places of a configuration but the last take the length of their group that most pieces have; the
    rest of the room takes the longest lengths that fit. Whole runs are placed at once: each uses up a
    length or the configuration. What turns out much emptier than it was priced is left to the next program.
    """
    groups, uses = program
    there = np.zeros(capacity + 1, bool)
    there[[s for s, n in left.items() if n]] = True
    out, carry = [], 0.0

    def longest(room: int) -> int:
        k = int(there[room::-1].argmax()) if room > 0 else 0
        return room - k if there[room - k] else 0

    for config, x in sorted(uses.items(), reverse=True):
        carry += x
        copies = int(carry + 1e-9)
        carry -= copies
        spare = max(0, capacity - sum(groups[g][-1] for g in config))
        while copies > 0:
            room, own = capacity, Counter()
            for g in config[:-1]:
                fitting = [s for s in groups[g] if s <= room and left[s] > own[s]]
                if not fitting:
                    break
                size = max(fitting, key=lambda s: left[s] / (own[s] + 1))
                own[size] += 1
                room -= size
            else:
                while size := longest(room):
                    while size and left[size] <= own[size]:
                        size = longest(size - 1)
                    if not size:
                        break
                    own[size] += 1
                    room -= size
            if own.total() < len(config) - 1 or room > spare + SLACK * capacity:
                break
            n = min(copies, *(left[s] // c for s, c in own.items()))
            copies -= n
            out.append((tuple(sorted(own.elements(), reverse=True)), n))
            for s, c in own.items():
                left[s] -= n * c
                there[s] = left[s] > 0
    return out


def best_fit(left: dict[int, int], capacity: int, begun: list[tuple[tuple[int, ...], int]] | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, into the fullest sequences that have room; runs of one length are placed at once.

    begun: sequences that are there already.
    """
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)

    def put(config: tuple[int, ...], n: int) -> None:
        room = capacity - sum(config)
        rooms[room].append((config, n))
        some[room] = True

    for config, n in begun or []:
        put(config, n)
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        n = left[size]
        while n:
            room = int(some[size:].argmax()) + size
            old = bool(some[room])
            if old:
                config, count = rooms[room].pop()
                some[room] = bool(rooms[room])
            else:
                room, config, count = capacity, (), n
            each = min(room // size, n)
            used = min(count, n // each)
            put(config + (size,) * each, used)
            if old and count > used:
                put(config, count - used)
            n -= used * each
    return [x for room in rooms for x in room]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used; every piece of the histogram has exactly one place.

    Program after program runs on what the one before has left; the last fraction joins, by best fit, the
    sequences with room.
    """
    left = {s: n for s, n in histogram.items() if n}
    out = [((capacity,), left.pop(capacity))] if capacity in left else []
    for _ in range(PROGRAMS):
        if not left:
            break
        part = rounded(solve(left, capacity), left, capacity)
        left = {s: n for s, n in left.items() if n}
        out += part
        if sum(n * sum(c) for c, n in part) < 0.05 * sum(s * n for s, n in left.items()):
            break
    return best_fit(left, capacity, out)


def places(configs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its intervals, first sequence, pieces a sequence, first offset there."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for config, n in configs:
        at = 0
        for size in sorted(set(config), reverse=True):
            c = config.count(size)
            rows.setdefault(size, []).append((rank.get(size, 0), sequence, c, at))
            rank[size] = rank.get(size, 0) + n * c
            at += size * c
        sequence += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in rows.items()}


# --- the operator -------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, key_cols: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to capacity tokens."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64(*key_cols), F.lit(SALTS)).cast("int")
    kept = staged(pieces.withColumn("_salt", salt))
    counts = kept.groupBy(F.col(length_col).alias("l"), F.col("_salt").alias("s")).count().collect()  # at most capacity x SALTS rows
    first = np.zeros((capacity + 1, SALTS), np.int64)
    for r in counts:
        first[r["l"], r["s"]] = r["count"]
    histogram = {int(s): int(n) for s, n in enumerate(first.sum(axis=1)) if n}
    first = np.cumsum(first, axis=1) - first
    shared = spark.sparkContext.broadcast((first, places(plan(histogram, capacity))))

    def run(batches):
        starts, table = shared.value
        for pdf in batches:
            size, rank = pdf[length_col].to_numpy(), pdf["_rank"].to_numpy()
            rank = rank - 1 + starts[size, pdf["_salt"].to_numpy()]
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                begin, seq, each, at = table[int(s)]
                k = np.searchsorted(begin, rank[own], "right") - 1
                beyond = rank[own] - begin[k]
                sequence[own] = seq[k] + beyond // each[k]
                offset[own] = at[k] + beyond % each[k] * s
            yield pdf.drop(columns=["_salt", "_rank"]).assign(sequence_id=sequence, offset=offset)

    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*key_cols)).cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    pieces = cut_documents(docs, vocabulary, capacity, id_col, text_col)
    return pack(pieces, capacity, (id_col, "piece", "start", "ids_crc32"))
