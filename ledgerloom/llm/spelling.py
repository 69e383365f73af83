"""Spelling variants by dense prefix-suffix tiling: words one edit apart, and the common form of each.

Words are counted first. Two words are one edit apart exactly if their common prefix and their common
suffix together reach the longer length less one. So of such a pair one of the two covers half of the
shorter word: words that agree on that half, and whose lengths differ by at most one, meet in a block. A
block of more than BLOCK words is cut again by the same rule, applied to what its words do not share yet,
down to blocks of at most BLOCK words, or of words that differ in two letters at most, whose number the
alphabet bounds. In a block the words are rows of padded matrices of code points, one set to the left and
one to the right; tiles of two sets of rows are compared at once, and no pair is made that does not hold.
A pair that meets in several blocks is given by one: the block of a common suffix leaves pairs whose common
prefix is long enough to the other.

Defined results: a null or empty text has no words; a row with a null id keeps its words as they are;
repeated rows count as often as they come; words of equal count are put in order of code points; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

#: Letters of a word: A-Z, a-z and the upper half of Latin-1.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Words of a block that are compared without cutting it again.
BLOCK = 512
#: Code points that one tile of comparisons may hold.
CELLS = 1 << 21
#: A form must be so many times as frequent.
RATIO = 5


def _altered(run: Column, doc: Column, every: int) -> Column:
    """The run less one letter where `every` divides the checksum of id and run."""
    h = F.crc32(F.concat(doc.cast("string"), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least min_length letters that come at least min_count times.

    Words are the longest runs of letters, only A-Z lower-cased. Where `every` is set, a run whose checksum
    with its document's id it divides has lost one letter.
    """
    runs = F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"([{LETTERS}]{{{min_length},}})"), 1))
    lowered = docs.select(docs[id_col].cast("long").alias("doc"), runs.alias("run"))
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    word = run if every is None else F.coalesce(_altered(run, F.col("doc"), every), run)
    counted = lowered.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _cut(words: DataFrame) -> DataFrame:
    """Each word in the blocks of its next cut: by the first and by the last half of its open part.

    words: (word, n, key, short, lo, hi, below). All words of a key agree on lo first and hi last letters;
    short is the shorter open length there, and below bounds the common prefix of the pairs wanted.
    """
    half = F.floor(F.col("short") / 2).cast("int")
    left = F.struct(
        F.concat("key", F.lit("<"), F.substring("word", F.col("lo") + 1, half)).alias("key"), (F.col("short") - half).alias("short"),
        (F.col("lo") + half).alias("lo"), F.col("hi"), F.col("below"),
    )
    right = F.struct(
        F.concat("key", F.lit(">"), F.substring("word", F.length("word") - F.col("hi") - half + 1, half)).alias("key"), (F.col("short") - half).alias("short"),
        F.col("lo"), (F.col("hi") + half).alias("hi"), F.least("below", F.col("lo") + half).alias("below"),
    )
    return words.select("word", "n", F.inline(F.array(left, right)))


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points of words, a row each, from their first letter on or, with right, from their last one back."""
    out = np.zeros((len(words), width), np.uint32)
    for row, w in zip(out, words, strict=True):
        row[: len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)[:: -1 if right else 1]
    return out


def block_pairs(words: list[str], short: int, lo: int, hi: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of one block that are one edit apart, tile by tile.

    words differ; they agree on lo first and hi last letters, and their open parts have short or short + 1.
    Pairs of two longer words belong to another block.
    """
    open_parts = [w[lo : len(w) - hi] for w in words]
    order = sorted(range(len(words)), key=lambda i: len(open_parts[i]))
    n_short = sum(len(p) == short for p in open_parts)
    left, right = (_matrix([open_parts[i] for i in order], short + 2, back) for back in (False, True))
    place, side = np.array(order), max(1, int((CELLS / (short + 2)) ** 0.5))
    for i in range(0, n_short, side):
        i_end = min(i + side, n_short)
        for j in range(i, len(words), side):
            a, b = slice(i, i_end), slice(j, j + side)
            prefix = (left[a, None] == left[None, b]).argmin(axis=2)
            suffix = (right[a, None] == right[None, b]).argmin(axis=2)
            longer = short + (np.arange(j, min(j + side, len(words))) >= n_short)
            near = (prefix + suffix >= longer - 1) & (prefix + lo < below)
            near &= np.arange(i, i_end)[:, None] < np.arange(j, min(j + side, len(words)))
            x, y = near.nonzero()
            if len(x):
                yield place[i + x], place[j + y]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the blocks of one partition, whose rows are sorted by key."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True))
    for _, block in groupby(rows, key=lambda r: r[2]):
        block = list(block)
        words, n = [r[0] for r in block], np.array([r[1] for r in block])
        for x, y in block_pairs(words, *block[0][3:]):
            first, second = pa.array([words[i] for i in x], pa.string()), pa.array([words[i] for i in y], pa.string())
            yield pa.RecordBatch.from_arrays([first, pa.array(n[x]), second, pa.array(n[y])], ["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, n_a, b, n_b): every two words of (word, n) that are one edit apart, once; words differ."""
    size = F.length("word")
    classes = F.inline(F.array(*[F.struct((size - d).cast("int").alias("short")) for d in (0, 1)]))
    start = words.select("word", "n", classes).where("short >= 0")
    start = start.select("word", "n", F.col("short").cast("string").alias("key"), "short", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(2**31 - 1).alias("below"))
    now, small = _cut(start), []
    while True:
        open_length = F.length("word") - F.col("lo") - F.col("hi")
        sizes = now.groupBy("key").agg(F.count("*").alias("size"), F.min(open_length - F.col("short")).alias("more"))
        sizes = staged(sizes.where("size > 1 and more = 0"))  # blocks of longer words alone have no pair of their own
        large = (F.col("size") > block) & (F.col("short") > 1)
        joined = now.join(sizes, "key").select("word", "n", "key", "short", "lo", "hi", "below", "size")
        small.append(joined.where(~large).drop("size"))
        if not sizes.where(F.col("size") > block).take(1):
            break
        rest = staged(joined.where(large).drop("size"))
        if not rest.take(1):
            break
        now = _cut(rest)
    out = small[0]
    for more in small[1:]:
        out = out.union(more)
    return out.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the forms that start at a word. Forms never come round again."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        jumped = now.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        jumped = staged(jumped)
        now = jumped.select("word", "root")
        if not jumped.where("moved").take(1):
            return now


def spelling_variants(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int | None = None, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every counted word.

    n_near counts the words one edit away; form is the most frequent of them, the first in order of code
    points at a tie, if at least `ratio` times as frequent as the word; root is the end of the word's forms.
    """
    words = staged(count_words(docs, min_length, min_count, every, id_col, text_col))
    ends = F.inline(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]))
    best = near_words(words, block).select(ends).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    likely = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.rank") >= ratio * F.col("n"), -F.col("best.rank")))
    likely = staged(likely.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"))
    found = roots(likely.where("form is not null"))
    return likely.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
