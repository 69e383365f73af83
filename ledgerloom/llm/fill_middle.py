"""Fill-in-middle training examples: cuts found by a Fenwick tree over fixed blocks of a text.

A text is cut into blocks of BLOCK code points. For each block the units (words with the white space
before them, and white space at the end) that end in it are counted, and a Fenwick tree keeps the sums of
units and of code points. A cut "after so many units" is found by binary lifting down the tree, which gives
the block of the cut and the units and code points before it; the boundary is then sought in that block
alone. No list of units is made, and a text costs one small tree whatever the number of cuts.

Defined results: a null text counts as empty and stays plain, as does a text that holds one of the marks, and
any text of a row with a null id; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty

BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_ends(text: str, start: int, stop: int) -> np.ndarray:
    """Places after the units that end in text[start:stop]: after a word, or after white space at the end."""
    code = np.frombuffer(text[start : stop + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    if stop >= len(text):  # whatever comes last ends the last unit
        ends = np.append(~space[:-1] & space[1:], True) if len(code) else np.zeros(0, bool)
    else:
        ends = ~space[:-1] & space[1:]
    return start + 1 + np.flatnonzero(ends)


class Fenwick:
    """Sums of units and of code points over the blocks of a text."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        n = -(-len(text) // block)
        self.tree = np.zeros((n + 1, 2), np.int64)
        for k in range(1, n + 1):
            stop = min(k * block, len(text))
            self.tree[k] += (len(unit_ends(text, (k - 1) * block, stop)), stop - (k - 1) * block)
            if (up := k + (k & -k)) <= n:
                self.tree[up] += self.tree[k]
        self.units = 0
        k = n
        while k:
            self.units += int(self.tree[k, 0])
            k -= k & -k

    def cut(self, units: int) -> int:
        """Code points of the first `units` units."""
        if units <= 0:
            return 0
        k, before, place, step = 0, 0, 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if k + step < len(self.tree) and before + self.tree[k + step, 0] < units:
                k += step
                before += int(self.tree[k, 0])
                place += int(self.tree[k, 1])
            step >>= 1
        return int(unit_ends(self.text, place, min(place + self.block, len(self.text)))[units - before - 1])


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def _draws(id_col: Column, seed: int) -> Column:
    """Four numbers of 32 bits from a row's id; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)
    return F.when(id_col.isNotNull(), F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]))


def fill_in_middle(
    docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    n counts units. `percent` of the rows with a text are rearranged, `spm_percent` of these with the suffix
    first; the draws depend on seed and id alone. The lengths are in code points, null where form is plain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for draws, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = t.as_py()
                tree = Fenwick(text, block)
                plain = draws is None or not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= percent
                if plain:
                    out.append((tree.units, "plain", None, None, text))
                    continue
                a, b = (tree.cut(u) for u in sorted(h % (tree.units + 1) for h in draws[:2]))
                form = "spm" if draws[3] % 100 < spm_percent else "psm"
                out.append((tree.units, form, a, b - a, arranged(form, text[:a], text[a:b], text[b:])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc = docs[id_col].cast("long")
    source = docs.select(doc.alias("id"), _draws(doc, seed).alias("draws"), text_or_empty(text_col).alias("t"))
    made = source.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restore(examples: DataFrame) -> DataFrame:
    """The examples with a column `restored`: the text rebuilt from output and form."""
    at = lambda mark, of: F.instr(F.col(of), mark)
    body = examples.withColumn("body", F.substring("output", F.lit(4), F.length("output")))
    second = F.when(F.col("form") == "psm", at(SUFFIX, "body")).otherwise(at(PREFIX, "body"))
    third = at(MIDDLE, "body")
    first_part = F.substring("body", F.lit(1), second - 1)
    second_part = F.substring("body", second + 3, third - second - 3)
    middle = F.substring("body", third + 3, F.length("body"))
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(first_part, middle, second_part))
    return body.withColumn("restored", text.otherwise(F.concat(second_part, middle, first_part))).drop("body")
