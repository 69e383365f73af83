"""Token counts by byte-pair merging with a heap and a linked list; no token numbers are made.

The symbols of a word form a linked list, and the adjacent pairs that join to a known piece wait in
a heap ordered by rank and then by place. The lowest is popped and merged while there is one, so the
count is the number of first symbols less the merges. A letter that the vocabulary lacks stands for
its UTF-8 bytes and merges with nothing.

No piece has a space after another letter, so merges never cross the start of a run of spaces and
each word is counted by itself; counts of words that come again are kept in a memo of bounded size.
Vocabularies without that property are refused.

Defined results: a null text counts as empty and has no tokens; repeated rows each give a row; a
null id stays null; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty, vocabulary_path

#: How such vocabularies write a space.
SPACE = "▁"
MEMO_ENTRIES = 500_000
#: Words of more letters than this are not kept.
MEMO_LETTERS = 64


class Counter:
    """Counts tokens of texts under one vocabulary file of ranked pieces with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        self.letters = {p for p in self.rank if len(p) == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank) or not {"\n", "\t"}.isdisjoint("".join(self.rank)):
            raise ValueError("pieces of this vocabulary cross words")
        self.memo: dict[str, int] = {}
        self.find = re.compile(f"{SPACE}*[^{SPACE}\n\t]+|{SPACE}+|[\n\t]").findall

    def merged(self, word: str) -> int:
        """First symbols less merges."""
        rank = self.rank
        count = sum(1 if c in self.letters else len(c.encode("utf-8", "surrogatepass")) for c in word)
        part: list[str | None] = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(rank[p], k, p) for k in range(len(part) - 1) if (p := word[k : k + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, k, piece = heapq.heappop(heap)
            if part[k] is None or (j := after[k]) >= len(part) or part[k] + part[j] != piece:
                continue
            part[k], part[j] = piece, None
            count -= 1
            after[k] = j = after[j]
            if j < len(part):
                before[j] = k
                if (p := piece + part[j]) in rank:
                    heapq.heappush(heap, (rank[p], k, p))
            if (i := before[k]) >= 0 and (p := part[i] + piece) in rank:
                heapq.heappush(heap, (rank[p], i, p))
        return count

    def count_word(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        get, slow = self.memo.get, self.count_word
        return sum([get(w) or slow(w) for w in self.find(SPACE + text.replace(" ", SPACE))])


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    """One for each Python worker."""
    return Counter(vocabulary_path(name))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches):
        count = counter(vocabulary).count
        for batch in batches:
            out = [count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    source = docs.select(docs[id_col].cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    counted = source.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
