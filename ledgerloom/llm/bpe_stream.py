"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

A byte-pair encoding is the only division of a byte string into tokens in which every two
neighbours are *compatible*: encoding the two together gives just these two. So the encoding of a
prefix is a chain of "last token" links, and a longer input only adds links. A token is stable as
soon as every chain that later bytes can still use runs through its end; it is emitted then, and
nothing before it is kept. The merge list alone bounds how far ahead that can lie
(`sufficient_lookahead`), so memory is constant whatever the length of a pre-token.

A text is fed in chunks. Merges never cross pre-tokens, and of the pre-tokens of a chunk only the last can still
change: the others are emitted, the rest waits for the next chunk, and a pre-token that goes on and on (a run of
letters without a space) goes through the window byte by byte and is never held. Short pre-tokens that come again
are answered from a memo of bounded size beside the stream.

Defined results: a null text counts as empty and has no tokens; repeated rows each give a row; a
null id stays null; other columns of the input are not read. The marker of the end of a text is one
token wherever it stands in a text, as in the tokenizers library.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.common import text_or_empty, vocabulary_path

#: Fixed value: the division into pre-tokens that byte-level vocabularies of this family use, with L, N
#: and S for letters, numbers and white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: First code point beyond the western letters.
WESTERN = 0x250
#: Pre-tokens of more bytes than this go through the window and are not kept in the memo.
MEMO_BYTES = 64
#: Entries of a memo; it is emptied when full.
MEMO_ENTRIES = 700_000
#: Letters that are fed at once, and letters of a pre-token that is still open from which it is not held any more.
CHUNK, LONG = 16_384, 16_384
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def code_points(kind: str, below: int) -> str:
    """The code points with a Unicode property as the inside of a character class."""
    every = "".join(map(chr, range(below)))
    spans = (m.span() for m in regex.finditer(rf"{kind}+", every))
    return "".join(f"{re.escape(every[a])}-{re.escape(every[b - 1])}" for a, b in spans)


def pre_token_finder():
    """Texts of western letters alone take the standard library's matcher, which is several times faster."""
    kinds = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
    western = re.compile(PRE_TOKEN.format(**{k: code_points(v, WESTERN) for k, v in kinds.items()})).findall
    others = re.compile(f"[^\x00-{chr(WESTERN - 1)}]").search
    general = regex.compile(PRE_TOKEN.format(**kinds)).findall
    return lambda text: (general if others(text) else western)(text)


def run_classes() -> list[regex.Pattern]:
    """Runs of white space, letters, numbers and of all else, of which pre-tokens beyond their first letter consist."""
    white, letter, number = r"\p{White_Space}", r"\p{L}", r"\p{N}"
    return [regex.compile(f"[{c}]+") for c in (white, letter, number, f"^{white}{letter}{number}")]


class MergeList:
    """Tokens, merges and compatibility of neighbours of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.specials:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank[left, right] = r
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, left, right
            self.rules.append((left, right, made))
        self.token_of = {}
        for i, raw in enumerate(self.bytes_of):
            if raw and i not in self.specials.values() and self._builds(i):
                self.token_of[raw] = i
        self.longest = max(map(len, self.token_of))
        self._known: dict[tuple[int, int], bool] = {}

    def _compatible(self, a: int, b: int, before: int = NEVER) -> bool:
        """Walk back through the merges on either side of the border; would the border have merged?

        Of equal merges the one further left goes first, hence < on the left and <= on the right.
        """
        end_a = end_b = before
        while True:
            r = self.pair_rank.get((a, b))
            if r is not None and r < end_a and (r <= end_b if end_b < before else r < end_b):
                return False
            made_a, made_b = self.rank[a], self.rank[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_b >= made_a:
                end_b, b = made_b, self.left[b]
            else:
                end_a, a = made_a, self.right[a]

    @lru_cache(maxsize=None)  # noqa: B019  as many entries as tokens
    def _builds(self, token: int) -> bool:
        """Whether the merges of its own bytes end in this token."""
        if self.rank[token] < 0:
            return len(self.bytes_of[token]) == 1
        a, b = self.left[token], self.right[token]
        return self._builds(a) and self._builds(b) and self._compatible(a, b, self.rank[token])

    def compatible(self, a: int, b: int) -> bool:
        known = self._known.get((a, b))
        if known is None:
            if len(self._known) > MEMO_ENTRIES:
                self._known.clear()
            known = self._known[a, b] = self._compatible(a, b)
        return known

    def sufficient_lookahead(self) -> int:
        """Bytes after a token that can still decide whether it stands.

        A later byte acts on a border only through a chain of merges: a rule takes the left
        neighbour's rightmost part at some moment, which another rule, of a lower rank, can
        prevent by taking its partner first, and so on. Ranks fall along a chain, so the longest
        one is found in one pass over the rules in order of rank.
        """
        ranks: list[list[int]] = [[] for _ in self.bytes_of]
        reach: list[list[int]] = [[] for _ in self.bytes_of]

        def beyond(token: int, before: int) -> int:
            most, limit = 0, before
            while token >= 0:
                k = bisect.bisect_left(ranks[token], limit)
                if k:
                    most = max(most, reach[token][k - 1])
                if self.rank[token] < 0:
                    break
                limit, token = min(limit, self.rank[token]), self.right[token]
            return most

        for r, (a, b, _) in enumerate(self.rules):
            far = len(self.bytes_of[b]) + beyond(b, r)
            ranks[a].append(r)
            reach[a].append(max(far, reach[a][-1] if reach[a] else 0))
        return self.longest + max(beyond(i, NEVER) for i in self.token_of.values())


class Encoder:
    """The transducer: text in, little-endian 32-bit token numbers out."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.memo: dict[str, bytes] = {}
        self.last: dict[bytes, int] = {}
        self.find = pre_token_finder()
        self.classes = run_classes()
        self.split = re.compile("|".join(map(re.escape, merges.specials)) or r"(?!)")
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = self.m.sufficient_lookahead()
        return self._lookahead

    def _last(self, raw: bytes) -> int:
        """The last token of the encoding of a short byte string, from the chains of its prefixes."""
        known = self.last.get(raw)
        if known is not None:
            return known
        token_of, n = self.m.token_of, len(raw)
        for start in range(n):
            token = token_of.get(raw[start:])
            if token is not None and (not start or self.m.compatible(self._last(raw[:start]), token)):
                break
        if len(self.last) > MEMO_ENTRIES:
            self.last.clear()
        self.last[raw] = token
        return token

    def _short(self, raw: bytes) -> bytes:
        ids = []
        while raw:
            token = self._last(raw)
            ids.append(token)
            raw = raw[: -len(self.m.bytes_of[token])]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that comes in pieces; what is held never exceeds the lookahead twice."""
        token_of, longest, compatible = self.m.token_of, self.m.longest, self.m.compatible
        held, last, base = bytearray(), [], 0  # last[k]: last token of the chain that ends at byte k + 1 of held
        first = -1  # the token before held
        for chunk in chunks:
            for byte in chunk:
                held.append(byte)
                n = len(held)
                for start in range(max(0, n - longest), n):
                    token = token_of.get(bytes(held[start:n]))
                    if token is None or (start and last[start - 1] < 0):
                        continue
                    before = last[start - 1] if start else first
                    if before < 0 or compatible(before, token):
                        last.append(token)
                        break
                else:
                    last.append(-1)
                if n >= 2 * self.lookahead:
                    done = self._stable(last)
                    yield from (out := self._chain(last, done))
                    if out:
                        first, base = out[-1], base + done
                        del held[:done], last[:done]
        yield from self._chain(last, len(held))

    def _stable(self, last: list[int]) -> int:
        """The largest border that every chain still in use runs through; 0 if there is none."""
        n = len(last)
        ends = {e for e in range(max(1, n - self.m.longest + 1), n + 1) if last[e - 1] >= 0}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - len(self.m.bytes_of[last[end - 1]]))
        return ends.pop()

    def _chain(self, last: list[int], end: int) -> list[int]:
        ids = []
        while end:
            ids.append(last[end - 1])
            end -= len(self.m.bytes_of[ids[-1]])
        return ids[::-1]

    def pre_token(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > MEMO_BYTES:
            return b"".join(struct.pack("<I", i) for i in self.stream(raw[k : k + 4096] for k in range(0, len(raw), 4096)))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        out = self.memo[word] = self._short(raw)
        return out

    def feed(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Token numbers of a text that comes in chunks, each block as soon as no later letter can change it.

        Of the pre-tokens of what is held only the last can still change, so the others leave. Where the last one has
        grown beyond LONG letters it is a run of one class; its bytes then go through the window as they come, and
        are not held. What is held is a chunk, LONG letters, and the window.
        """
        held, get, slow, chunks = "", self.memo.get, self.pre_token, iter(chunks)
        for chunk in filter(None, chunks):
            *done, held = self.find(held + chunk)
            if done:
                yield b"".join([get(w) or slow(w) for w in done])
            if len(held) > LONG:
                rest: list[str] = []
                for part in batched(self.stream(self._run(held, chunks, rest)), 256):
                    yield struct.pack(f"<{len(part)}I", *part)
                held = rest[0] if rest else ""
        if held:
            yield b"".join([get(w) or slow(w) for w in self.find(held)])

    def _run(self, held: str, chunks: Iterator[str], rest: list[str]) -> Iterator[bytes]:
        """Bytes of a long run as its chunks come; what follows it goes to rest.

        The last of a run of white space belongs to what follows, if anything does.
        """
        of_class = next(c for c in self.classes if c.match(held[-1]))
        back = of_class is self.classes[0]
        pending = held
        for chunk in chunks:
            n = of_class.match(chunk).end() if of_class.match(chunk) else 0
            pending += chunk[:n]
            if n < len(chunk):
                cut = len(pending) - back
                yield pending[:cut].encode("utf-8", "surrogatepass")
                rest.append(pending[cut:] + chunk[n:])
                return
            cut = len(pending) - back
            yield pending[:cut].encode("utf-8", "surrogatepass")
            pending = pending[cut:]
        yield pending.encode("utf-8", "surrogatepass")

    def encode(self, text: str) -> Iterator[bytes]:
        """Token numbers of a text in pieces."""
        at = 0
        for mark in self.split.finditer(text):
            yield from self.feed(sliced(text, at, mark.start()))
            yield struct.pack("<I", self.m.specials[mark.group()])
            at = mark.end()
        yield from self.feed(sliced(text, at, len(text)))


def sliced(text: str, begin: int, end: int, size: int = CHUNK) -> Iterator[str]:
    """A part of a text in chunks."""
    if begin == 0 and end == len(text) <= size:
        yield text
    else:
        for k in range(begin, end, size):
            yield text[k : min(end, k + size)]


class Decoder:
    """Token numbers in, text out: token bytes pass through an incremental UTF-8 state machine."""

    BLOCK = 8192

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of

    def decode(self, pieces: Iterable[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        take = self.bytes_of.__getitem__
        for piece in pieces:
            ids = np.frombuffer(piece, "<u4")
            for k in range(0, len(ids), self.BLOCK):
                yield machine.decode(b"".join(map(take, ids[k : k + self.BLOCK].tolist())))
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def coders(name: str) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker."""
    merges = MergeList(vocabulary_path(name))
    return Encoder(merges), Decoder(merges)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the tokens of every whole text as little-endian unsigned 32-bit numbers."""

    def run(batches):
        encoder = coders(vocabulary)[0]
        for batch in batches:
            out = [b"".join(encoder.encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "ids"])

    source = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return source.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every token sequence; a null sequence gives an empty text."""

    def run(batches):
        decoder = coders(vocabulary)[1]
        for batch in batches:
            out = ["".join(decoder.decode([x.as_py() or b""])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    source = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return source.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its tokens again, in one pass without keeping either.

    (id, n_tokens, ids_sha256, decoded_sha256): digests of the token numbers and of the decoded text.
    """

    def run(batches):
        encoder, decoder = coders(vocabulary)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                n, ids, text = 0, hashlib.sha256(), hashlib.sha256()

                def counted(pieces, ids=ids):
                    nonlocal n
                    for piece in pieces:
                        n += len(piece) // 4
                        ids.update(piece)
                        yield piece

                for part in decoder.decode(counted(encoder.encode(t.as_py()))):
                    text.update(part.encode("utf-8", "surrogatepass"))
                rows.append((n, ids.hexdigest(), text.hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
