"""Encoding, decoding, counting and packing against the public libraries."""

import hashlib
import math
import random
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe_stream, packing, token_counts
from ledgerloom.llm.common import read_table, vocabulary_path
from ledgerloom.llm.queries import op2_packing, op3_bpe_stream, op4_token_counts
from tests.llm.conftest import ODD

LETTERS = st.lists(st.sampled_from(list("abcdefghij  \n\t'ésßñ½日本½0123.,-=▁") + ["the", "ing", "<|endoftext|>", " ", "\x85", "\x1c", "😀"]), max_size=80).map("".join)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def ids_of(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_encoder_equals_library(library, text):
    encoder, decoder = bpe_stream.coders("byte_bpe_50k.json")
    raw = b"".join(encoder.encode(text))
    want = library[0].encode(text, add_special_tokens=False).ids
    assert ids_of(raw) == want
    assert "".join(decoder.decode([raw[k : k + 4] for k in range(0, len(raw), 4)])) == library[0].decode(want, skip_special_tokens=False)


def test_window_never_holds_more_than_twice_the_lookahead(library):
    encoder, _ = bpe_stream.coders("byte_bpe_50k.json")
    seen = []
    whole = bpe_stream.Encoder._stable
    rng = random.Random(3)
    for word in ["a" * 4000, "".join(rng.choice("etaoin") for _ in range(5000)), "=-" * 3000]:

        def stable(self, last):
            done = whole(self, last)
            seen.append((len(last), len(last) - done))
            return done

        bpe_stream.Encoder._stable = stable
        try:
            assert list(encoder.stream([word.encode()])) == library[0].encode(word, add_special_tokens=False).ids
        finally:
            bpe_stream.Encoder._stable = whole
    assert seen and max(n for n, _ in seen) <= 2 * encoder.lookahead and max(rest for _, rest in seen) <= encoder.lookahead


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_counter_equals_library(library, text):
    assert token_counts.counter("piece_bpe_32k.model").count(text) == len(library[2].encode(text))


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_words_equal_library(library, text):
    assert ids_of(packing.words("word_bpe_49k.json").ids(text)) == library[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(LETTERS, st.integers(1, 9))
def test_chunks_do_not_change_the_tokens(library, text, size):
    encoder, _ = bpe_stream.coders("byte_bpe_50k.json")
    if "<|" in text:
        return
    raw = b"".join(encoder.feed(text[k : k + size] for k in range(0, len(text), size)))
    assert ids_of(raw) == library[0].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", ["some words that come again, 12345 and so on\n", "这是一个没有空格的中文句子。它一直重复下去，", "汉字没有标点", "x", "7", "-", " ", "\n", "'", "a1!"])
def test_memory_does_not_grow_with_the_text(piece, monkeypatch):
    monkeypatch.setattr(bpe_stream, "LONG", 500)
    monkeypatch.setattr(bpe_stream.sliced, "__defaults__", (500,))
    encoder, decoder = bpe_stream.coders("byte_bpe_50k.json")
    peaks = []
    for n in (2_000, 2_000, 12_000):  # the first fills the memos
        text = piece * (n // len(piece))
        tracemalloc.start()
        letters = sum(map(len, decoder.decode(encoder.encode(text))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert letters == len(text)
    assert peaks[2] < peaks[1] * 1.5 + 20_000


def test_long_runs_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "LONG", 40)
    monkeypatch.setattr(bpe_stream, "CHUNK", 16)
    monkeypatch.setattr(bpe_stream.sliced, "__defaults__", (16,))
    encoder = bpe_stream.coders("byte_bpe_50k.json")[0]
    rng = random.Random(12)
    runs = ["a", "é", "汉字", "7", "½", "'", "!", "-", " ", "\n", "\u3000", "'s", "s", " a", "\U0001f600"]
    for _ in range(400):
        text = "".join(rng.choice(runs) * rng.choice((1, 1, 2, 15, 16, 17, 90)) for _ in range(rng.randrange(1, 9)))
        got = b"".join(encoder.encode(text))
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library[0].encode(text, add_special_tokens=False).ids, text


def test_round_trip_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in op3_bpe_stream(spark, sf_dir).collect()}
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library[0].encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_encode_then_decode_odd_cases(odd, empty):
    encoded = bpe_stream.encode_documents(odd, "byte_bpe_50k.json")
    back = sorted((r["doc_id"] or 0, r["text"]) for r in bpe_stream.decode_documents(encoded, "byte_bpe_50k.json").collect())
    assert back == sorted((i or 0, t or "") for i, t in ODD)
    assert bpe_stream.round_trip(empty, "byte_bpe_50k.json").count() == 0


def test_count_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in op4_token_counts(spark, sf_dir).collect()}
    for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        g, text = got[r["doc_id"]], r["text"] or ""
        n = len(library[2].encode(text))
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_count_odd_cases(odd, empty, library):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd, "piece_bpe_32k.model").collect())
    assert got == Counter((i, len(library[2].encode(t or ""))) for i, t in ODD)
    assert token_counts.count_tokens(empty, "piece_bpe_32k.model").count() == 0


def check_packing(rows, texts, tok, capacity=4096):
    """Pieces tile their documents, sequences are gapless from 0 and within capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= capacity
    total = 0
    for i, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(math.ceil(len(ids) / capacity)))
        for p in parts:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == p["piece"] * capacity and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and len(own) == p["length"]
        assert sum(p["length"] for p in parts) == len(ids)
    return len(by_seq), math.ceil(total / capacity)


def test_packing_query(spark, sf_dir, library):
    rows = op2_packing(spark, sf_dir).collect()
    texts = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    used, least = check_packing(rows, texts, library[1])
    assert used <= least + 1


def test_packing_odd_cases(odd, empty):
    rows = packing.pack_documents(odd, "word_bpe_49k.json").collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    assert packing.pack_documents(empty, "word_bpe_49k.json").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=30))
def test_plan_places_every_piece_once(histogram):
    plan = packing.plan(dict(histogram), 64)
    placed = Counter()
    for config, n in plan:
        assert sum(config) <= 64
        for size in config:
            placed[size] += n
    assert placed == Counter(histogram)
    used, simple = sum(n for _, n in plan), sum(n for _, n in packing.best_fit(dict(histogram), 64))
    assert used <= simple * 1.02 + 1


def test_most_sequences_come_from_the_program():
    rng = random.Random(1)
    histogram = Counter(min(4095, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(60_000))
    least = math.ceil(sum(s * n for s, n in histogram.items()) / 4096)
    left = dict(histogram)
    part = packing.rounded(packing.solve(left, 4096), left, 4096)
    assert sum(n for _, n in part) > 0.5 * least
    assert sum(n for _, n in part) > 0.95 * least
    assert sum(n for _, n in packing.plan(dict(histogram))) <= least * 1.002 + 1


def test_work_on_the_driver_does_not_grow_with_the_pieces():
    rng = random.Random(2)
    histogram = Counter(min(4095, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(40_000))
    large = {s: n * 10_000 for s, n in histogram.items()}
    plan = packing.plan(large)
    assert len(plan) < 20_000 and sum(n for _, n in plan) <= math.ceil(sum(s * n for s, n in large.items()) / 4096) * 1.002
