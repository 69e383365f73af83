"""Spelling variants, repeated passages and fill-in-middle examples."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import fill_middle, spelling, substrings
from ledgerloom.llm.queries import op11_spelling, op12_substrings, op13_fill_middle, oracle_sql
from tests.compare import same
from tests.llm.conftest import ODD


@pytest.mark.parametrize("query", [op11_spelling, op12_substrings, op13_fill_middle])
def test_against_sql(spark, sf_dir, query):
    same(spark, sf_dir, query, oracle_sql()[query.__name__])


# --- spelling variants ---


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, min_length, min_count, every):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{i}:{run}".encode())
            if every and i is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    out = {}
    for w, c in n.items():
        near = sorted((v for v in n if one_edit(v, w)), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= 5 * c else None
        out[w] = (form, c, len(near), n[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, f, root(w), c, k, m) for w, (f, c, k, m) in out.items()}


def variants(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("block", [512, 4])
def test_variants_equal_brute_force_in_blocks_of_any_size(docs, block):
    rng = random.Random(block)
    base = ["analysis", "resultat", "ÀÉîøÿß", "aaaaaaaa", "company", "aaaaaa"]
    rows = list(ODD)
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "a", "b", "é"]) + w[k + rng.randrange(2) :]
            words.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((100 + i, rng.choice([" ", "-", "1"]).join(words)))
    got = variants(spelling.spelling_variants(docs(rows), 6, 2, 19, block=block))
    assert got == brute_variants(rows, 6, 2, 19) and sum(r[1] is not None for r in got) > 50 and any(r[1] != r[2] and r[1] for r in got)


def test_chains_of_forms_lead_to_the_last(docs):
    words = {"abcdef": 1, "abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(words.items())]
    got = {r[0]: r[1:3] for r in variants(spelling.spelling_variants(docs(rows), 6, 1))}
    assert got["abcdef"] == ("abcdefg", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij")


def test_very_long_words_and_ties(docs):
    long = "x" * 30_000
    rows = [(1, f"{long} {long}y z{long} {long[:-2]} clash clasp class"), (2, f"{long} clash clasp class")]
    got = {r[0]: r for r in variants(spelling.spelling_variants(docs(rows), 5, 1, block=2))}
    assert got[long][4] == 2 and got[long[:-2]][4] == 0
    assert got["clasp"][4] == 2 and got["clasp"][1] is None


def test_no_words(odd, empty):
    assert spelling.spelling_variants(empty).count() == 0
    assert variants(spelling.spelling_variants(odd, 3, 1)) == brute_variants(ODD, 3, 1, None)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=0, max_size=5), min_size=2, max_size=12))
def test_blocks_find_each_pair_once(words):
    found = []
    for short in range(6):
        block = sorted(w for w in words if len(w) in (short, short + 1))
        for x, y in spelling.block_pairs(block, short, 0, 0, 99):
            found += [tuple(sorted((block[i], block[j]))) for i, j in zip(x, y, strict=True)]
    want = [(a, b) for a in words for b in words if a < b and one_edit(a, b)]
    assert sorted(found) == sorted(want)


# --- repeated passages ---


def brute_kept(rows, width):
    first = {}
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        for k in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def passages(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("width,max_cells", [(13, 1 << 30), (3, 1 << 17), (1, 1 << 30)])
def test_passages_equal_brute_force(docs, width, max_cells, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", 1000)
    rng = random.Random(width)
    vocabulary = ["a", "b", "Ünï", "日本", "d,", "e f"]
    parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(25)]
    rows = [*ODD, (2000, None), (2001, "")]
    for i in range(200):
        rows.append((rng.randrange(150), rng.choice([" ", "\n", "\t "]).join(rng.choices(parts, k=rng.randrange(6)))))
    rows += [(None, parts[0] * 3), (1999, "a b " * 3000)]
    assert passages(substrings.drop_repeated_passages(docs(rows), width, max_cells=max_cells)) == brute_kept(rows, width)


def test_a_full_sketch_loses_nothing(docs, monkeypatch):
    monkeypatch.setattr(substrings, "sketch_bits", lambda *_: substrings.SLICE_BITS)
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(9)) for _ in range(3000))) for i in range(60)]
    rows += [(100 + i, rows[i][1][500:900] + " tail") for i in range(20)]
    assert passages(substrings.drop_repeated_passages(docs(rows))) == brute_kept(rows, 13)


def test_sketch_never_counts_too_few(docs):
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(3)) for _ in range(200)) for _ in range(40)]
    source = docs(list(enumerate(texts))).selectExpr("doc_id as doc", "text as t")
    bits = 16
    cells = set()
    for row in substrings.repeated_cells(source.repartition(7), bits, 5).collect():
        cells |= {(row["slice"] << 16) + int(k) for k in np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little"))}
    hasher, holders = substrings.Hasher(5), defaultdict(set)
    for i, t in enumerate(texts):
        for cell in substrings.cells_of(hasher.windows(substrings.words_of(t)), bits).T.tolist():
            holders[tuple(cell)].add(i)
    assert all(c in cells for cell, docs_ in holders.items() if len(docs_) > 1 for c in cell)


@given(st.lists(st.lists(st.integers(0, 2**18 - 1), unique=True, max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_noted_cells_come_back(documents):
    held = [np.unique(np.array(d, np.uint32)) for d in documents]
    count = Counter(c for d in documents for c in d)
    got = {"met": set(), "again": set()}
    for batch in substrings._noted(held) if count else ():
        for row in batch.to_pylist():
            for kind in got:
                got[kind] |= {(row["slice"] << 16) + int(k) for k in substrings._from_gaps(np.frombuffer(row[kind], np.uint8))}
    assert got == {"met": set(count), "again": {c for c, n in count.items() if n > 1}}


@pytest.mark.parametrize("width", [1, 3, 13])
def test_windows_of_many_documents_at_once_are_those_of_each(width, monkeypatch):
    monkeypatch.setattr(substrings, "HASHED", 50)
    rng = random.Random(width)
    documents = [[rng.choice([b"a", b"a\0", "ü".encode(), b"w%d" % k]) for k in range(n)] for n in (0, 12, 13, 14, 1, 0, 200, 2, 13, 0)]
    lanes, place, counts = substrings.Hasher(width).of_documents(documents)
    each = [substrings.Hasher(width).windows(d) for d in documents]
    assert counts.tolist() == [max(0, len(d) - width + 1) for d in documents] == [e.shape[1] for e in each]
    assert (lanes == np.concatenate(each, axis=1)).all() and place.tolist() == [k for n in counts.tolist() for k in range(n)]
    same = defaultdict(set)
    for d, e in zip(documents, each, strict=True):
        for k, lane in enumerate(e.T.tolist()):
            same[tuple(lane)].add(tuple(d[k : k + width]))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({tuple(d[k : k + width]) for d in documents for k in range(len(d) - width + 1)})


@pytest.mark.parametrize("words", [1, 40, 1 << 16])
def test_rows_are_taken_whole_and_in_bounded_parts(words, monkeypatch):
    monkeypatch.setattr(substrings, "TAKEN", words)
    rng = random.Random(words)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(40))) for _ in range(80)]
    batches = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(texts)], ["doc", "t"])
    parts = list(substrings.taken(iter([batches.slice(0, 50), batches.slice(50)])))
    assert [r for part in parts for r in part] == [(k, [w.encode() for w in t.split()]) for k, t in enumerate(texts)]
    assert all(sum(len(w) + 1 for _, w in part[:-1]) < words for part in parts)


def test_a_hot_passage_comes_once_from_a_task():
    found = substrings.Hasher(13).windows([b"w%d" % k for k in range(20)])
    doc = np.repeat(np.arange(400), 8)
    rows = [r for b in substrings._spots(np.tile(found, 400), doc, doc * 0, np.tile(np.arange(8, dtype=np.int32), 400), 5) for r in b.to_pylist()]
    lists = [substrings._unpacked(memoryview(r["data"]), 2) for r in rows if r["kind"] == 0]
    docs_, _, places, h1, h2 = (np.concatenate(c) for c in zip(*lists, strict=True))
    assert sorted(zip(h1.tolist(), h2.tolist(), places.tolist(), strict=True)) == sorted((int(a), int(b) >> 32, k) for k, (a, b) in enumerate(found.T))
    assert docs_.tolist() == [0] * 8 and len(lists) == len({r["bucket"] for r in rows if r["kind"] == 0})
    decided = [substrings._unpacked(memoryview(r["data"]), 0) for r in rows if r["kind"] == 1]
    assert Counter(np.concatenate([d[0] for d in decided]).tolist()) == dict.fromkeys(range(1, 400), 8)


def test_rows_of_one_id_are_judged_each_by_its_own_text(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(15)) for x in "abc")
    rows = [(1, a), (2, a), (2, f"{b} {c}"), (2, f"{b} {a} {c}"), (3, c), (3, c)]
    assert passages(substrings.drop_repeated_passages(docs(rows))) == brute_kept(rows, 13)


def test_passages_of_no_rows(empty):
    assert substrings.drop_repeated_passages(empty).count() == 0


# --- fill-in-middle ---


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \t\n\x0bab日\U0001f600< "), max_size=40), st.integers(1, 9))
def test_tree_cuts_as_the_pattern_does(text, block):
    own, tree = units(text), fill_middle.Fenwick(text, block)
    assert tree.units == len(own)
    assert [tree.cut(k) for k in range(len(own) + 1)] == [len("".join(own[:k])) for k in range(len(own) + 1)]


def brute_example(i, t):
    t = t or ""
    own = units(t)
    if i is None or not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return (i, len(own), "plain", None, None, t)
    x = hashlib.sha256(f"42:{i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if h[2] % 100 >= 50:
        return (i, len(own), "plain", None, None, t)
    a, b = sorted(len("".join(own[: c % (len(own) + 1)])) for c in h[:2])
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (i, len(own), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


@pytest.mark.parametrize("block", [4096, 5])
def test_examples_equal_brute_force_and_come_back(docs, block):
    rng = random.Random(block)
    rows = list(ODD)
    for i in range(300):
        t = "".join(rng.choices(["word", " ", "\n\n", "<P", ">", "<", "<S", "M>", "日本", "\U0001f600", " ", "<M>" if i % 10 == 0 else "x"], k=rng.randrange(60)))
        rows.append((rng.randrange(-50, 10**12), t))
    got = fill_middle.restore(fill_middle.fill_in_middle(docs(rows), block=block)).collect()
    key = lambda r: tuple(map(str, r))
    made = sorted([tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got], key=key)
    assert made == sorted([brute_example(i, t) for i, t in rows], key=key)
    assert Counter(r["restored"] for r in got) == Counter(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_examples_of_no_rows(empty):
    assert fill_middle.restore(fill_middle.fill_in_middle(empty)).count() == 0
