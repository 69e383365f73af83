"""Exact and near duplicates, shards and vectors against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerloom.llm import cover_tree, exact_dedup, sharding, simhash
from ledgerloom.llm.common import connected_components, read_table
from ledgerloom.llm.queries import batch_of, op1_sharding, op5_cover_tree, op6_exact_dedup, op7_simhash, oracle_sql
from tests.compare import same
from tests.llm.conftest import ODD


def components(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(500, i) for i in range(501, 560)]
    want = components(600, pairs)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


@pytest.mark.parametrize("op", [op1_sharding, op5_cover_tree, op6_exact_dedup])
def test_against_sql(spark, sf_dir, op):
    same(spark, sf_dir, op, oracle_sql()[op.__name__])


# --- exact copies ---


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=3000))
def test_filter_has_no_false_negative(keys):
    keys = np.array(sorted(keys), np.uint64)
    raw = exact_dedup.build_filter(keys)
    assert exact_dedup.in_filter(raw, keys).all()
    others = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    assert exact_dedup.in_filter(raw, others).sum() <= 8


def test_exact_dedup_odd_cases(odd, empty):
    got = exact_dedup.exact_duplicates(odd, batch_of()).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    sizes = Counter((r["doc_id"], r["group_size"]) for r in got)
    assert sizes == Counter((i, len(groups[t or ""])) for i, t in ODD)
    assert {r["doc_id"]: r["keep_id"] for r in got}[1] == 2
    assert exact_dedup.exact_duplicates(empty, batch_of()).count() == 0


def test_stored_filters_serve_later_batches(spark, docs, tmp_path):
    old = exact_dedup.text_groups(docs([(i, f"text {i}") for i in range(300)]))
    stored = exact_dedup.store_filters(old, str(tmp_path / "filters"), 3)
    assert stored.count() == 8
    for batch in ([(900, "text 7"), (901, "text 7"), (902, "new")], [(950, "text 8")], []):
        new = exact_dedup.text_groups(docs(batch))
        got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.merge_batch(old, new, stored).collect()}
        assert got == {(r["keep_id"], r["group_size"]) for r in exact_dedup.merge_batch(old, new).collect()}
    assert exact_dedup.bucket_bits(0, 4_000_000) == exact_dedup.bucket_bits(4_000_000, 5) == 4


def test_exact_dedup_across_and_within_batches(docs):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100 + i, f"alone {i}") for i in range(50)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs(rows), F.col("doc_id") >= 30).collect()}
    for i in range(60):
        same_text = [k for k in range(60) if k % 7 == i % 7]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same_text), len(same_text), i == max(same_text))
    assert all(got[100 + i]["kept"] for i in range(50))


# --- near copies ---


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(rows):
    fp = [brute_fingerprint(t or "") for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2]
    root = components(len(rows), pairs)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root[k]].append(i)
    return [(i, f"{fp[k]:016x}", min((x for x in least[root[k]] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_simhash_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())) == sorted(brute_near(rows))


@pytest.mark.parametrize("bucket", [1, 3, 48])
def test_simhash_near_copies_and_full_buckets(docs, bucket):
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnopq") * rng.randrange(1, 5) for _ in range(900)]
    rows = list(ODD)
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    got = simhash.near_duplicates(docs(rows), 2, 3, bucket=bucket).select("doc_id", "fingerprint", "component_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute_near(rows), key=key)


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_pair_of_bits():
    masks = [m % 2**64 for m in simhash.covering_masks(2)]
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a) & 1 and not (m >> b) & 1 for m in masks)
    assert len(masks) == 7 and min(m.bit_count() for m in masks) >= 32


# --- vectors ---


def brute_vectors(rows, t):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for n, a in enumerate(ok):
        for b in ok[:n]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= t:
                pairs.append((a, b))
    links = Counter(k for p in pairs for k in p)
    root = components(len(rows), pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    return Counter((i, links[k], least[root[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("cell", [16, 60, 4000])
def test_vectors_odd_cases(spark, cell):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 14)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])]))
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (3, rows[3][1])]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(df, 0.95, cell=cell).collect())
    assert got == brute_vectors(rows, 0.95)
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_tree_counts_dense_balls_in_bulk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=8) + rng.normal(size=(600, 8)) * 0.01
    x = np.vstack([x, rng.normal(size=(300, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    walk = cover_tree.Walk(x, np.ones(900, np.int64), 0.95)
    walk.within(cover_tree.build(x, np.arange(900)))
    assert (walk.links == (x @ x.T >= 0.95).sum(axis=1) - 1).all()


def test_vectors_go_to_few_blocks_however_many_they_are(spark, monkeypatch):
    """Vectors in random directions are sent to every cell: the number of cells may not grow with them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 16))
    x[600:700] = x[:100] + rng.normal(size=(100, 16)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    asked, net = [], cover_tree.greedy_net
    monkeypatch.setattr(cover_tree, "greedy_net", lambda v, most: asked.append(most) or net(v, most))
    monkeypatch.setattr(cover_tree, "DEALT_BYTES", 2000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(df, 0.95, cell=16).collect())
    assert got == brute_vectors(rows, 0.95) and asked and max(asked) <= cover_tree.BLOCKS + 1


def test_leaves_decide_in_double_precision():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, 2000, 2):  # pairs around the threshold, closer to it than single precision can tell
        side = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        t = 0.95 + rng.normal() * 1e-9
        x[k + 1] = t * x[k] + np.sqrt(1 - t * t) * side / np.linalg.norm(side)
    walk = cover_tree.Walk(x, np.ones(2000, np.int64), 0.95)
    walk.within(cover_tree.build(x, np.arange(2000)))
    want = ((x @ x.T >= 0.95).sum(axis=1) - 1).astype(int)
    assert (walk.links == want).all() and 600 < want.sum() < 1400


# --- shards ---


def test_shards_fit_and_hold_every_row(docs):
    rows = [(i % 50, "x" * (i % 90)) for i in range(800)] + [(7, "y" * 40)] * 300 + [(9, "z" * 5000)] + list(ODD)
    got = sharding.assign_shards(docs(rows), 2000).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    held, counted = Counter(), Counter()
    for r in got:
        held[r["shard_id"]] += r["n_bytes"]
        counted[r["shard_id"]] += 1
    assert all(held[r["shard_id"]] == r["shard_bytes"] and counted[r["shard_id"]] == r["shard_rows"] for r in got)
    assert all(b <= 2000 or counted[s] == 1 for s, b in held.items())
    names = sorted(s for s in held if "/" not in s)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))


def test_shards_of_nothing(empty):
    assert sharding.assign_shards(empty, 100).count() == 0


def test_write_shards(spark, docs, tmp_path):
    table = docs([(i, "t" * 30) for i in range(100)])
    sharding.write_shards(table, sharding.assign_shards(table, 500), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("_shard").distinct().count() > 5


def test_tree_prunes_clustered_vectors():
    """Of all pairs, few are compared where vectors lie in clusters, however many there are."""
    rng = np.random.default_rng(3)
    shares = []
    for clusters in (20, 80):
        centres = rng.normal(size=(clusters, 64))
        x = np.repeat(centres, 40, axis=0) + rng.normal(size=(clusters * 40, 64)) * 0.05
        x /= np.linalg.norm(x, axis=1)[:, None]
        walk = cover_tree.Walk(x, np.ones(len(x), np.int64), 0.95)
        walk.within(cover_tree.build(x, np.arange(len(x))))
        near = x @ x.T >= 0.95
        assert (walk.links == near.sum(axis=1) - 1).all()
        shares.append(walk.compared / (len(x) * (len(x) - 1) / 2))
    assert max(shares) < 0.1, shares
