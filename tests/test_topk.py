"""Exact search against plain counting."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as V
from ledgerloom.operators import topk
from ledgerloom.plans import load
from ledgerloom.plans.registry import REGISTRY
from ledgerloom.plans.tables import relation


def plain_relevance(a, b):
    if a is None or b is None or len(a) != len(b) or not a or None in a:
        return 0
    a, b = np.array(a, float), np.array(b, float)
    norm = np.sqrt((a @ a) * (b @ b))
    return int(topk.rounded(np.array([a @ b / norm]))[0]) if norm else 0


def vectors(rng, n, clusters=6, size=8):
    centres = rng.normal(size=(clusters, size))
    out = [[float(x) for x in centres[rng.integers(clusters)] + rng.normal(size=size) * 0.05] for _ in range(n)]
    for k, odd in enumerate([[0.0] * size, [1.0, 2.0], [], [None, *[1.0] * (size - 1)]]):
        out[7 * (k + 1)] = odd
    out[40:60] = [out[39]] * 20  # ties
    return out


def plain_top(rows, queries, k):
    want = []
    for q, v, ticker in queries:
        fit = sorted((-plain_relevance(e, v), i) for i, t, e in rows if e is not None and (ticker is None or t == ticker))
        want += [(q, i, -m, n + 1) for n, (m, i) in enumerate(fit[:k])]
    return sorted(want)


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_search_equals_plain_counting(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(V, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(topk, "PAIRS", 3000)
    rng, pick = np.random.default_rng(3), random.Random(3)
    made = vectors(rng, 400)
    rows = [(i, pick.choice(["A", "B", None]), v) for i, v in enumerate(made)] + [(1000, "A", None)]
    queries = [(100 + i, v, pick.choice(["A", "B", "Z", None])) for i, v in enumerate([*made[:40], made[39], [1.0, 3.0], [0.0] * 8])]
    chunks = spark.createDataFrame(rows, "vec_id long, ticker string, embedding array<double>").withColumn("extra", F.lit("x")).repartition(5)
    asked = spark.createDataFrame([(*q, "n") for q in queries], "query_id long, qvec array<double>, q_ticker string, note string")
    got = V.search(chunks, asked, 7)
    assert set(got.columns) == {"vec_id", "ticker", "extra", "query_id", "note", "relevance", "place"}
    assert sorted((r["query_id"], r["vec_id"], round(r["relevance"] * 1000), r["place"]) for r in got.collect()) == plain_top(rows, queries, 7)
    assert V.search(chunks, asked.where("false"), 7).count() == 0 and V.search(chunks.where("false"), asked, 7).count() == 0


def test_cells_leave_pairs_out():
    rng = np.random.default_rng(5)
    made = [v for v in vectors(rng, 6000, clusters=25, size=16) if len(v) == 16 and None not in v]
    queries = made[::100]
    best = topk.TopK(queries, {}, 5)
    for at in range(0, len(made), 1000):
        part = made[at : at + 1000]
        best.add(pa.RecordBatch.from_pydict({"vec_id": pa.array(range(at, at + len(part))), "embedding": pa.array(part)}), "vec_id", "embedding")
    got = sorted((int(q), int(i)) for query, _, rows in best.results() for q, i in zip(query, rows.column("vec_id").to_pylist(), strict=True))
    want = [(q, i) for q, i, *_ in plain_top([(i, None, v) for i, v in enumerate(made)], [(k, v, None) for k, v in enumerate(queries)], 5)]
    assert got == sorted(want) and best.compared < 0.35 * best.pairs


def test_search_has_no_product_of_tables(spark, sf_dir):
    from ledgerloom.plans import load
    from ledgerloom.plans.registry import REGISTRY

    load()
    for name in ("r1_search", "r4_multi_query"):
        plan = REGISTRY.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_rows_meet_only_queries_of_their_value():
    rng = np.random.default_rng(5)
    held = vectors(rng, 400)
    rows = [(i, None if i % 31 == 0 else f"T{i % 7}", v) for i, v in enumerate(held)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["vec_id", "ticker", "embedding"])
    asked = [(k, v, f"T{k % 9}") for k, v in enumerate(held[60:150])]
    for queries in (asked, [*asked, (90, held[0], None)]):
        best = topk.TopK([v for _, v, _ in queries], {"ticker": [t for *_, t in queries]}, 4)
        for at in range(0, 400, 150):
            best.add(batch.slice(at, 150), "vec_id", "embedding")
        got = []
        for query, mark, kept in best.results():
            got += zip(query.tolist(), mark.tolist(), kept.column("vec_id").to_pylist(), strict=True)
        assert sorted(got) == sorted((q, m, i) for q, i, m, _ in plain_top(rows, queries, 4))
        if queries is asked:
            assert best.compared <= best.pairs == sum(t == u for _, t, _ in rows for *_, u in asked)


def test_topic_query_asks_every_ticker_with_every_stated_query(spark, sf_dir):
    load()
    rows = [(r["vec_id"], r["ticker"], list(r["embedding"])) for r in relation(spark, sf_dir, "vec").collect()]
    want = []
    for q, _, v in rows:
        if q % 100 == 0:
            want.append((str(q), None, 0, 1, False))
            for t in {t for _, t, _ in rows}:
                want += [(f"{q}-{t}", i, m, n, True) for _, i, m, n in plain_top(rows, [(q, v, t)], 3 if q % 400 else 5)]
    got = [(r["query_id"], r["vec_id"], round(r["relevance"] * 1000), r["place"], r["found"]) for r in REGISTRY.queries["r12_topic_search"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
