"""Pairs in a band by block products, against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as M
from ledgerloom.operators import pairs
from ledgerloom.operators import retrieval as V

SIZE = 6


def plain_cosine(a, b):
    if len(a) != len(b) or None in a or None in b:
        return 0.0
    norm = math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    return sum(p * q for p, q in zip(a, b, strict=True)) / norm if norm else 0.0


def odd_vectors(rng, n):
    made = [[float(np.float32(x)) for x in rng.normal(size=SIZE)] for _ in range(n)]
    for k, odd in enumerate(([0.0] * SIZE, [], [None, *[1.0] * (SIZE - 1)], [1.0, 2.0], [2.0, 4.1], [math.nan] * SIZE)):
        made[5 * (k + 1)] = odd
    return made


def rounded(x):
    return x if math.isnan(x) else math.floor(abs(round(x, 9)) * 10_000 + 0.5 + 1e-9) / 10_000 * (1 if x >= 0 else -1)


@pytest.mark.parametrize(("lo", "hi"), [(0.3, 0.92), (-0.2, 0.4)])
def test_band_pairs_equal_plain_counting_with_odd_vectors(spark, monkeypatch, lo, hi):
    monkeypatch.setattr(pairs, "ROWS", 16)
    monkeypatch.setattr(pairs, "OTHERS", 24)
    rng, pick = np.random.default_rng(4), random.Random(4)
    rows = [(i if i % 41 else 7, pick.choice([1, 2, None]), v) for i, v in enumerate(odd_vectors(rng, 240))] + [(500, 1, None), (None, 1, [1.0] * SIZE)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    got = Counter((r["g"], r["a_id"], r["b_id"], round(r["similarity"], 4)) for r in V.band_pairs(df, "label", lo, hi, block=20).collect())
    want = Counter()
    known = [r for r in rows if None not in r]
    for k, (i, g, x) in enumerate(known):
        for j, h, y in known[:k]:
            if g == h and i != j and lo <= (c := rounded(plain_cosine(x, y))) <= hi:
                want[(g, min(i, j), max(i, j), round(c, 4))] += 1
    assert got == want and sum(want.values()) > 1000


def test_pairs_are_compared_by_products_of_few_blocks(spark, monkeypatch):
    rows = [(i, 1, [1.0, i / 7.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    plan = V.band_pairs(df, "label", 0.5, 0.99, block=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapGroupsInArrow" in plan
    n = df.groupBy("label").agg(pairs.block_count("embedding", 3).alias("n")).first()["n"]
    assert n == pairs.BLOCKS and df.limit(9).groupBy("label").agg(pairs.block_count("embedding", 3).alias("n")).first()["n"] == 3
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 8000)
    wide = df.select("label", F.array_repeat(F.lit(1.0), 100).alias("embedding"))
    assert wide.groupBy("label").agg(pairs.block_count("embedding", 3).alias("n")).first()["n"] == 60  # ten of these fill a block


@pytest.mark.parametrize("repeats", [False, True])
def test_contradictions_equal_plain_counting(spark, monkeypatch, repeats):
    monkeypatch.setattr(pairs, "ROWS", 16)
    rng, pick = np.random.default_rng(6), random.Random(6)
    vectors = dict(enumerate(odd_vectors(rng, 160)))
    fact = lambda i: None if i % 29 == 0 else "UNVERIFIABLE: x" if i % 13 == 0 else f"fact {i}"
    rows = [(i, pick.choice(["A", "B", None]), pick.choice(["x", "y"]), pick.choice(["Q1", "Q2", "Q3", None]), fact(i)) for i in range(170)]
    new, old = ([r for r in rows if r[0] % 2 == k] for k in (1, 0))
    if repeats:
        new, old = [*new, *rows[:60], (5, "A", "x", "Q9", "again")], [*old, *rows[30:90]]
    links = [(i, j) for i in range(0, 170, 3) for j in range(1, 170, 5)]
    ledger = lambda held: spark.createDataFrame(held, "id long, ticker string, metric_category string, fiscal_period string, verified_fact string").repartition(3)
    held = spark.createDataFrame(list(vectors.items()), "id long, embedding array<float>")
    got = M.contradiction_pairs(ledger(new), ledger(old), spark.createDataFrame(links, "a_id long, b_id long"), held, 0.1, 0.9)
    want = set()
    known = lambda side: [r for r in side if None not in r and not r[4].startswith("UNVERIFIABLE") and r[0] in vectors]
    for i, t, c, p, _ in known(new):
        for j, u, d, q, _ in known(old):
            similarity = rounded(plain_cosine(vectors[i], vectors[j]))
            a, b = (i, j) if p < q else (j, i)
            if (t, c) == (u, d) and p != q and i != j and 0.1 <= similarity <= 0.9 and not {(a, b), (b, a)} & set(links):
                want.add((t, c, a, b, round(similarity, 4)))
    assert Counter((r["ticker"], r["metric_category"], r["a_id"], r["b_id"], round(r["similarity"], 4)) for r in got.collect()) == Counter(want) and len(want) > 50
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()
