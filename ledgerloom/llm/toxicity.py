"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed forms of its words, pairs, triples and pairs with one word left out;
each counts once, however often it stands there. The learner keeps per-coordinate rates and soft-
thresholds weights at zero (McMahan et al., 2013), so the model is a short list of slots and weights.
Its size is bounded by the number of slots, hence safe to broadcast.

The model is fitted on a bounded sample of labelled rows: those with the smallest hashes of their id,
`sample` at most and as many whole rows as SAMPLE_BYTES holds; a sampled row keeps all its features.
Features are made where the rows are; one task then runs the sequential learner over them. Scoring is one
pass over all rows without a shuffle.

Defined results: a null or empty text scores the intercept alone; rows with a null id or label are not
learnt from but are scored; without any labelled row every score is 0; repeated rows each give a row; of
several texts of one labelled id the one with the smallest features, byte by byte, is learnt from; of
several labels of one id the largest counts; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import staged, text_or_empty

#: Slots of the hashed feature space.
SLOT_BITS = 22
#: Most labelled rows that the model is fitted on, and most bytes of their features (4 each).
SAMPLE, SAMPLE_BYTES = 12_000, 256_000_000
#: Rates and penalties of the learner, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 1.0, 5
#: Rows of label 1 and 0 that are taken for granted, so that a few labels alone condemn nothing.
PRIOR = (1.0, 9.0)
MEMO_ENTRIES = 200_000
#: Words that are handled at once.
BLOCK = 40_000

_STRIP = ".,;:!?()[]{}\"'*%$#&"


class Hasher:
    """Slots of the features of a text."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        h = zlib.crc32(word.strip(_STRIP).encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = h
        return h

    def slots(self, text: str):
        """Arrays of slots, with repeats; the blocks overlap so that no n-gram is lost."""
        words = text.lower().split()
        get, slow = self.memo.get, self.word
        for k in range(0, max(1, len(words)), BLOCK):
            part = words[max(0, k - 2) : k + BLOCK]
            h = np.array([get(w) or slow(w) for w in part], np.uint64)
            grams = [h * np.uint64(0x9E3779B97F4A7C15)]
            for ahead, salt in (((1,), 0xC2B2AE3D27D4EB4F), ((1, 2), 0x165667B19E3779F9), ((2,), 0x27D4EB2F165667C5)):
                n = len(h) - ahead[-1]
                if n > 0:
                    g = h[:n] * np.uint64(salt)
                    for a in ahead:
                        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[a : a + n]
                    grams.append(g * np.uint64(0x94D049BB133111EB))
            yield (np.concatenate(grams) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def features(self, text: str) -> np.ndarray:
        return np.unique(np.concatenate(list(self.slots(text))))


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    return Hasher()


def held_out(id_col: Column) -> Column:
    """Rows kept for the test: crc32 of the id as text leaves 2 when divided by 4; a null id is not one."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Learner:
    """Follow the proximally regularized leader, one row after the other."""

    def __init__(self, slots: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots), np.zeros(slots)
        self.base = 0.0  # log odds before any feature

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(self.base + w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        return p


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, use: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that are not zero, slot -1 for the intercept. use: which labelled ids may be learnt from."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    if use is not None:
        known = known.where(use)
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` ids, two numbers each
    text = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    rows = text.join(F.broadcast(known), "id")

    def made(batches):
        h = hasher()
        for batch in batches:
            out = [h.features(t.as_py()).astype("<i4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "y", "f"])

    features = staged(rows.select("id", "y", "t").mapInArrow(made, "id long, y double, f binary"))

    def learn(batches):
        data, held = [], 0
        for y, f in (row for pdf in batches for row in zip(pdf["y"], pdf["f"], strict=True)):
            held += len(f)
            if held > SAMPLE_BYTES and data:
                break
            data.append((y, np.frombuffer(f, "<i4").copy()))
        if not data:
            return
        slots = 1 << SLOT_BITS
        model = Learner(slots + 1)
        toxic = sum(y for y, _ in data)
        model.base = float(np.log((toxic + PRIOR[0]) / (len(data) - toxic + PRIOR[1])))
        for epoch in range(EPOCHS):
            for k in np.random.default_rng(epoch).permutation(len(data)):
                model.learn(np.append(data[k][1], slots), data[k][0])
        at = np.union1d(np.flatnonzero(np.abs(model.z) > model.l1), [slots])
        w = model.weights(at)
        w[-1] += model.base
        yield pd.DataFrame({"slot": np.where(at == slots, -1, at), "w": w})

    # rows come from at most `sample` ids, each learnt from once
    one = Window.partitionBy("id").orderBy("f")
    bounded = features.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    model = bounded.mapInPandas(learn, "slot long, w double").toPandas()
    return model["slot"].to_numpy(np.int64), model["w"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: Column) -> Column:
    """A column of scores from 0 to 1 for a column of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        slots, weights = shared.value
        table = np.zeros(1 << SLOT_BITS, np.float32)
        table[slots[slots >= 0]] = weights[slots >= 0]
        base, fitted = float(weights[slots < 0].sum()), bool(len(slots))
        h, out = hasher(), np.zeros(len(texts))
        for k, text in enumerate(texts):
            hits = [s[table[s] != 0] for s in h.slots(text or "")]
            total = base + float(table[np.unique(np.concatenate(hits))].sum(dtype=float))
            out[k] = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if fitted else 0.0
        return pd.Series(out)

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text, learnt from the labels that are not held out."""
    model = fit(docs, labels, label_col, id_col, text_col, sample, use=~held_out(F.col("id")))
    key = docs[id_col].cast("long")
    out = docs.select(key.alias(id_col), held_out(key).alias("held_out"), score(docs, model, docs[text_col]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
