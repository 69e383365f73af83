"""Streams against their batches: any split and order of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import prices as P
from ledgerloom.streaming.swings import MOVES, SwingProcessor, _millis, current_swings, swing_stream

DAY = dt.date(2020, 1, 6)


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Listed:
    def __init__(self):
        self.v = []

    def get(self):
        return iter(self.v)

    def put(self, v):
        self.v = list(v)

    def clear(self):
        self.v = []


class Handle:
    """State and timers of one key, kept in memory."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Listed()

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def run_processor(batches, delay_days, view=True):
    """Rows that one series gives when its points come in these batches, and the points that count."""
    import pandas as pd

    handle, processor = Handle(), SwingProcessor(view=view)
    processor.init(handle)
    mark, top, out, counted = 0, 0, [], []
    for batch in [*batches, []]:
        fresh = [(d, p) for d, p in batch if _millis(d) > mark]
        counted += fresh
        if fresh:
            out += [r for pdf in processor.handleInputRows(("X",), iter([pd.DataFrame(fresh, columns=["dt", "close_px"])]), Times(mark)) for r in pdf.itertuples(index=False)]
        top = max([top, *(_millis(d) for d, _ in batch)])
        mark = max(mark, top - delay_days * 86_400_000)
        if any(t <= mark for t in handle.timers):
            handle.timers = {t for t in handle.timers if t > mark}
            out += [r for pdf in processor.handleExpiredTimer(("X",), Times(mark), None) for r in pdf.itertuples(index=False)]
    return out, counted


def walk(rng, n):
    px, out = 100.0, []
    for k in range(n):
        px = round(px * rng.choice((0.8, 0.9, 1.0, 1.1, 1.3)), 2)
        out.append((DAY + dt.timedelta(weeks=k), max(px, 1.0)))
    return out


def test_swing_state_equals_the_batch_for_any_split_and_order(spark):
    series, views, settled = {}, {}, {}
    for seed in range(60):
        rng = random.Random(seed)
        points = walk(rng, rng.choice((3, 7, 8, 30, 90)))
        delay = rng.choice((0, 60, 10_000))
        order = sorted(points, key=lambda p: p[0] + dt.timedelta(days=rng.uniform(0, max(0, delay - 8))))
        cuts = sorted(rng.sample(range(len(order) + 1), min(len(order), rng.randrange(6))))
        batches = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)]
        rows, counted = run_processor(batches, delay)
        if delay == 10_000:
            assert len(counted) == len(points)
        series[f"X{seed}"] = counted
        last = max((r.version for r in rows), default=0)
        views[f"X{seed}"] = {(r.kind, r.start, r.end, bool(r.ongoing)) for r in rows if isinstance(r.kind, str) and (r.settled or r.version == last)}
        settled[f"X{seed}"] = [(r.kind, r.start, r.end) for r in rows if r.settled]
    df = spark.createDataFrame([(k, d, p) for k, v in series.items() for d, p in v], "ticker string, dt date, close_px double")
    want = {k: set() for k in series}
    for r in P.swing_episodes(df).collect():
        want[r["ticker"]].add((r["kind"], r["start"], r["end"], r["ongoing"]))
    assert views == want and sum(map(len, want.values())) > 100 and any(r[3] for v in want.values() for r in v)
    for k, rows in settled.items():
        assert len(rows) == len(set(rows)) and {(*r, False) for r in rows} <= want[k]


def stream_files(spark, path, files, schema):
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_swing_stream_takes_points_in_any_order_and_drops_what_is_too_late(spark, tmp_path):
    schema = "ticker string, dt date, close_px double"
    rng = random.Random(5)
    rows = [(t, d, p) for t in ("A", "B") for d, p in walk(rng, 40)] + [("SHORT", DAY + dt.timedelta(weeks=k), p) for k, p in enumerate((100.0, 200.0, 50.0, 90.0))]
    rows.sort(key=lambda r: r[1] + dt.timedelta(days=rng.uniform(0, 80)))
    files = [rows[:30], rows[30:55], [*rows[55:], (None, DAY, 1.0), ("A", None, 1.0), ("A", DAY, None)], [("A", DAY, 900.0)]]
    stream = swing_stream(stream_files(spark, str(tmp_path / "in"), files, schema), delay="90 days")
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["ticker"], r["kind"], r["start"], r["end"], r["ongoing"])
    got = sorted(map(key, current_swings(spark.read.schema(MOVES).parquet(f"{tmp_path}/out")).collect()))
    want = sorted(map(key, P.swing_episodes(spark.createDataFrame(rows, schema)).collect()))
    assert got == want and any(r[4] for r in got) and {r[0] for r in got} == {"A", "B"}


def test_swings_take_the_last_of_equal_extremes(spark):
    values = [100, 130, 130, 120, 90, 90, 95, 130, 131]
    rows = [("X", DAY + dt.timedelta(weeks=k), float(v)) for k, v in enumerate(values)]
    got = P.swing_episodes(spark.createDataFrame(rows, "ticker string, dt date, close_px double")).orderBy("start").collect()
    week = lambda d: (d - DAY).days // 7
    assert [(r["kind"], week(r["start"]), week(r["end"]), r["weeks"]) for r in got] == [("rally", 0, 2, 2), ("decline", 2, 5, 3), ("rally", 5, 8, 3)]


def test_job_stream_equals_the_batch_after_each_trigger(spark, tmp_path):
    from ledgerloom.streaming.jobs import current_status, job_status, job_status_stream

    schema = "job_id string, ts timestamp, seq long, stage string, state string"
    rng = random.Random(9)
    at = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), at + dt.timedelta(minutes=rng.randrange(4)), k % 5, rng.choice(["load", "parse", "score"]), rng.choice(["active", "completed", "waiting", None])) for k in range(40)]
    files = [rows[:5], rows[5:20], [(None, at, 1, "load", "active"), ("c", None, 1, "load", "active"), ("c", at, 1, None, "active"), *rows[20:]], [("d", at, None, "load", "completed")]]
    stream = job_status_stream(stream_files(spark, str(tmp_path / "in"), files, schema))
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    for k in range(len(files)):
        given = spark.read.schema(stream.schema).parquet(*[f"{tmp_path}/out/batch={n}" for n in range(k + 1)])
        so_far = spark.createDataFrame([r for f in files[: k + 1] for r in f], schema)
        assert sorted(map(tuple, current_status(given).collect())) == sorted(map(tuple, job_status(so_far).collect()))


# --- the chunk store ---


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ticker string, digest string")


def put(store, rows, text):
    fresh = store.changed(docs_of(store.spark, rows))
    return store.upsert(fresh, fresh.select("doc_id", F.concat("digest", F.lit(text)).alias("text")))


def state(store):
    return sorted(map(tuple, store.chunks().join(store.documents(), "doc_id").select("doc_id", "ticker", "version", "text").collect()))


def files_below(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_store_reads_and_writes_only_the_buckets_of_a_batch(spark, tmp_path):
    from ledgerloom.sources.store import ChunkStore

    store = ChunkStore(spark, str(tmp_path / "store"), 8)
    assert store.generation() == 0 and store.documents().count() == 0
    rows = [(i, f"t{i % 3}", f"d{i}") for i in range(40)]
    assert put(store, rows, "") == 1
    assert state(store) == [(i, f"t{i % 3}", 1, f"d{i}") for i in range(40)]
    held = files_below(tmp_path)
    assert put(store, rows, "") == 1 and files_below(tmp_path) == held  # twice is as once
    batch = [(3, "t9", "new"), (4, "t1", "d4"), (99, "t0", "d99")]
    touched = store.buckets_of(docs_of(spark, [batch[0], batch[2]]))
    read = store.changed(docs_of(spark, batch)).inputFiles()
    asked = store.buckets_of(docs_of(spark, batch))
    assert read and {int(f.split("bucket=")[1].split("/")[0]) for f in read} == asked and len(asked) < 8
    assert put(store, batch, "!") == 2
    fresh = {f for f in files_below(tmp_path / "store" / "chunks") if f not in held} | {f for f in files_below(tmp_path / "store" / "docs") if f not in held}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in fresh} == touched
    want = [(i, f"t{i % 3}", 1, f"d{i}") for i in range(40) if i != 3] + [(3, "t9", 2, "new!"), (99, "t0", 1, "d99!")]
    assert state(store) == sorted(want)
    assert store.vacuum() > 0 and state(store) == sorted(want)
    store.clear("T9")
    store.remove(spark.createDataFrame([(12345,)], "doc_id long"))
    assert state(store) == sorted(w for w in want if w[0] != 3)
    store.resize(3)
    assert state(store) == sorted(w for w in want if w[0] != 3) and store.vacuum() > 0
    assert {r[0] for r in store.documents().select(store.bucket()).distinct().collect()} <= {0, 1, 2}
    store.remove(store.documents().select("doc_id"))
    assert state(store) == [] and put(store, rows[:2], "") > 0 and len(state(store)) == 2


def test_a_crash_before_the_heads_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    from ledgerloom.sources.store import ChunkStore

    store = ChunkStore(spark, str(tmp_path / "store"), 4)
    put(store, [(i, "t", f"d{i}") for i in range(10)], "")
    before = state(store)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            put(store, [(i, "t", "half") for i in range(5)], "")
    (tmp_path / "store" / "heads" / "7").mkdir()  # heads that were never written to their end
    again = ChunkStore(spark, str(tmp_path / "store"))
    assert again.generation() == 1 and state(again) == before
    put(again, [(0, "t", "whole")], "")  # the same generation; what the broken attempt left in that bucket goes
    assert state(again) == sorted([(0, "t", 2, "whole"), *before[1:]])


def test_swing_state_holds_many_series_a_key():
    """One call a trigger brings on all series of a bucket, as if each had a key of its own."""
    import pandas as pd

    series = {f"S{k}": walk(random.Random(k), n) for k, n in enumerate((30, 5, 60, 8))}
    handle, processor = Handle(), SwingProcessor()
    processor.init(handle)
    got = []
    for at in range(0, 60, 20):
        rows = [(name, *p) for name, points in series.items() for p in points[at : at + 20]]
        mark = _millis(DAY + dt.timedelta(weeks=max(0, at - 5)))
        got += [r for pdf in processor.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["ticker", "dt", "close_px"])]), Times(mark)) for r in pdf.itertuples(index=False)]
    assert len(handle.timers) == 1
    for name, points in series.items():
        alone, _ = run_processor([points], 10_000)
        held = [r for r in got if r.ticker == name]
        last = max(r.version for r in held)
        moves = lambda rows: {(r.kind, r.start, r.end, bool(r.ongoing)) for r in rows if isinstance(r.kind, str)}
        assert moves(r for r in held if r.settled or r.version == last) == moves(alone) and (moves(alone) or len(points) <= 8)


def test_ingest_types_documents_before_they_are_read_again(spark, tmp_path, monkeypatch):
    from ledgerloom.sources.store import ChunkStore
    from ledgerloom.streaming import pipelines as I

    untyped, prepare = [], I.prepare_chunks
    monkeypatch.setattr(I, "prepare_chunks", lambda docs: untyped.append(docs.where("doc_type is null").count()) or prepare(docs))
    docs = spark.createDataFrame([(1, "Annual report of the year."), (2, "nothing known"), (3, None)], "doc_id long, text string")
    counts = I.ingest_batch(ChunkStore(spark, str(tmp_path / "store"), 2), docs).first()
    assert untyped == [0] and (counts["n_docs"], counts["n_refused"], counts["n_chunks"]) == (3, 2, 1)
