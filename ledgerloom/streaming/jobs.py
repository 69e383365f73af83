"""Progress of jobs as a stream: one row a job after every trigger that brings it news."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATUS = "job_id {}, latest_stage string, active string, completed string, version long"


def job_status(stages: DataFrame) -> DataFrame:
    """The latest stage of each job, with those active and completed. stages: (job_id, ts, seq, stage, state).

    The latest by (ts, seq) counts; at a tie the larger name. Rows without a job, a stage or a time are left out.
    """
    known = stages.where("job_id is not null and stage is not null and ts is not null")
    at = F.struct("ts", "seq")
    last = known.groupBy("job_id", "stage").agg(F.max_by("state", F.struct("ts", "seq", "state")).alias("state"), F.max(at).alias("at"))
    named = lambda s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") == s, F.col("stage")))), ",")
    latest = F.max_by("stage", F.struct("at", "stage"))
    return last.groupBy("job_id").agg(latest.alias("latest_stage"), named("active").alias("active"), named("completed").alias("completed"))


class JobProcessor(StatefulProcessor):
    """State of one job: the latest word on each of its stages. It goes when the watermark says that the job is idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "ts timestamp, seq long, state string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {k[0]: (pd.Timestamp(v[0]), v[1], v[2]) for k, v in list(self.stages.iterator())}
        for pdf in rows:
            for stage, ts, seq, state in zip(pdf["stage"], pdf["ts"], pdf["seq"], pdf["state"], strict=True):
                new = (pd.Timestamp(ts), int(seq), state)
                if stage not in held or _order(new) > _order(held[stage]):
                    held[stage] = new
                    self.stages.updateValue((stage,), (new[0].to_pydatetime(), new[1], state))
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        last = max(ts for ts, _, _ in held.values())
        self.handle.registerTimer(max(int(last.timestamp() * 1000) + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        latest = max(held, key=lambda s: (held[s][:2], s))
        named = lambda state: ",".join(sorted(s for s, v in held.items() if v[2] == state))
        yield pd.DataFrame([(key[0], latest, named("active"), named("completed"), version)], columns=["job_id", "latest_stage", "active", "completed", "version"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.stages.clear()  # the version stays, so that a job that comes back is newer than before
        yield pd.DataFrame({"job_id": [], "latest_stage": [], "active": [], "completed": [], "version": []})

    def close(self) -> None:
        pass


def _order(word: tuple) -> tuple:
    return (*word[:2], word[2] is not None, word[2] or "")


def job_status_stream(stages: DataFrame, delay: str = "1 day", idle_hours: float = 24.0) -> DataFrame:
    """The same of a stream, in update mode: a row of a job replaces those of smaller `version`.

    Words may come in any order within the watermark's delay; later ones are dropped. The stages of a job of which
    nothing is heard for idle_hours beyond that are forgotten; if it comes back it starts anew.
    """
    known = stages.where("job_id is not null and stage is not null and ts is not null")
    rows = known.select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), "stage", "state").withWatermark("ts", delay)
    schema = STATUS.format(stages.schema["job_id"].dataType.simpleString())
    processor = JobProcessor(int(idle_hours * 3_600_000))
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="EventTime")


def current_status(rows: DataFrame) -> DataFrame:
    """The last row of each job, of all rows that the stream has given."""
    last = F.max_by(F.struct("latest_stage", "active", "completed"), "version").alias("r")
    return rows.groupBy("job_id").agg(last).select("job_id", "r.*")
