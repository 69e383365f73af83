"""News events, signals and impacts, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_from_feed(feed: DataFrame, tier: int = 2) -> DataFrame:
    """Events with an id from url and title and the source's domain. feed: (url, title, ts[, tier]).

    The source that delivers an event gives its tier: exchanges 1, news 2; a feed without that column has one tier.
    """
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("unknown"))), r"^www\.", "")
    own = F.col("tier") if "tier" in feed.columns else F.lit(tier)
    return feed.select(F.md5(F.concat_ws("-", "url", "title").cast("binary")).alias("event_id"), "title", "url", host.alias("source"), own.alias("tier"), "ts")


def unavailable_sources(fetches: DataFrame) -> DataFrame:
    """Sources that gave nothing, with why: (ticker, source as "name (Timeout)" or "name (Error)").

    fetches: (ticker, source, outcome), outcome null or ok where the source answered.
    """
    bad = F.lower(F.coalesce("outcome", F.lit("ok")))
    why = F.when(bad == "timeout", "Timeout").otherwise("Error")
    return fetches.where(bad != "ok").select("ticker", F.concat("source", F.lit(" ("), why, F.lit(")")).alias("source")).distinct()


def prefilter(events: DataFrame, noise: str = r"(?i)trading window") -> DataFrame:
    """No notices of noise; the first event of each lower-cased title."""
    first = F.min_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("e")
    return events.where(~F.col("title").rlike(noise)).groupBy(F.lower(F.trim("title"))).agg(first).select("e.*")


def prefilter_stream(events: DataFrame, delay: str = "1 hour", noise: str = r"(?i)trading window") -> DataFrame:
    """The same on a stream: a title that comes again within the watermark's delay is dropped; state is bounded by it."""
    return events.where(~F.col("title").rlike(noise)).withColumn("key", F.lower(F.trim("title"))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"]).drop("key")


def signals(events: DataFrame, scores: DataFrame, threshold: int = 60) -> DataFrame:
    """Events with their given scores, from the threshold up; `high` confidence of second-tier sources is capped."""
    rows = events.join(scores, "event_id")
    capped = F.when((F.col("tier") >= 2) & (F.col("confidence") == "high"), "medium").otherwise(F.coalesce("confidence", F.lit("low")))
    return rows.where(F.coalesce("score", F.lit(0)) >= threshold).withColumn("confidence", capped)


def impacts(signals_df: DataFrame, rows: DataFrame) -> DataFrame:
    """Signals with what they mean for the thesis; a signal without an impact stays, with defaults."""
    out = signals_df.join(rows, "event_id", "left")
    return out.withColumns({"direction": F.coalesce("direction", F.lit("neutral")), "magnitude": F.coalesce("magnitude", F.lit("none"))})


def fresh(events: DataFrame, now, ttl_minutes: int = 20) -> DataFrame:
    """Whether a ticker's newest fetch is recent enough to be used again."""
    last = events.groupBy("ticker").agg(F.max("fetched_at").alias("last_fetch"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_fetch")
    return last.select("ticker", "last_fetch", (age <= ttl_minutes * 60).alias("reuse"))


def fetch_windows(events: DataFrame, width: str = "20 minutes", delay: str = "20 minutes") -> DataFrame:
    """Events of each ticker and tumbling window, on a stream or a batch."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    out = timed.groupBy("ticker", F.window("ts", width)).agg(F.count("*").alias("n"))
    return out.select("ticker", F.col("window.start").alias("window_start"), "n")
