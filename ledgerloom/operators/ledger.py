"""Ledgers: keyed upserts, corrections, gaps, verdicts and the reports over them.

Parquet has no merge: an upsert is a union and the latest row a key, which the caller writes anew. Times
such as now are arguments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import r
from ledgerloom.functions.labels import metric_category
from ledgerloom.operators.pairs import pairs_across, similar
from ledgerloom.sources.shared import kept


def upsert(table: DataFrame, batch: DataFrame, keys: tuple[str, ...], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The last row a key by the order column, ties to the batch; `keep` columns hold their first value."""
    both = table.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in table.columns if c not in keys and c not in keep]
    cells = [F.max_by(F.struct(*rest), F.struct("_b", order)).alias("_s")] + [F.min_by(c, F.struct("_b", order)).alias(c) for c in keep]
    out = both.groupBy(*keys).agg(*cells)
    return out.select(*[F.col(f"_s.{c}").alias(c) if c in rest else F.col(c) for c in table.columns])


def lookup(table: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """The latest payload of each requested key, in upper case, with its time; none stays a row."""
    last = table.groupBy(F.upper(key).alias("_k")).agg(F.max_by("payload", order).alias("payload"), F.max(order).alias("saved_at"))
    return requests.withColumn("_k", F.upper(key)).join(last, "_k", "left").select(F.col("_k").alias(key), "payload", "saved_at")


def top_by(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def guidance_digest(track: DataFrame, current: str, latest: int = 12, shown: int = 10) -> DataFrame:
    """Of the latest rows those of other periods: how many, how many LOW, and whether the rule fires."""
    rows = top_by(track, ["ticker"], [F.desc("created_at"), F.desc("id")], latest).where(F.col("fiscal_period") != current)
    rows = top_by(rows, ["ticker"], [F.desc("created_at"), F.desc("id")], shown)
    low = F.sum(F.when(F.upper("credibility").startswith("LOW"), 1).otherwise(0)).cast("int")
    return rows.groupBy("ticker").agg(F.count("*").cast("int").alias("n_shown"), low.alias("n_low"), (low >= 2).alias("fires"))


def record_thesis(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Verdicts by (ticker, fiscal_period); a rewrite clears both evaluations; rows without a recommendation are refused."""
    new = batch.where("recommendation is not null and recommendation <> ''").withColumns({"eval_90": F.lit(None).cast("double"), "eval_180": F.lit(None).cast("double")})
    return upsert(ledger, new, ("ticker", "fiscal_period"), "published_at")


def pending(ledger: DataFrame, horizon: int, now: Column) -> DataFrame:
    """Verdicts not scored for the horizon, old enough for it, with a price."""
    return ledger.where(F.col(f"eval_{horizon}").isNull() & (F.datediff(now, "published_at") >= horizon) & F.col("price").isNotNull())


def score_verdicts(due: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """Move to the last close on or before the horizon, and whether the verdict held; no price, no row.

    Closes and horizons of a ticker are sorted together and each horizon takes the close before it, so work is
    linear in both.
    """
    asked = due.withColumns({"_at": F.date_add(F.col("published_at").cast("date"), horizon), "_due": F.lit(1)})
    closes = prices.where("dt is not null").select("ticker", F.col("dt").alias("_at"), F.lit(0).alias("_due"), F.struct("dt", "close_px").alias("_px"))
    both = asked.select("ticker", "fiscal_period", "recommendation", "price", "_at", "_due").unionByName(closes, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("_at", "_due").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("_last", F.last("_px", ignorenulls=True).over(w)).where("_due = 1 and _last is not null")
    last = at.groupBy("ticker", "fiscal_period", "recommendation", "price").agg(F.max("_last")["close_px"].alias("px"))
    move = r(F.try_divide(F.col("px") - F.col("price"), F.col("price")) * 100, 2)
    hit = F.when(F.col("recommendation").isin("ADD", "BUY"), move > 0).when(F.col("recommendation").isin("SELL", "SHORT"), move < 0).otherwise(F.abs(move) <= 10)
    return last.select("ticker", "fiscal_period", "recommendation", move.alias("move_pct"), hit.alias("hit"))


def track_record(scored: DataFrame, n: int = 6) -> DataFrame:
    """Rows, scored rows and hit rate of the latest verdicts."""
    rows = top_by(scored, ["ticker"], [F.desc("published_at"), F.desc("fiscal_period")], n)
    return rows.groupBy("ticker").agg(F.count("*").cast("int").alias("n"), F.count("hit").cast("int").alias("n_scored"), r(F.avg(F.col("hit").cast("double")), 2).alias("hit_rate"))


def append_corrections(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch that are whole and new by (ticker, agent, period, first 1500 letters of the claim).

    Of repeats in the batch the first by id stays; what could not be verified has confidence 0.5 and is marked.
    """
    keys = ["ticker", "agent_name", "fiscal_period", "_c"]
    named = lambda d: d.withColumn("_c", F.substring("original_claim", 1, 1500))
    whole = named(batch).where("ticker is not null and original_claim <> '' and verified_fact is not null")
    first = top_by(whole, keys, ["id"], 1)
    new = first.join(named(store).select(*keys).distinct(), keys, "left_anti")
    unknown = F.col("verified_fact").startswith("UNVERIFIABLE")
    return new.withColumn("confidence", F.when(unknown, 0.5).otherwise(F.col("confidence"))).drop("_c")


GAP_KEY = ["ticker", "agent_name", "category", "fiscal_period"]


def gap_rows(reported: DataFrame) -> DataFrame:
    """Reported gaps as rows of the gap store, each counted once: (GAP_KEY, description, n, first_seen, last_seen, id).

    reported: (ticker, agent_name, fiscal_period, description, seen, id; category or none). Blank descriptions go, others
    keep 500 letters; a blank category is found from the description; a blank period is UNKNOWN.
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    text = blank("description")
    category = F.coalesce(*([blank("category")] if "category" in reported.columns else []), metric_category(text))
    rows = reported.where(text.isNotNull())
    return rows.select(
        F.upper(F.trim("ticker")).alias("ticker"), "agent_name", category.alias("category"), F.coalesce(blank("fiscal_period"), F.lit("UNKNOWN")).alias("fiscal_period"),
        F.substring(text, 1, 500).alias("description"), F.lit(1).cast("long").alias("n"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), "id",
    )


def upsert_gaps(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The gap store after a batch of gap_rows: by ticker, agent, category and period the sum of counts, and the first description."""
    both = store.unionByName(batch)
    first = F.struct("first_seen", "id")
    agg = [F.sum("n").cast("long").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    return both.groupBy(*GAP_KEY).agg(*agg, F.min_by("description", first).alias("description"), F.min_by("id", first).alias("id"))


def agent_patterns(log: DataFrame, least: float = 0.7, n: int = 5, steps: int = 20) -> DataFrame:
    """The best tool sequences of each agent."""
    rows = log.where(F.col("confidence") >= least).withColumn("tools", F.slice("tools", 1, steps))
    return top_by(rows, ["agent_name"], [F.desc("confidence"), F.desc("run_date"), F.desc("id")], n)


def alike_pairs(new: DataFrame, store: DataFrame, vectors: DataFrame, lo: float = 0.55, hi: float = 0.92) -> DataFrame:
    """New and older rows of one ticker and category, from other periods, whose texts are alike but not the same.

    Rows that repeat an id give a pair once.
    """
    keys = ["ticker", "metric_category"]
    side = lambda d, n: d.join(vectors.select("id"), "id", "left_semi").select(*keys, "id", "fiscal_period", "verified_fact", F.lit(n).alias("side"))
    rows = side(new, 0).unionByName(side(store, 1)).join(vectors.select("id", F.col("embedding").alias("v")), "id")
    known = kept(rows).where(~F.col("verified_fact").startswith("UNVERIFIABLE")).withColumnRenamed("fiscal_period", "period")
    out = similar(pairs_across(known, keys, lo, hi), lo, hi)
    repeated = known.groupBy(*keys, "id").count().where("count > 1")
    return out if repeated.isEmpty() else out.distinct()


def unlinked(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs that no link joins, whichever of the two it names first."""
    either = [F.least("a_id", "b_id").alias("_lo"), F.greatest("a_id", "b_id").alias("_hi")]
    return pairs.select("*", *either).join(linked.select(*either), ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def contradiction_pairs(new: DataFrame, store: DataFrame, linked: DataFrame, vectors: DataFrame, lo: float = 0.55, hi: float = 0.92) -> DataFrame:
    """Pairs of new and older rows that may contradict each other (alike_pairs) and are not linked yet."""
    return unlinked(alike_pairs(new, store, vectors, lo, hi), linked)


def persist_contradictions(store: DataFrame, pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs judged contradictory that the store lacks, with defaults and a rationale of 600 letters."""
    hit = pairs.join(store.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").join(verdicts.where("label = 'CONTRADICTION'"), ["a_id", "b_id"])
    new = top_by(hit, ["a_id", "b_id"], [F.desc("similarity")], 1)
    return new.select("a_id", "b_id", F.coalesce("kind", F.lit("REASON_DRIFT")).alias("kind"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), F.substring("rationale", 1, 600).alias("rationale"))


def memory_block(store: DataFrame, gaps: DataFrame, requests: DataFrame, now: Column, facts_n: int = 4, gaps_n: int = 5, floor: float = 0.8, days: int = 180, least: int = 5) -> DataFrame:
    """(agent_name, ticker, period, facts, gaps, pattern, warning) for each request (agent_name, ticker, fiscal_period).

    The period is the one asked for, else the ticker's latest; a request with neither has a warning. facts: the
    agent's latest of that period at or above the confidence floor. gaps: its most frequent of that period, from
    (agent_name, ticker, fiscal_period, category, n, id). pattern: the mix of the agent's recent corrections over
    all tickers, where there are `least` of them. store also has correction_type.
    """
    latest = store.groupBy("ticker").agg(F.max_by("fiscal_period", F.struct("run_date", "id")).alias("_p"))
    asked = requests.join(latest, "ticker", "left").select("agent_name", "ticker", F.coalesce(F.nullif(F.trim("fiscal_period"), F.lit("")), "_p").alias("period")).distinct()
    keys = ["agent_name", "ticker", "period"]
    joined = lambda c, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c, F.col(v).alias("v")))), lambda x: x["v"]), "; " if v == "verified_fact" else ",")
    good = top_by(store.where(F.col("confidence") >= floor).withColumnRenamed("fiscal_period", "period"), keys, [F.desc("run_date"), F.desc("id")], facts_n)
    facts = good.groupBy(*keys).agg(joined([(-F.unix_micros("run_date")).alias("a"), (-F.col("id")).alias("b")], "verified_fact").alias("facts"))
    often = top_by(gaps.withColumnRenamed("fiscal_period", "period"), keys, [F.desc("n"), "id"], gaps_n)
    gap_text = often.groupBy(*keys).agg(joined([(-F.col("n")).alias("a"), F.col("id").alias("b")], "category").alias("gaps"))
    recent = store.where((F.col("run_date") >= F.date_sub(now, days)) & (F.col("confidence") >= floor)).groupBy("agent_name", "correction_type").agg(F.count("*").alias("n"))
    line = F.concat(F.col("n").cast("string"), F.lit("x "), F.col("correction_type"))
    mix = recent.withColumn("line", line).groupBy("agent_name").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("correction_type").alias("b"), "line"))).alias("l"))
    pattern = mix.where(F.col("total") >= least).select("agent_name", F.array_join(F.transform("l", lambda x: x["line"]), ", ").alias("pattern"))
    out = asked.join(facts, keys, "left").join(gap_text, keys, "left").join(pattern, "agent_name", "left")
    return out.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("facts", "gaps", "pattern")], F.col("period").isNull().alias("warning"))


def audit_trail(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Records by id with their citations parsed and in one line of up to 500 letters."""
    cited = F.from_json("citations", "array<struct<doc: string, page: int>>")
    line = F.array_join(F.transform(cited, lambda c: F.concat_ws(" p.", c["doc"], c["page"].cast("string"))), "; ")
    return ids.join(store, "id", "left").select("id", "ticker", F.coalesce(F.size(cited), F.lit(0)).alias("n_citations"), F.substring(line, 1, 500).alias("citation_line"))


def thesis_drift(store: DataFrame, category: str, n: int = 8) -> DataFrame:
    """Verified rows of one category: the first n by period, date and id, then the first of each period."""
    rows = store.where((F.col("metric_category") == category) & ~F.col("verified_fact").startswith("UNVERIFIABLE"))
    rows = top_by(rows, ["ticker"], ["fiscal_period", "run_date", "id"], n)
    return top_by(rows, ["ticker", "fiscal_period"], ["run_date", "id"], 1).select("ticker", "fiscal_period", "id", "verified_fact")


def silent_gaps(gaps: DataFrame, min_periods: int = 2) -> DataFrame:
    """Categories that a ticker leaves open in several periods, from the gap store: how often in all, and the newest description."""
    periods = F.collect_set("fiscal_period")
    agg = gaps.groupBy("ticker", "category").agg(
        F.countDistinct("fiscal_period").cast("int").alias("n_periods"), F.array_join(F.sort_array(periods), ",").alias("periods"),
        F.sum("n").cast("long").alias("total"), F.max("last_seen").alias("last_seen"), F.max_by("description", F.struct("last_seen", "id")).alias("description"),
    )
    return agg.where(F.col("n_periods") >= min_periods)


def inconsistencies(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with both records nested, or null where one is gone. Only records that pairs name are dealt out with them."""
    named = pairs.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    store = store.select("id", "fiscal_period", "verified_fact").join(named, "id", "left_semi")
    side = lambda p: store.select(F.col("id").alias(f"{p}_id"), F.struct("fiscal_period", "verified_fact").alias(f"fact_{p}"))
    out = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    return out.select("a_id", "b_id", F.col("fact_a.fiscal_period").alias("period_a"), F.col("fact_a.verified_fact").alias("text_a"), F.col("fact_b.fiscal_period").alias("period_b"), F.col("fact_b.verified_fact").alias("text_b"))


def ledger_stats(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def align_schema(df: DataFrame, required: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns added with their defaults; none dropped."""
    new = {c: F.lit(default).cast(kind) for c, (kind, default) in required.items() if c not in df.columns}
    return df.withColumns(new) if new else df
