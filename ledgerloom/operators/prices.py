"""Price series: weekly closes, swings, as-of returns and their fundamental background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import r
from ledgerloom.functions.fiscal import fiscal_year

SWING = "struct<kind: string, start: date, start_px: double, end: date, end_px: double, ongoing: boolean>"


def weekly_closes(ticks: DataFrame, min_points: int = 30) -> DataFrame:
    """Last price of each week at the first venue that has enough weeks. ticks: (ticker, venue_no, ts, px)."""
    weeks = ticks.groupBy("ticker", "venue_no", F.date_trunc("week", "ts").cast("date").alias("dt")).agg(F.max_by("px", "ts").alias("close_px"))
    n = F.count("*").over(Window.partitionBy("ticker", "venue_no"))
    enough = weeks.withColumn("_n", n).where(F.col("_n") >= min_points)
    first = F.min("venue_no").over(Window.partitionBy("ticker"))
    return enough.withColumn("_f", first).where("venue_no = _f").select("ticker", "venue_no", "dt", "close_px")


def swing_episodes(prices: DataFrame, threshold: float = 0.25, min_points: int = 8) -> DataFrame:
    """Zigzag episodes of each series as a native fold over its sorted points.

    Before a trend both extremes are tracked; the first to be left by the threshold starts it. The running
    extreme of a move is the last point that reaches it; a reversal by the threshold from there closes an episode there and starts the next. The open move
    is kept if it makes half the threshold, and ends at the last point. Series of one ticker are folded in
    one row; weekly closes of a century are some 5,000 points.
    """
    up, down = 1 + threshold, 1 - threshold
    points = prices.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("dt", "close_px"))).alias("pts")).where(F.size("pts") >= min_points)
    first = F.element_at("pts", 1)
    point = lambda p: F.struct(p["dt"].alias("dt"), p["close_px"].alias("px"))
    empty = F.array().cast(f"array<{SWING}>")
    start = F.struct(F.lit(0).alias("dir"), point(first).alias("lo"), point(first).alias("hi"), point(first).alias("from"), empty.alias("out"))

    def closed(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a["dt"].alias("start"), a["px"].alias("start_px"), b["dt"].alias("end"), b["px"].alias("end_px"), F.lit(False).alias("ongoing"))

    def state(d: Column | int, lo: Column, hi: Column, origin: Column, out: Column) -> Column:
        return F.struct((F.lit(d) if isinstance(d, int) else d).alias("dir"), lo.alias("lo"), hi.alias("hi"), origin.alias("from"), out.alias("out"))

    def step(s: Column, p: Column) -> Column:
        now, px = point(p), p["close_px"]
        lo, hi = F.when(px < s["lo"]["px"], now).otherwise(s["lo"]), F.when(px > s["hi"]["px"], now).otherwise(s["hi"])
        undecided = (
            F.when(px >= s["lo"]["px"] * up, state(1, s["lo"], now, s["lo"], s["out"]))
            .when(px <= s["hi"]["px"] * down, state(-1, now, s["hi"], s["hi"], s["out"]))
            .otherwise(state(0, lo, hi, s["from"], s["out"]))
        )
        rising = F.when(px >= s["hi"]["px"], state(1, s["lo"], now, s["from"], s["out"])).when(
            px <= s["hi"]["px"] * down, state(-1, now, s["hi"], s["hi"], F.concat(s["out"], F.array(closed("rally", s["from"], s["hi"]))))
        ).otherwise(s)
        falling = F.when(px <= s["lo"]["px"], state(-1, now, s["hi"], s["from"], s["out"])).when(
            px >= s["lo"]["px"] * up, state(1, s["lo"], now, s["lo"], F.concat(s["out"], F.array(closed("decline", s["from"], s["lo"]))))
        ).otherwise(s)
        return F.when(s["dir"] == 0, undecided).when(s["dir"] == 1, rising).otherwise(falling)

    folded = points.select("ticker", F.element_at("pts", -1).alias("last"), F.aggregate(F.slice("pts", F.lit(2), F.size("pts")), start, step).alias("s"))
    s, last = F.col("s"), F.col("last")
    move = F.abs(last["close_px"] / s["from"]["px"] - 1)
    tail = F.when(
        (s["dir"] != 0) & (move >= threshold / 2) & (last["dt"] > s["from"]["dt"]),
        F.array(F.struct(F.when(s["dir"] == 1, "rally").otherwise("decline").alias("kind"), s["from"]["dt"].alias("start"), s["from"]["px"].alias("start_px"), last["dt"].alias("end"), last["close_px"].alias("end_px"), F.lit(True).alias("ongoing"))),
    ).otherwise(empty)
    rows = folded.select("ticker", F.inline(F.concat(s["out"], tail)))
    weeks = F.greatest(F.lit(1), F.round(F.datediff("end", "start") / 7).cast("int"))
    return rows.select("ticker", "kind", "start", "end", r(F.col("start_px"), 2).alias("start_px"), r(F.col("end_px"), 2).alias("end_px"), r((F.col("end_px") / F.col("start_px") - 1) * 100, 1).alias("change_pct"), weeks.alias("weeks"), fiscal_year(F.col("start")).alias("fy_start"), fiscal_year(F.col("end")).alias("fy_end"), "ongoing")


def asof_returns(prices: DataFrame, years: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Change to the last close from that on or before the same day N years back (days up to the 28th).

    Where no close is that old, the first one stands in if the history is at least 360 N days long.
    One aggregation finds all anchors.
    """
    ends = prices.groupBy("ticker").agg(F.max("dt").alias("last_dt"), F.min("dt").alias("first_dt"))
    rows = prices.join(ends, "ticker")
    anchor = lambda n: F.make_date(F.year("last_dt") - n, F.month("last_dt"), F.least(F.dayofmonth("last_dt"), F.lit(28)))
    cells = [F.max_by("close_px", "dt").alias("now"), F.min_by("close_px", "dt").alias("first_px"), F.first("last_dt").alias("last_dt"), F.first("first_dt").alias("first_dt")]
    cells += [F.expr("max_by(close_px, dt)").alias("_x")]
    back = [F.max(F.when(F.col("dt") <= anchor(n), F.struct("dt", "close_px")))["close_px"].alias(f"p{n}") for n in years]
    agg = rows.groupBy("ticker").agg(*cells[:-1], *back)
    base = lambda n: F.coalesce(F.col(f"p{n}"), F.when(F.datediff("last_dt", "first_dt") >= 360 * n, F.col("first_px")))
    return agg.select("ticker", *[r(F.try_divide(F.col("now") - base(n), base(n)) * 100, 1).alias(f"return_{n}y") for n in years])


def high_52w(prices: DataFrame) -> DataFrame:
    """Highest close within a year of the last one, and how far below it the last one is."""
    last = F.max("dt").over(Window.partitionBy("ticker"))
    rows = prices.withColumn("_l", last).where(F.col("dt") >= F.date_sub("_l", 365))
    agg = rows.groupBy("ticker").agg(F.max("close_px").alias("high"), F.max_by("close_px", "dt").alias("now"))
    return agg.select("ticker", r(F.col("high"), 2).alias("high_52w"), r((1 - F.col("now") / F.col("high")) * 100, 1).alias("below_pct"))


def top_episodes(episodes: DataFrame, n_recent: int = 6, n_largest: int = 3) -> DataFrame:
    """The latest episodes of a ticker, with those of the largest changes marked."""
    recent = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("start")))
    kept = episodes.withColumn("_k", recent).where(F.col("_k") <= n_recent)
    size = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(F.abs("change_pct")), F.desc("start")))
    return kept.withColumn("evidence", size <= n_largest).drop("_k")


def episode_backdrop(episodes: DataFrame, wide_facts: DataFrame) -> DataFrame:
    """Revenue and profit in an episode's first and last fiscal year, with the change."""
    f = wide_facts.select("ticker", "period_year", "sales", "pat")
    a = f.select("ticker", F.col("period_year").alias("fy_start"), F.col("sales").alias("sales_a"), F.col("pat").alias("pat_a"))
    b = f.select("ticker", F.col("period_year").alias("fy_end"), F.col("sales").alias("sales_b"), F.col("pat").alias("pat_b"))
    out = episodes.join(a, ["ticker", "fy_start"], "left").join(b, ["ticker", "fy_end"], "left")
    change = lambda x: r(F.try_divide(F.col(f"{x}_b") - F.col(f"{x}_a"), F.nullif(F.abs(f"{x}_a"), F.lit(0.0))) * 100, 1)
    return out.select("ticker", "kind", "start", "end", "sales_a", "sales_b", change("sales").alias("sales_change_pct"), change("pat").alias("pat_change_pct"))


def _within(prices: DataFrame, spans: DataFrame) -> DataFrame:
    """Prices with each span (ticker, ..., _a, _b) that covers their day; both sides are dealt by ticker and month."""
    months = F.sequence(F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr("interval 1 month"))
    asked = spans.where("_a <= _b").withColumn("_m", F.explode(months))
    rows = prices.withColumn("_m", F.trunc("dt", "month"))
    return rows.join(asked, ["ticker", "_m"]).where(F.col("dt").between(F.col("_a"), F.col("_b"))).drop("_m")


def year_end_price(prices: DataFrame, years: DataFrame, month: int = 3, day: int = 31) -> DataFrame:
    """Close on the last day of a fiscal year, else the last within 14 days before, then 35, else null. years: (ticker, period_year)."""
    target = F.make_date(F.col("period_year"), F.lit(month), F.lit(day))
    asked = years.withColumn("_t", target)
    near = _within(prices, asked.select("ticker", "period_year", F.date_sub("_t", 35).alias("_a"), F.col("_t").alias("_b")))
    best = near.groupBy("ticker", "period_year").agg(F.max_by("close_px", "dt").alias("price"), F.max("dt").alias("price_dt"))
    tier = F.when(F.col("price_dt") == F.col("_t"), "exact").when(F.datediff("_t", "price_dt") <= 14, "within_14").when(F.col("price_dt").isNotNull(), "within_35").otherwise("none")
    return asked.join(best, ["ticker", "period_year"], "left").select("ticker", "period_year", "price", "price_dt", tier.alias("tier"))


def band_points(prices: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every point with its place in the series and the start of the first episode that covers it.

    The range join runs within a month of a ticker: an episode is dealt to all its months.
    """
    placed = prices.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("dt")))
    bands = episodes.where("end > start").select("ticker", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = _within(prices, bands).groupBy("ticker", "dt").agg(F.min("_a").alias("band_start"))
    return placed.join(hit, ["ticker", "dt"], "left").select("ticker", "dt", "place", "band_start")
