"""Ratios, trends, anomalies, screens and projections over the fact table, for all tickers at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import NOT_AVAILABLE, gap, r, safe_ratio
from ledgerloom.operators.normalize import lookup_metric

#: The labels under which statements carry each figure.
ALIASES = {
    "sales": ["Sales", "Revenue", "Net Sales", "Revenue from Operations"],
    "ebit": ["Operating Profit", "EBIT"],
    "pat": ["Net Profit", "PAT", "Profit after tax"],
    "other_income": ["Other Income"],
    "interest": ["Interest", "Finance Costs"],
    "depreciation": ["Depreciation"],
    "pbt": ["Profit before tax", "PBT"],
    "cogs": ["Cost of Materials", "Cost of Goods Sold", "Raw Material Cost"],
    "eps": ["EPS in Rs", "EPS"],
    "assets": ["Total Assets"],
    "capital": ["Equity Capital"],
    "reserves": ["Reserves"],
    "debt": ["Borrowings", "Total Debt"],
    "cash": ["Cash Equivalents", "Cash and Bank"],
    "inventory": ["Inventories"],
    "receivables": ["Trade Receivables", "Debtors"],
    "payables": ["Trade Payables", "Creditors"],
    "ocf": ["Cash from Operating Activity", "Operating Cash Flow"],
    "capex": ["Capital Expenditure", "Purchase of Fixed Assets", "Capex"],
}
#: Which statement each figure stands in.
HOME = {m: "profit_loss" for m in ("sales", "ebit", "pat", "other_income", "interest", "depreciation", "pbt", "cogs", "eps")}
HOME |= {m: "balance_sheet" for m in ("assets", "capital", "reserves", "debt", "cash", "inventory", "receivables", "payables")} | {"ocf": "cash_flow", "capex": "cash_flow"}


def wide(facts: DataFrame) -> DataFrame:
    """One row for each ticker and year with a column for each figure; one shuffle by ticker and year."""
    found = lookup_metric(facts, ALIASES)
    home = F.create_map(*[F.lit(x) for kv in HOME.items() for x in kv])
    own = found.where(F.col("statement") == F.element_at(home, F.col("metric")))
    cells = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ALIASES]
    out = own.groupBy("ticker", "period_year").agg(*cells)
    parts = F.coalesce("capital", F.lit(0.0)), F.coalesce("reserves", F.lit(0.0))
    return out.withColumns({"equity": parts[0] + parts[1], "ebitda": F.coalesce("ebit", F.lit(0.0)) + F.coalesce("depreciation", F.lit(0.0))})


def latest(df: DataFrame) -> DataFrame:
    """The latest year of every ticker."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period_year"))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def item(facts: DataFrame, name: str, statement: str, alias: str) -> DataFrame:
    """(ticker, period, period_year, alias) of one line item."""
    return facts.where((F.col("statement") == statement) & (F.col("line_item") == name)).select("ticker", "period", "period_year", F.col("value").alias(alias))


def compute_ratio(facts: DataFrame, num: str, den: str, statement: str) -> DataFrame:
    """num / den to 4 places with a status: what cannot be divided, and ratios beyond 3650, have none."""
    both = item(facts, num, statement, "n").join(item(facts, den, statement, "d"), ["ticker", "period", "period_year"], "full")
    ratio = safe_ratio(F.col("n"), F.col("d"))
    status = F.when(ratio.isNull(), NOT_AVAILABLE).when(F.abs(ratio) > 3650, "OUT_OF_BOUNDS").otherwise("OK")
    out = both.select("ticker", "period_year", status.alias("status"), F.when(status == "OK", ratio).alias("ratio"))
    return out.withColumn("pct", r(F.col("ratio") * 100, 2))


def compare_years(facts: DataFrame, name: str, statement: str, y1: int, y2: int) -> DataFrame:
    """Change between two years: absolute to 2 places, in percent of the base's size."""
    v = lambda y: F.max(F.when(F.col("period_year") == y, F.col("v")))
    both = item(facts, name, statement, "v").groupBy("ticker").agg(v(y1).alias("v1"), v(y2).alias("v2"))
    pct = r(F.try_divide(F.col("v2") - F.col("v1"), F.nullif(F.abs("v1"), F.lit(0.0))) * 100, 2)
    status = F.when(pct.isNull(), NOT_AVAILABLE).when(F.abs(pct) > 365000, "OUT_OF_BOUNDS").otherwise("OK")
    return both.select("ticker", "v1", "v2", r(F.col("v2") - F.col("v1"), 2).alias("abs_change"), F.when(status == "OK", pct).alias("pct_change"), status.alias("status"))


def yearly_change(facts: DataFrame, name: str, statement: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("period_year")
    rows = item(facts, name, statement, "v").withColumn("prev", F.lag("v").over(w))
    return rows.withColumn("change_pct", F.try_divide(F.col("v") - F.col("prev"), F.nullif(F.abs("prev"), F.lit(0.0))) * 100)


def detect_anomaly(facts: DataFrame, name: str, statement: str, limit: float = 30.0) -> DataFrame:
    """Years in which the item rose or fell by more than the limit."""
    rows = yearly_change(facts, name, statement).withColumn("change_pct", r(F.col("change_pct"), 1))
    hit = rows.where((F.abs("change_pct") > limit) & (F.abs("change_pct") <= 365000))
    return hit.select("ticker", "period_year", "change_pct", F.when(F.col("change_pct") > 0, "SPIKE").otherwise("DROP").alias("kind"))


def divergence(facts: DataFrame, name: str, other: str, statement: str, limit: float = 20.0) -> DataFrame:
    """Drift of a yearly ratio from its first to its last year, to 1 place; it takes two points."""
    both = item(facts, name, statement, "n").join(item(facts, other, statement, "d"), ["ticker", "period", "period_year"])
    ratio = both.select("ticker", "period_year", safe_ratio(F.col("n"), F.col("d")).alias("x")).where("abs(x) <= 3650")
    ends = ratio.groupBy("ticker").agg(F.min_by("x", "period_year").alias("first_ratio"), F.max_by("x", "period_year").alias("last_ratio"), F.count("*").alias("n")).where("n >= 2")
    drift = r(F.try_divide(F.col("last_ratio") - F.col("first_ratio"), F.nullif(F.abs("first_ratio"), F.lit(0.0))) * 100, 1)
    return ends.select("ticker", "first_ratio", "last_ratio", drift.alias("drift_pct"), (F.abs(drift) > limit).alias("diverging"))


def compute_cagr(facts: DataFrame, name: str, statement: str, y1: int, y2: int) -> DataFrame:
    """Growth a year between two years in percent, with a status where there is none."""
    v = lambda y: F.max(F.when(F.col("period_year") == y, F.col("v")))
    both = item(facts, name, statement, "v").groupBy("ticker").agg(v(y1).alias("v1"), v(y2).alias("v2"))
    ok = (F.col("v1") > 0) & (F.col("v2") > 0)
    pct = F.when(ok & F.lit(y2 > y1), r((F.pow(F.try_divide(F.col("v2"), F.col("v1")), F.lit(1.0 / max(1, y2 - y1))) - 1) * 100, 2))
    status = F.when(F.lit(y2 <= y1), "BAD_YEARS").when(F.col("v1").isNull() | F.col("v2").isNull(), NOT_AVAILABLE).when(~ok, "NOT_POSITIVE").when(F.abs(pct) > 365000, "OUT_OF_BOUNDS").otherwise("OK")
    return both.select("ticker", F.when(status == "OK", pct).alias("cagr_pct"), status.alias("status"))


def quarterly_trends(quarters: DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """Change against the row before and four rows back, over the size of the base, to 2 places in percent."""
    rows = quarters if metrics is None else quarters.where(F.col("line_item").isin(*metrics))
    w = Window.partitionBy("ticker", "line_item").orderBy("period_no")
    change = lambda k: r(F.try_divide(F.col("value") - F.lag("value", k).over(w), F.nullif(F.abs(F.lag("value", k).over(w)), F.lit(0.0))) * 100, 2)
    return rows.select("ticker", "line_item", "period", "period_no", "value", change(1).alias("qoq_pct"), change(4).alias("yoy_pct"))


#: Figures that move with each other.
RELATED = {"Net Profit": "Other Income", "Operating Profit": "Sales", "Sales": "Operating Profit"}


def verify_anomaly(trends: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (ticker, line_item, period, threshold_pct) against the trends.

    Confirmed where the change beats the threshold; with up to two rows before and one after, and how a
    related figure moved. A quarter without figures is told so.
    """
    w = Window.partitionBy("ticker", "line_item").orderBy("period_no")
    near = F.collect_list(F.struct("period", "qoq_pct")).over(w.rowsBetween(-2, 1))
    rows = trends.withColumn("near", near).select("ticker", "line_item", "period", "qoq_pct", "near")
    pairs = F.create_map(*[F.lit(x) for kv in RELATED.items() for x in kv])
    other = trends.select("ticker", F.col("line_item").alias("related"), "period", F.col("qoq_pct").alias("related_pct"))
    asked = requests.withColumn("related", F.try_element_at(pairs, F.col("line_item")))
    out = asked.join(rows, ["ticker", "line_item", "period"], "left").join(other, ["ticker", "related", "period"], "left")
    reason = F.when(F.col("near").isNull(), "quarter not found").when(F.col("qoq_pct").isNull(), "no base").when(F.abs("qoq_pct") > F.col("threshold_pct"), "confirmed").otherwise("below threshold")
    return out.select("ticker", "line_item", "period", "qoq_pct", "related_pct", F.coalesce(F.size("near"), F.lit(0)).alias("n_near"), (reason == "confirmed").alias("confirmed"), reason.alias("reason"))


def scan_anomalies(trends: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Every metric and quarter above the threshold, verified."""
    hits = trends.where(F.abs("qoq_pct") > threshold * 100).select("ticker", "line_item", "period", F.lit(threshold * 100).alias("threshold_pct"))
    return verify_anomaly(trends, hits)


def cross_reference(facts: DataFrame, a: str, b: str, statement: str, limit: float = 15.0) -> DataFrame:
    """Growth of two items a year, the gap in points, and whether it is wide."""
    g = lambda n, alias: yearly_change(facts, n, statement).select("ticker", "period_year", r(F.col("change_pct"), 1).alias(alias))
    both = g(a, "growth_a").join(g(b, "growth_b"), ["ticker", "period_year"]).where("growth_a is not null and growth_b is not null")
    wide_gap = r(F.col("growth_a") - F.col("growth_b"), 1)
    return both.select("ticker", "period_year", "growth_a", "growth_b", wide_gap.alias("gap_pp"), (F.abs(wide_gap) > limit).alias("diverging"))


# --- the scorecard: expressions over one row of `wide` ---------------------------------------------


def dupont_columns() -> dict[str, Column]:
    margin, turnover, multiplier = safe_ratio(F.col("pat"), F.col("sales")), safe_ratio(F.col("sales"), F.col("assets")), safe_ratio(F.col("assets"), F.col("equity"))
    roe = r(margin * turnover * multiplier, 4)
    driver = F.when(margin > 0.15, "margin").when(multiplier > 2.5, "leverage").otherwise("turnover")
    return {"net_margin": margin, "asset_turnover": turnover, "equity_multiplier": multiplier, "roe": roe, "driver": F.when(roe.isNotNull(), driver)}


def roic_columns(wacc: float = 0.12) -> dict[str, Column]:
    invested = F.col("equity") + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    status = F.when(F.col("ebit").isNull(), "MISSING").when(invested <= 0, "UNVERIFIABLE_NEGATIVE").when((F.col("sales") != 0) & (invested < F.col("sales") * 0.05), "UNVERIFIABLE_SMALL").otherwise("OK")
    value = F.when(status == "OK", safe_ratio(F.col("ebit") * 0.75, invested))
    return {"roic": value, "roic_status": status, "roic_flag": F.coalesce(value < wacc, F.lit(False))}


def earnings_columns() -> dict[str, Column]:
    fcf = F.col("ocf") - F.abs("capex")
    return {"ocf_ebitda": safe_ratio(F.col("ocf"), F.col("ebitda")), "fcf_pat": safe_ratio(fcf, F.col("pat"))}


def working_capital_columns() -> dict[str, Column]:
    ok = (F.col("cogs") > 0) & (F.col("sales") > 0)
    days = lambda x, base: F.when(ok & (F.col(x) != 0) if x != "receivables" else ok, r(F.try_divide(F.col(x), F.col(base)) * 365, 1))
    within = lambda x: F.when(F.abs(x) <= 3650, x)
    dio, dso, dpo = within(days("inventory", "cogs")), within(days("receivables", "sales")), within(days("payables", "cogs"))
    return {"dio": dio, "dso": dso, "dpo": dpo, "ccc": r(dio + dso - dpo, 1)}


def leverage_columns() -> dict[str, Column]:
    cover = safe_ratio(F.col("ebit"), F.col("interest"))
    net = F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    return {"interest_coverage": cover, "coverage_flag": F.coalesce(cover < 3, F.lit(False)), "net_debt_ebitda": F.when(F.col("ebitda") > 0, safe_ratio(net, F.col("ebitda")))}


def gap_columns() -> Column:
    """Every refused ratio of a row, as an array of (metric, reason, year, action)."""
    y = F.col("period_year")
    return F.array_compact(F.array(
        gap(F.col("pat"), F.col("sales"), "net_margin", y, "PAT", "Revenue"),
        gap(F.col("sales"), F.col("assets"), "asset_turnover", y, "Revenue", "Total Assets"),
        gap(F.col("assets"), F.col("equity"), "equity_multiplier", y, "Total Assets", "Total Equity"),
        gap(F.col("ocf"), F.col("ebitda"), "ocf_ebitda", y, "OCF", "EBITDA"),
        gap(F.col("ebit"), F.col("interest"), "interest_coverage", y, "EBIT", "Interest"),
        gap(F.col("inventory"), F.col("cogs"), "dio", y, "Inventories", "COGS"),
    ))


def revenue_cagr(wide_facts: DataFrame, least_years: int = 4) -> DataFrame:
    """Growth from the first to the last year where there are enough of them and both are positive."""
    ends = wide_facts.where("sales is not null").groupBy("ticker").agg(F.min_by("sales", "period_year").alias("a"), F.max_by("sales", "period_year").alias("b"), F.count("*").alias("n"))
    ok = ends.where((F.col("n") >= least_years) & (F.col("a") > 0) & (F.col("b") > 0))
    return ok.select("ticker", (F.col("n") - 1).alias("years"), r((F.pow(F.col("b") / F.col("a"), 1 / (F.col("n") - 1)) - 1) * 100, 2).alias("revenue_cagr_pct"))


def implied_growth(df: DataFrame, wacc: float = 0.12, tg: float = 0.05, years: int = 10) -> DataFrame:
    """Growth at which discounted cash flows and a terminal value equal the market value, by bisection.

    df: (ticker, market_cap, fcf). Thirteen halvings of [0, 0.5] reach 1e-4. Bad inputs give null.
    """
    steps = F.sequence(F.lit(1), F.lit(years))

    def worth(g: Column) -> Column:
        flow = F.aggregate(steps, F.lit(0.0), lambda acc, t: acc + F.pow((1 + g) / (1 + wacc), t.cast("double")))
        end = F.pow((1 + g) / (1 + wacc), F.lit(float(years))) * (1 + tg) / (wacc - tg)
        return F.col("fcf") * (flow + end)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(0.5).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = worth(mid) < F.col("market_cap")
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, halve)
    ok = (F.col("market_cap") > 0) & (F.col("fcf") > 0)
    return df.select("ticker", F.when(ok, r((found["lo"] + found["hi"]) / 2, 4)).alias("implied_growth"))


def quarterly_bridge(quarters: DataFrame) -> DataFrame:
    """The latest quarter: profit up by more than 30 % on a positive base, or other income over 15 % of pre-tax profit."""
    v = lambda m: F.max(F.when(F.col("line_item") == m, F.col("value")))
    rows = quarters.groupBy("ticker", "period", "period_no").agg(v("Net Profit").alias("pat"), v("Other Income").alias("oi"), v("Profit before tax").alias("pbt"))
    w = Window.partitionBy("ticker").orderBy("period_no")
    rows = rows.withColumn("prev", F.lag("pat").over(w)).withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period_no")))).where("_k = 1 and prev is not null or _k = 1")
    growth = F.when(F.col("prev") > 0, r(F.try_divide(F.col("pat") - F.col("prev"), F.col("prev")), 4))
    share = safe_ratio(F.col("oi"), F.col("pbt"))
    return rows.select("ticker", "period", growth.alias("pat_growth"), share.alias("other_income_share"), F.coalesce((growth > 0.30) | (share > 0.15), growth > 0.30, share > 0.15, F.lit(False)).alias("flag"))


def _growth_pair() -> tuple[Column, Column]:
    """Growth of profit and of cash over the year before."""
    g = F.try_divide(F.col("pat") - F.col("pat0"), F.nullif(F.col("pat0"), F.lit(0.0)))
    o = F.coalesce(F.try_divide(F.col("ocf") - F.col("ocf0"), F.nullif(F.abs("ocf0"), F.lit(0.0))), F.lit(0.0))
    return g, o


def annual_bridge(wide_facts: DataFrame, quarterly: DataFrame) -> DataFrame:
    """Where the quarter raised no flag: profit grew ahead of cash by over 10 points, or exceeds it."""
    w = Window.partitionBy("ticker").orderBy("period_year")
    rows = wide_facts.select("ticker", "period_year", "pat", "ocf", F.lag("pat").over(w).alias("pat0"), F.lag("ocf").over(w).alias("ocf0"))
    last = latest(rows).where("pat <> 0 and pat0 > 0")
    g, o = _growth_pair()
    kept = last.join(quarterly.where("flag").select("ticker"), "ticker", "left_anti")
    return kept.select("ticker", "period_year", r(g, 4).alias("pat_growth"), r(o, 4).alias("ocf_growth"), F.coalesce((g > o + 0.10) | (F.col("pat") > F.col("ocf")), F.lit(False)).alias("flag"))


def scorecard(facts: DataFrame, quarters: DataFrame, wacc: float = 0.12) -> DataFrame:
    """One row a ticker: the latest year's findings, flags, gaps and a confidence.

    Facts and quarters are read once each: what needs other years comes from windows over a ticker's years.
    """
    years = Window.partitionBy("ticker")
    order = years.orderBy("period_year")
    w = wide(facts).withColumns({
        "pat0": F.lag("pat").over(order), "ocf0": F.lag("ocf").over(order), "_n": F.count("sales").over(years),
        "_a": F.min_by("sales", F.when(F.col("sales").isNotNull(), F.col("period_year"))).over(years), "_b": F.max_by("sales", F.when(F.col("sales").isNotNull(), F.col("period_year"))).over(years),
    })
    columns = dupont_columns() | roic_columns(wacc) | earnings_columns() | working_capital_columns() | leverage_columns() | {"gaps": gap_columns()}
    growing = (F.col("_n") >= 4) & (F.col("_a") > 0) & (F.col("_b") > 0)
    columns["revenue_cagr_pct"] = F.when(growing, r((F.pow(F.try_divide(F.col("_b"), F.col("_a")), 1 / F.greatest(F.col("_n") - 1, F.lit(1))) - 1) * 100, 2))
    own = latest(w).withColumns(columns)
    out = own.join(quarterly_bridge(quarters).select("ticker", F.col("flag").alias("quarter_flag")), "ticker", "left")
    g, o = _growth_pair()
    quarter = F.coalesce("quarter_flag", F.lit(False))
    annual = ~quarter & (F.col("pat") != 0) & (F.col("pat0") > 0) & ((g > o + 0.10) | (F.col("pat") > F.col("ocf")))
    flags = [F.col("roic_flag"), F.col("coverage_flag"), quarter, F.coalesce(annual, F.lit(False))]
    n_flags = reduce(lambda x, y: x + y, [f.cast("int") for f in flags])
    return out.select(
        "ticker", "period_year", "roe", "driver", "roic", "roic_status", "ocf_ebitda", "fcf_pat", "ccc", "interest_coverage", "net_debt_ebitda", "revenue_cagr_pct",
        n_flags.alias("n_flags"), F.size("gaps").alias("n_gaps"), r(F.greatest(F.lit(0.5), 1 - 0.1 * F.size("gaps")), 2).alias("confidence"),
    )


def kill_screen(wide_facts: DataFrame, holdings: DataFrame | None = None) -> DataFrame:
    """Eight rules over the last years: what kills, what warns, what could not be judged, and whether a ticker passes.

    holdings: (ticker, pledge, promoter) in percent, one row a ticker.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("period_year"))
    asc = Window.partitionBy("ticker").orderBy("period_year")
    rows = wide_facts.select("*", F.row_number().over(w).alias("k"), F.lag("sales").over(asc).alias("s0"), F.lag("ebit").over(asc).alias("e0"))
    rows = rows.withColumns({"m": F.when(F.col("sales") > 0, F.col("ebit") / F.col("sales")), "m0": F.when(F.col("s0") > 0, F.col("e0") / F.col("s0"))})
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("int")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    agg = rows.groupBy("ticker").agg(
        F.count("sales").alias("years"), F.count("pat").alias("n_pat"), F.count("ocf").alias("n_ocf"), n((F.col("k") <= 2) & (F.col("sales") < F.col("s0"))).alias("declines"), at("sales", 1).alias("s_now"), at("sales", 6).alias("s_then"),
        n((F.col("k") <= 5) & (F.col("pat") < 0)).alias("losses"), n((F.col("k") <= 5) & (F.col("pat") > 0) & (F.col("ocf") < 0)).alias("no_cash"),
        at("debt", 1).alias("debt"), at("equity", 1).alias("equity"), at("ebit", 1).alias("ebit"), at("interest", 1).alias("interest"),
        n((F.col("k") <= 2) & (F.col("m") < F.col("m0"))).alias("margin_falls"),
    )
    if holdings is None:
        agg = agg.withColumns({"pledge": F.lit(None).cast("double"), "promoter": F.lit(None).cast("double")})
    else:
        agg = agg.join(holdings.select("ticker", "pledge", "promoter"), "ticker", "left")
    cagr = F.when((F.col("s_then") > 0) & (F.col("s_now") > 0), (F.pow(F.col("s_now") / F.col("s_then"), F.lit(0.2)) - 1) * 100)
    de = F.when((F.col("equity") > 0) & (F.col("debt") > 0), F.col("debt") / F.col("equity"))
    cover = F.when(F.col("interest") > 0, F.col("ebit") / F.col("interest"))
    kills = {"revenue_decline": (F.col("years") >= 3) & (F.col("declines") >= 2), "losses": F.col("losses") >= 3, "no_cash": F.col("no_cash") >= 3, "debt": de > 3, "coverage": cover < 1.5, "pledge": F.col("pledge") > 30}
    warns = {"slow_growth": cagr < 5, "losses": F.col("losses") == 2, "no_cash": F.col("no_cash") == 2, "debt": (de > 1.5) & (de <= 3), "coverage": (cover >= 1.5) & (cover < 3), "pledge": (F.col("pledge") > 15) & (F.col("pledge") <= 30), "promoter": F.col("promoter") < 25, "margin": F.col("margin_falls") >= 2}
    listed = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    gaps = {"revenue": F.col("years") < 3, "cash_flow": (F.col("n_pat") == 0) | (F.col("n_ocf") == 0), "debt": de.isNull(), "pledge": F.col("pledge").isNull(), "promoter": F.col("promoter").isNull()}
    names = {"kill_reasons": kills, "warnings": warns, "gaps": gaps}
    out = agg.withColumns({name: F.array_join(listed(rules), ",") for name, rules in names.items()})
    figures = [r(cagr, 1).alias("revenue_cagr_5y"), r(de, 2).alias("debt_equity"), r(cover, 1).alias("interest_cover")]
    return out.select("ticker", (F.col("kill_reasons") == "").alias("passed"), *names, *figures)


def project(base: DataFrame, cases: DataFrame, years: int = 3) -> DataFrame:
    """Revenue, EBITDA, pre-tax profit, profit, EPS and price under each case; whole numbers at every step.

    base: (ticker, sales, interest, depreciation, pat, eps, pe); cases: (case, growth, margin, tax), a few rows.
    """
    b = lambda x: F.bround(x, 0)
    rows = base.join(F.broadcast(cases)).withColumn("year_no", F.explode(F.sequence(F.lit(1), F.lit(years))))
    sales = F.aggregate(F.sequence(F.lit(1), F.col("year_no")), F.col("sales"), lambda acc, _: b(acc * (1 + F.col("growth"))))
    rows = rows.withColumn("revenue", sales).withColumn("ebitda", b(F.col("revenue") * F.col("margin"))).withColumn("pbt", F.col("ebitda") - b(F.col("interest")) - b(F.col("depreciation")))
    rows = rows.withColumn("profit", b(F.col("pbt") * (1 - F.col("tax")))).withColumn("shares", F.nullif(b(F.try_divide(F.col("pat"), F.nullif(F.col("eps"), F.lit(0.0)))), F.lit(0.0)))
    eps = r(F.try_divide(F.col("profit"), F.col("shares")), 2)
    return rows.select("ticker", "case", "year_no", "revenue", "ebitda", "pbt", "profit", eps.alias("eps"), r(eps * F.col("pe"), 0).alias("price"))


def future_pe(history: DataFrame, growth: DataFrame) -> DataFrame:
    """The median past PE moved by growth ahead less growth behind, scaled by size, within 30 % of base, then of the sector.

    history: (ticker, period_year, pe, eps); growth: (ticker, cagr, sector_pe, size).
    """
    w = Window.partitionBy("ticker").orderBy("period_year")
    rows = history.withColumn("e0", F.lag("eps").over(w)).withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period_year"))))
    logs = F.avg(F.when((F.col("eps") > 0) & (F.col("e0") > 0), F.ln(F.try_divide(F.col("eps"), F.col("e0")))))
    own = rows.groupBy("ticker").agg(F.median("pe").alias("base"), F.max(F.when(F.col("_k") == 1, F.col("eps"))).alias("now"), F.max(F.when(F.col("_k") == 4, F.col("eps"))).alias("then"), logs.alias("logs"))
    trailing = F.coalesce(F.when((F.col("now") > 0) & (F.col("then") > 0), F.pow(F.try_divide(F.col("now"), F.col("then")), F.lit(1 / 3)) - 1), F.exp("logs") - 1, F.lit(0.0))
    k = F.when(F.col("size") == "small", 1.2).when(F.col("size") == "mid", 1.0).otherwise(0.6)
    raw = F.col("base") * (1 + k * (F.col("cagr") - trailing))
    clip = lambda x, mid: F.greatest(F.least(x, mid * 1.3), mid * 0.7)
    out = own.join(growth, "ticker")
    return out.select("ticker", r(F.col("base"), 2).alias("base_pe"), r(trailing, 4).alias("trailing_cagr"), r(clip(clip(raw, F.col("base")), F.col("sector_pe")), 2).alias("future_pe"))


def pe_history(eps: DataFrame, prices: DataFrame) -> DataFrame:
    """Year-end price over earnings, both positive, to 2 places. eps, prices: (ticker, period_year, ...)."""
    both = eps.join(prices, ["ticker", "period_year"]).where("eps > 0 and price > 0")
    return both.select("ticker", "period_year", "eps", "price", r(F.col("price") / F.col("eps"), 2).alias("pe"))


def size_class(price: Column, shares: Column) -> Column:
    """small under 5000 crore, mid up to 20000, else large; null for what is not positive."""
    cap = price * shares / 1e7
    return F.when((price > 0) & (shares > 0), F.when(cap < 5000, "small").when(cap <= 20000, "mid").otherwise("large"))


def cash_grade(ratio: Column) -> Column:
    """A, B or C by cash from operations over EBITDA."""
    return F.when(ratio >= 0.8, "A").when(ratio >= 0.5, "B").when(ratio.isNotNull(), "C")


def cash_strength(ratio: Column) -> tuple[Column, Column]:
    """(percent, 100 at most and halves upwards; STRONG from 80, MODERATE from 50, else WEAK); null without a ratio."""
    pct = F.when(ratio.isNotNull(), F.least(F.floor(ratio * 100 + 0.5), F.lit(100))).cast("int")
    return pct, F.when(pct >= 80, "STRONG").when(pct >= 50, "MODERATE").when(pct.isNotNull(), "WEAK")


def holdings_trend(holdings: DataFrame, holder: str = "Promoters") -> DataFrame:
    """The holder's share a quarter and its change; a ticker without the row says so."""
    rows = holdings.where(F.col("holder") == holder)
    w = Window.partitionBy("ticker").orderBy("period_no")
    own = rows.select("ticker", "period", "pct", r(F.col("pct") - F.lag("pct").over(w), 2).alias("change"), F.lit("OK").alias("status"))
    none = holdings.select("ticker").distinct().join(rows.select("ticker").distinct(), "ticker", "left_anti")
    return own.unionByName(none.select("ticker", F.lit(None).cast("string").alias("period"), F.lit(None).cast("double").alias("pct"), F.lit(None).cast("double").alias("change"), F.lit(NOT_AVAILABLE).alias("status")))


def with_fallback(live: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(ticker, payload): the live one, else the last good snapshot, marked stale with its time."""
    s = snapshots.groupBy("ticker").agg(F.max_by("payload", "saved_at").alias("old"), F.max("saved_at").alias("saved_at"))
    both = live.join(s, "ticker", "full")
    stale = F.col("payload").isNull()
    return both.select("ticker", F.coalesce("payload", "old").alias("payload"), stale.alias("stale"), F.when(stale, F.col("saved_at")).alias("saved_at"))
