"""Statements as a long fact table: ticker, statement, line_no, line_item, period, period_year, value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import NOT_AVAILABLE, clean_label, to_number
from ledgerloom.functions.fiscal import month_number

#: Display titles of statements and their canonical names.
STATEMENTS = {
    "Quarterly Results": "quarterly_results",
    "Profit & Loss": "profit_loss",
    "Balance Sheet": "balance_sheet",
    "Cash Flows": "cash_flow",
    "Ratios": "ratios",
    "Shareholding Pattern": "shareholding",
    "Peer Comparison": "peers",
}
PERIOD = r"^(Mar|Jun|Sep|Dec) \d{4}$"


def canonical_statement(title: Column) -> Column:
    """Known titles by the table above; others in lower case with underscores."""
    known = F.create_map(*[F.lit(x) for pair in STATEMENTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, title), F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "&", "and"), r"\s+", "_"))


def period_year(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d{4})", 1).try_cast("int")


def unpivot_statements(raw: DataFrame) -> DataFrame:
    """Facts from (ticker, statement, row_no, label, cells map): fiscal columns only, later duplicates win."""
    cells = raw.select("ticker", canonical_statement(F.col("statement")).alias("statement"), "row_no", clean_label("label").alias("line_item"), F.explode("cells").alias("period", "raw"))
    kept = cells.where(F.col("line_item").isNotNull() & (F.col("line_item") != "") & F.col("period").rlike(PERIOD))
    facts = kept.groupBy("ticker", "statement", "line_item", "period").agg(F.max_by(to_number("raw"), "row_no").alias("value"), F.max("row_no").alias("line_no"))
    return facts.select("ticker", "statement", "line_no", "line_item", "period", period_year(F.col("period")).alias("period_year"), "value")


def clean_peers(peers: DataFrame) -> DataFrame:
    """Peers in long form (ticker, name, metric, num, text) from (ticker, cells map): numbers where they can be read."""
    named = peers.withColumn("name", F.trim(F.try_element_at("cells", F.lit("Name")))).where("name <> ''")
    long = named.select("ticker", "name", F.explode("cells").alias("metric", "raw")).where(~F.col("metric").isin("S.No.", "Name"))
    num = to_number("raw")
    return long.select("ticker", "name", "metric", num.alias("num"), F.when(num.isNull(), F.nullif(F.trim("raw"), F.lit(""))).alias("text"))


def compare_to_peers(values: DataFrame, peers: DataFrame, group: str = "peer_group") -> DataFrame:
    """(ticker, value) against the median of its group's peers; a ticker without any is told so."""
    medians = peers.groupBy(group).agg(F.median("value").alias("peer_median"), F.count("value").alias("n_peers"))
    joined = values.join(medians, group, "left")
    return joined.select("ticker", group, "value", "peer_median", F.coalesce("n_peers", F.lit(0)).alias("n_peers"), F.when(F.coalesce("n_peers", F.lit(0)) == 0, "DATA NOT AVAILABLE").otherwise("OK").alias("status"))


def compact_statement(facts: DataFrame, years: list[int], keys: tuple[str, ...] = ("ticker", "statement", "line_item")) -> DataFrame:
    """One column a year; of years that repeat the last label wins; TTM counts as the year after the last."""
    last = F.max(period_year(F.col("period"))).over(Window.partitionBy("ticker", "statement"))
    dated = facts.withColumn("_y", F.when(F.col("period") == "TTM", last + 1).otherwise(period_year(F.col("period"))))
    return dated.where("_y is not null").groupBy(*keys).pivot("_y", years).agg(F.max_by("value", "period"))


def recent_years(facts: DataFrame, n: int) -> DataFrame:
    """The latest n period years of every ticker and statement."""
    w = Window.partitionBy("ticker", "statement").orderBy(F.desc("period_year"))
    return facts.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= n).drop("_k")


def drop_zero_rows(facts: DataFrame, pattern: str = "(?i)opm") -> DataFrame:
    """Margin rows whose figures add up to 0, nulls as 0, go."""
    total = F.sum(F.coalesce("value", F.lit(0.0)).cast("decimal(30,6)")).over(Window.partitionBy("ticker", "statement", "line_item"))
    return facts.withColumn("_t", total).where(~(F.col("line_item").rlike(pattern) & (F.col("_t") == 0))).drop("_t")


def metric_series(facts: DataFrame) -> DataFrame:
    """One map of period to value for each line item."""
    entries = F.array_sort(F.collect_list(F.struct("period_year", "period", "value")))
    return facts.groupBy("ticker", "statement", "line_item").agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["period"], x["value"]))).alias("series"))


def lookup_metric(facts: DataFrame, aliases: dict[str, list[str]], policy: str = "fget") -> DataFrame:
    """Facts whose line item was found for a metric by its aliases, with a metric column.

    fget: alias by alias; the same words first, then a label that holds the alias or is held by it.
    fuzzy: the same words for any alias first, then a label that holds it.
    contained: only a label that holds the alias.
    Every row looks its own label up in the aliases, so there is no join; one window then finds the best label of
    a metric in each statement. Rows without a ticker or statement are left out.
    """
    names = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("alias_no"), F.lower(F.lit(a)).alias("alias")) for m, own in aliases.items() for k, a in enumerate(own)]
    low = F.col("_low")

    def near(x: Column) -> Column:
        holds = low.contains(x["alias"])
        return holds | x["alias"].contains(low) if policy == "fget" else holds

    def ranked(x: Column) -> Column:
        tier = F.when((low == x["alias"]) & F.lit(policy != "contained"), 0).otherwise(1)
        first, second = (x["alias_no"], tier) if policy == "fget" else (tier, x["alias_no"])
        return F.struct(x["metric"].alias("metric"), x["alias_no"].alias("alias_no"), F.struct(first.alias("a"), second.alias("b")).alias("_rank"))

    rows = facts.where("ticker is not null and statement is not null").withColumn("_low", F.lower(clean_label("line_item", "lookup")))
    found = rows.select(*facts.columns, F.inline(F.transform(F.filter(F.array(*names), near), ranked)))
    own = F.struct("_rank", "line_no", "line_item")
    best = F.min(own).over(Window.partitionBy("ticker", "statement", "metric"))
    kept = found.withColumn("_best", best).where((F.col("_best._rank") == F.col("_rank")) & (F.col("_best.line_item") == F.col("line_item")))
    return kept.drop("_rank", "_best")


def latest_metric(facts: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The last numeric cell of the first row whose label holds any alias."""
    found = lookup_metric(facts.where("value is not null"), aliases, "contained")
    return found.groupBy("ticker", "metric").agg(F.max_by("value", F.struct("period_year", "period")).alias("value"))


def tiered_lookup(df: DataFrame, column: str, entries: list[tuple[str, str, list[str]]], cutoff: float = 0.6, default: str | None = None) -> DataFrame:
    """Name to category: the same name, then an alias, then the nearest name by edit distance, else the default.

    entries: (category, name, aliases), a table of the caller's, broadcast.
    """
    spark = df.sparkSession
    rows = [(c, n.lower(), i, 0) for i, (c, n, _) in enumerate(entries)] + [(c, a.lower(), i, 1) for i, (c, _, names) in enumerate(entries) for a in names]
    table = F.broadcast(spark.createDataFrame(rows, "category string, _n string, _i int, _t int"))
    keys = df.select(F.col(column).alias("_key")).distinct()
    low = F.lower(F.trim("_key"))
    like = 1 - F.levenshtein(low, F.col("_n")) / F.greatest(F.length(low), F.length("_n"), F.lit(1))
    pairs = keys.join(table, (low == F.col("_n")) | ((F.col("_t") == 0) & (like >= cutoff)))
    tier = F.when(low == F.col("_n"), F.col("_t")).otherwise(2)
    w = Window.partitionBy("_key").orderBy(tier, F.desc(like), "_i")
    best = pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("_key", "category", tier.alias("tier"))
    out = df.join(best, F.col(column).eqNullSafe(F.col("_key")), "left").drop("_key")
    return out.withColumns({"category": F.coalesce("category", F.lit(default)), "tier": F.coalesce("tier", F.lit(3))})


def active_rules(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose agent, sector and signal all match or are null; numbered by priority, then as inserted.

    Rules that name an agent are joined by it, others by their signal; only rules with neither meet every entity,
    and Spark broadcasts them if they are small.
    """
    e, s = F.lower("sector"), F.lower("rule_sector")
    ok = (F.col("rule_agent").isNull() | (F.col("rule_agent") == F.col("agent"))) & (F.col("rule_sector").isNull() | e.contains(s) | s.contains(e)) & (F.col("rule_signal").isNull() | (F.col("rule_signal") == F.col("signal")))
    w = Window.partitionBy("entity").orderBy(F.desc("priority"), "rule_no")
    agent, signal = F.col("rule_agent").isNotNull(), F.col("rule_signal").isNotNull()
    parts = [(agent, (F.col("agent") == F.col("rule_agent")) & ok), (~agent & signal, (F.col("signal") == F.col("rule_signal")) & ok), (~agent & ~signal, ok)]
    hits = reduce(DataFrame.union, [entities.join(rules.where(own), on).select("entity", "priority", "rule_no") for own, on in parts])
    return hits.select("entity", "rule_no", F.row_number().over(w).alias("place"))


def list_available(facts: DataFrame) -> DataFrame:
    """Years and distinct line items of every statement, sorted."""
    return facts.groupBy("ticker", "statement").agg(F.sort_array(F.collect_set("period_year")).alias("years"), F.sort_array(F.collect_set("line_item")).alias("line_items"))


def get_metric(facts: DataFrame, item: str, statement: str) -> DataFrame:
    """All periods of one tolerantly found line item; nulls are left out."""
    return lookup_metric(facts.where(F.col("statement") == statement), {item: [item]}, "fuzzy").where("value is not null").select("ticker", "line_item", "period", "value")


def series_last_n(facts: DataFrame, prefixes: dict[str, tuple[str, ...]], n: int) -> DataFrame:
    """Chart series: the first row whose label starts with a prefix, its last n periods under short labels."""
    parts = []
    for metric, names in prefixes.items():
        rank = reduce(lambda acc, kv: acc.when(F.col("line_item").startswith(kv[1]), kv[0]), list(enumerate(names)), F.when(F.lit(False), 0))
        w = Window.partitionBy("ticker").orderBy("_rank", "line_no")
        hit = facts.withColumn("_rank", rank).where("_rank is not null").withColumn("_k", F.dense_rank().over(w)).where("_k = 1")
        parts.append(hit.select("ticker", F.lit(metric).alias("metric"), "period", "period_year", "value"))
    every = reduce(DataFrame.unionByName, parts)
    last = Window.partitionBy("ticker", "metric").orderBy(F.desc("period_year"))
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace("period", "^Mar ", "FY"), "^Dec ", "Q3 "), "^Sep ", "Q2 ")
    return every.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= n).select("ticker", "metric", short.alias("label"), "period_year", "value")


def fcf_series(wide: DataFrame, n: int = 6) -> DataFrame:
    """Operating cash flow less what was invested; null if either is null, and where capex is 0."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period_year"))
    fcf = F.col("ocf") - F.nullif(F.abs("capex"), F.lit(0.0))
    return wide.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select("ticker", "period_year", fcf.alias("fcf"))


def export_json(facts: DataFrame) -> DataFrame:
    """One JSON object a ticker: source, statements, periods, line items; a mark where there is nothing."""
    items = facts.groupBy("ticker", "statement", "period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("line_item", "value")))).alias("items"))
    periods = items.groupBy("ticker", "statement").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("period", F.to_json("items").alias("j"))))).alias("periods"))
    body = periods.groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("statement", F.to_json("periods").alias("p"))))).alias("statements"))
    return body.select("ticker", F.coalesce(F.to_json(F.struct(F.lit("facts").alias("source"), "statements")), F.lit(NOT_AVAILABLE)).alias("json"))


def calendar_filers(facts: DataFrame) -> DataFrame:
    """Tickers more than half of whose annual columns end in December."""
    periods = facts.select("ticker", "period").distinct()
    share = F.avg((month_number(F.substring("period", 1, 3)) == 12).cast("double"))
    return periods.groupBy("ticker").agg((share > 0.5).alias("calendar_filer"))
