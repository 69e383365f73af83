"""Input tables, and the relations that stand for statements, prices, chunks and ledgers.

Each relation is one SQL text that Spark and DuckDB both run on the given tables, so that a query and
its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _union(rows: list[tuple[str, int, str, str]], source: str) -> str:
    return " union all ".join(f"select k, fy, '{st}' st, {ln} ln, '{item}' item, {v} v from {source}" for st, ln, item, v in rows)


_FACT_ROWS = [
    ("profit_loss", 1, "Sales", "sales"),
    ("profit_loss", 2, "Cost of Materials", "cogs"),
    ("profit_loss", 3, "Operating Profit", "op"),
    ("profit_loss", 4, "Other Income", "oi"),
    ("profit_loss", 5, "Interest", "intr"),
    ("profit_loss", 6, "Depreciation", "dep"),
    ("profit_loss", 7, "Profit before tax", "pbt"),
    ("profit_loss", 8, "Net Profit", "pat"),
    ("profit_loss", 9, "EPS in Rs", "pat / 1000e0"),
    ("balance_sheet", 1, "Total Assets", "sales * 1.4e0"),
    ("balance_sheet", 2, "Equity Capital", "1000e0"),
    ("balance_sheet", 3, "Reserves", "sales * 0.5e0 + pat"),
    ("balance_sheet", 4, "Borrowings", "intr * 12e0"),
    ("balance_sheet", 5, "Inventories", "inv"),
    ("balance_sheet", 6, "Trade Receivables", "rec"),
    ("balance_sheet", 7, "Trade Payables", "pay"),
    ("balance_sheet", 8, "Cash Equivalents", "oi * 2e0"),
    ("cash_flow", 1, "Cash from Operating Activity", "pat + dep - rec * 0.2e0"),
    ("cash_flow", 2, "Capital Expenditure", "-0.06e0 * sales"),
]

_FACT_BASE = """with b as (
  select l_suppkey k, year(l_shipdate) + case when month(l_shipdate) >= 4 then 1 else 0 end fy,
         cast(l_extendedprice as decimal(12,2)) p, cast(l_discount as decimal(4,2)) d,
         cast(l_tax as decimal(4,2)) t, cast(l_quantity as decimal(6,0)) q, l_returnflag rf, l_linestatus ls
  from lineitem),
a as (
  select k, fy, cast(sum(p) as double) sales, cast(sum(p * (0.30 - 2 * d)) as double) op,
         cast(sum(case when rf = 'R' then p * t else 0 end) as double) oi,
         case when k % 7 = 0 then 0.0e0 else cast(sum(case when ls = 'O' then p * t else 0 end) as double) end intr,
         cast(sum(p) as double) * 0.04e0 dep, cast(sum(p * (0.5 + 2 * d)) as double) cogs,
         case when k % 5 = 0 then null else cast(sum(q) as double) * 10e0 end inv,
         cast(sum(case when rf = 'N' then p else 0 end) as double) * 0.1e0 rec,
         cast(sum(case when ls = 'F' then p else 0 end) as double) * 0.05e0 pay
  from b group by k, fy),
w as (select a.*, op + oi - intr - dep pbt, (op + oi - intr - dep) * 0.75e0 pat from a)"""
_FACT_COLUMNS = """concat('S', cast(k as string)) ticker, st statement, ln line_no, item line_item,
       case when k % 10 = 3 then concat('Dec ', cast(fy - 1 as string)) else concat('Mar ', cast(fy as string)) end period,
       fy period_year, v value"""
FACTS = f"{_FACT_BASE}, u as ({_union(_FACT_ROWS, 'w')}) select {_FACT_COLUMNS} from u"
#: The same rows in Spark, where an array of rows is read off one aggregation instead of one for each line.
_FACTS_SPARK = f"{_FACT_BASE}, u as (select k, fy, inline(array({', '.join(f'struct({chr(39)}{st}{chr(39)} as st, {ln} as ln, {chr(39)}{item}{chr(39)} as item, cast({v} as double) as v)' for st, ln, item, v in _FACT_ROWS)})) from w) select {_FACT_COLUMNS} from u"

_QUARTER_BASE = """with b as (
  select l_suppkey k, year(l_shipdate) y, quarter(l_shipdate) q, cast(l_extendedprice as decimal(12,2)) p,
         cast(l_discount as decimal(4,2)) d, cast(l_tax as decimal(4,2)) t, l_returnflag rf
  from lineitem),
a as (
  select k, y, q, cast(sum(p) as double) sales, cast(sum(p * (0.30 - 2 * d)) as double) op,
         cast(sum(case when rf = 'R' then p * t else 0 end) as double) oi
  from b group by k, y, q)"""
_QUARTER_ROWS = {"Sales": "sales", "Operating Profit": "op", "Other Income": "oi", "Profit before tax": "op + oi", "Net Profit": "(op + oi) * 0.75e0"}
_QUARTER_COLUMNS = """concat('S', cast(k as string)) ticker, 'quarterly_results' statement, item line_item,
       concat(case q when 1 then 'Mar ' when 2 then 'Jun ' when 3 then 'Sep ' else 'Dec ' end, cast(y as string)) period,
       y * 4 + q period_no, v value"""
QUARTERS = f"{_QUARTER_BASE}, u as ({' union all '.join(f'select k, y, q, {chr(39)}{i}{chr(39)} item, {v} v from a' for i, v in _QUARTER_ROWS.items())}) select {_QUARTER_COLUMNS} from u"
_QUARTERS_SPARK = f"{_QUARTER_BASE}, u as (select k, y, q, inline(array({', '.join(f'struct({chr(39)}{i}{chr(39)} as item, {v} as v)' for i, v in _QUARTER_ROWS.items())})) from a) select {_QUARTER_COLUMNS} from u"

PRICES = """
select concat('S', cast(l_suppkey as string)) ticker, cast(date_trunc('week', l_shipdate) as date) dt,
       cast(sum(cast(l_extendedprice as decimal(12,2))) as double) / cast(sum(cast(l_quantity as decimal(6,0))) as double) close_px
from lineitem group by l_suppkey, cast(date_trunc('week', l_shipdate) as date)
"""

VEC = """
select vec_id, concat('T', cast(vec_id % 10 as string)) ticker,
       case label % 4 when 0 then 'annual_report' when 1 then 'concall_transcript' when 2 then 'credit_report' else 'quarterly_results' end doc_type,
       concat('FY', cast(22 + vec_id % 5 as string)) fiscal_year, concat('Q', cast(1 + vec_id % 4 as string)) fiscal_quarter,
       cast(2021 + vec_id % 5 as int) cal_year, embedding
from embeddings
"""

LEDGER = """
select event_id id, concat('E', cast(user_id % 20 as string)) ticker, event_type agent_name,
       concat('Q', cast(1 + k % 4 as string), '_FY', cast(24 + k % 3 as string)) fiscal_period,
       case k % 5 when 0 then 'margins' when 1 then 'guidance' when 2 then 'roic' when 3 then 'capex' else 'leverage' end metric_category,
       concat('claim ', cast(k as string)) original_claim,
       case when k % 6 = 0 then 'UNVERIFIABLE: none' else concat('fact ', cast(k as string)) end verified_fact,
       value / 500e0 confidence, k score, cast(ts as timestamp) run_date
from (select e.*, cast(JSON_K as int) k from events e) events_k
"""

CORPUS = """
select doc_id, source ticker, text, lang,
       concat('Q', cast(1 + doc_id % 4 as string), '_FY', cast(20 + doc_id % 7 as string), '_', source, '.pdf') file_name
from documents
"""

TALK = "select conv_id, turn, role, text from conversations"

RELATIONS = {"facts": FACTS, "quarters": QUARTERS, "prices": PRICES, "vec": VEC, "ledger": LEDGER, "corpus": CORPUS, "talk": TALK}
_JSON = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    sql = {"facts": _FACTS_SPARK, "quarters": _QUARTERS_SPARK}.get(name, RELATIONS[name]).replace("JSON_K", _JSON["spark"])
    used = [t for t in TABLES if re.search(rf"from {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"from {t}\b", f"from {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def oracle(*names: str) -> str:
    """The start of a DuckDB text: the relations as named subqueries."""
    parts = []
    for n in names:
        sql = RELATIONS[n].replace("JSON_K", _JSON["duckdb"])
        if n == "ledger":
            sql = sql.replace("cast(ts as timestamp)", "ts")
        parts.append(f"{n} as ({sql})")
    return "with recursive " + ",\n".join(parts)
