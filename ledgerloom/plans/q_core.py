"""Registered queries of normalisation, the fiscal calendar and quant analytics, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import exprs, fiscal, labels
from ledgerloom.operators import normalize as N
from ledgerloom.operators import quant as Q
from ledgerloom.plans.registry import query
from ledgerloom.plans.tables import QUARTERS, oracle, relation, table


def R(x: str, n: int) -> str:
    """The rounding of exprs.r in DuckDB."""
    return f"cast(round(round(cast({x} as decimal(30,12)), {n + 5}), {n}) as double)"


_COLS = {
    "sales": "Sales", "ebit": "Operating Profit", "pat": "Net Profit", "other_income": "Other Income", "interest": "Interest", "depreciation": "Depreciation",
    "pbt": "Profit before tax", "cogs": "Cost of Materials", "eps": "EPS in Rs", "assets": "Total Assets", "capital": "Equity Capital", "reserves": "Reserves",
    "debt": "Borrowings", "cash": "Cash Equivalents", "inventory": "Inventories", "receivables": "Trade Receivables", "payables": "Trade Payables",
    "ocf": "Cash from Operating Activity", "capex": "Capital Expenditure",
}
_MAX = ", ".join(f"max(case when line_item = '{v}' then value end) {k}" for k, v in _COLS.items())
WIDE = oracle("facts") + f""",
wide0 as (select ticker, period_year, {_MAX} from facts group by 1, 2),
wide as (select *, coalesce(capital, 0) + coalesce(reserves, 0) equity, coalesce(ebit, 0) + coalesce(depreciation, 0) ebitda from wide0),
latest as (select * from wide qualify row_number() over (partition by ticker order by period_year desc) = 1)
"""  # fmt: skip


def SAFE(a: str, b: str, n: int = 4) -> str:
    return R(f"({a}) / nullif({b}, 0)", n)


facts = lambda s, d: relation(s, d, "facts")
quarters = lambda s, d: relation(s, d, "quarters")

# --- normalisation ---------------------------------------------------------------------------------

_RAW = """raw as (select p_partkey id, case p_partkey % 8 when 0 then ' 14,' || p_partkey || ' ' when 1 then p_partkey || '%' when 2 then '-' when 3 then 'nan'
  when 4 then p_partkey || '.5x' when 5 then '₹' || p_partkey when 6 then '' else 'abc' end cell,
  case p_partkey % 3 when 0 then ' Sales +' when 1 then 'Net Profit++' else 'OPM  %' end label from part)"""


def _raw(s, d):
    return s.sql("with " + _RAW.replace("from part", "from {part}") + " select * from raw", part=table(s, d, "part"))


@query("n1_clean_label", "with " + r"""
""" + _RAW + r""" select id, trim(regexp_replace(trim(label), '\+$', '')) stmt, trim(regexp_replace(trim(label), '\++$', '')) lookup,
 trim(regexp_replace(regexp_replace(trim(label), '\s+%', '%'), '\++$', '')) archive from raw""")
def n1(s, d):
    """Labels cleaned by three rules."""
    return _raw(s, d).select("id", exprs.clean_label("label").alias("stmt"), exprs.clean_label("label", "lookup").alias("lookup"), exprs.clean_label("label", "archive").alias("archive"))


@query("n2_to_number", "with " + _RAW + r""", c as (select id, trim(regexp_replace(cell, '[,%x₹ ]', '', 'g')) a, trim(regexp_replace(cell, '[,%₹ ]', '', 'g')) b from raw)
 select id, case when a in ('', '-', 'nan') then null else try_cast(a as double) end stmt, case when b in ('', '-', 'nan') then null else try_cast(b as double) end quarterly,
 coalesce(case when a in ('', '-', 'nan') then null else try_cast(a as double) end, 0) archive from c""")
def n2(s, d):
    """Figures from cells by three rules."""
    return _raw(s, d).select("id", exprs.to_number("cell").alias("stmt"), exprs.to_number("cell", "quarterly").alias("quarterly"), exprs.to_number("cell", "archive").alias("archive"))


def _statements(s, d):
    """Facts as raw statements with a map of cells, to be unpivoted again."""
    titles = F.create_map(*[F.lit(x) for k, v in N.STATEMENTS.items() for x in (v, k)])
    rows = facts(s, d).withColumn("statement", F.element_at(titles, F.col("statement")))
    cells = F.map_from_entries(F.collect_list(F.struct("period", F.coalesce(F.col("value").cast("string"), F.lit("-")))))
    return rows.groupBy("ticker", "statement", F.col("line_no").cast("int").alias("row_no"), F.concat("line_item", F.lit(" +")).alias("label")).agg(F.map_concat(cells, F.create_map(F.lit("TTM"), F.lit("1"))).alias("cells"))


@query("n3_unpivot", oracle("facts") + f" select ticker, statement, line_no, line_item, period, cast(period_year + case when period like 'Dec%' then -1 else 0 end as int) period_year, value from facts")
def n3(s, d):
    """Raw statements to facts and back; TTM columns drop out."""
    return N.unpivot_statements(_statements(s, d))


@query("n4_statement_keys", "select n_name, case n_nationkey % 4 when 0 then 'profit_loss' when 1 then 'cash_flow' when 2 then replace(lower(n_name), ' ', '_') || '_and_x' else 'peers' end as k from nation")
def n4(s, d):
    """Canonical statement names."""
    title = F.when(F.col("n_nationkey") % 4 == 0, "Profit & Loss").when(F.col("n_nationkey") % 4 == 1, "Cash Flows").when(F.col("n_nationkey") % 4 == 2, F.concat("n_name", F.lit(" & X"))).otherwise("Peer Comparison")
    return table(s, d, "nation").select("n_name", N.canonical_statement(title).alias("k"))


@query("n5_clean_peers", """select concat('N', s_nationkey) ticker, s_name as name, m.metric as metric, case when m.metric = 'CMP' then s_acctbal end num, case when m.metric = 'Tag' then 'tag ' || s_suppkey end as text
 from supplier, (values ('CMP'), ('Tag')) m(metric)""")
def n5(s, d):
    """Peers in long form with numbers where they can be read."""
    cells = F.create_map(F.lit("S.No."), F.col("s_suppkey").cast("string"), F.lit("Name"), F.col("s_name"), F.lit("CMP"), F.col("s_acctbal").cast("string"), F.lit("Tag"), F.concat(F.lit("tag "), F.col("s_suppkey").cast("string")))
    return N.clean_peers(table(s, d, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"), cells.alias("cells")))


@query("n6_compare_to_peers", """with m as (select s_nationkey g, median(s_acctbal) pm, count(*) n from supplier where s_nationkey % 6 <> 0 group by 1)
 select concat('S', s_suppkey) ticker, s_nationkey peer_group, s_acctbal as value, pm peer_median, coalesce(n, 0) n_peers, case when n is null then 'DATA NOT AVAILABLE' else 'OK' end status from supplier left join m on g = s_nationkey""")
def n6(s, d):
    """Balances against the median of the nation's suppliers."""
    v = table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_nationkey").alias("peer_group"), F.col("s_acctbal").alias("value"))
    return N.compare_to_peers(v, v.where("peer_group % 6 <> 0"))


@query("n7_compact_statement", oracle("facts") + """ select ticker, statement, line_item, """ + ", ".join(f"max(case when period_year = {y} then value end) as \"{y}\"" for y in range(1997, 2002)) + " from (select * exclude (period_year), cast(right(period, 4) as int) period_year from facts) where period_year between 1997 and 2001 group by 1, 2, 3")
def n7(s, d):
    """Statements with one column a year."""
    f = facts(s, d)
    years = list(range(1997, 2002))
    return N.compact_statement(f.where(N.period_year(F.col("period")).isin(years)), years)


@query("n8_drop_zero_rows", oracle("facts") + """, t as (select *, sum(cast(coalesce(value, 0) as decimal(30,6))) over (partition by ticker, statement, line_item) t from facts)
 select ticker, line_item, period_year, value from t where not (regexp_matches(line_item, 'Interest|Borrowings') and t = 0)""")
def n8(s, d):
    """Rows whose figures add up to nothing drop out."""
    return N.drop_zero_rows(facts(s, d), "Interest|Borrowings").select("ticker", "line_item", "period_year", "value")


@query("n9_metric_series", oracle("facts") + " select ticker, statement, line_item, string_agg(period, ',' order by period_year) periods, count(*) n from facts group by 1, 2, 3")
def n9(s, d):
    """Periods of each line item in order."""
    m = N.metric_series(facts(s, d))
    return m.select("ticker", "statement", "line_item", F.array_join(F.map_keys("series"), ",").alias("periods"), F.size("series").cast("long").alias("n"))


@query("n10_lookup_metric", oracle("facts") + """, a(metric, alias_no, alias) as (values ('rev', 0, 'net sales'), ('rev', 1, 'sales'), ('profit', 0, 'profit'), ('cash', 0, 'cash')),
 l as (select ticker, statement, line_item, min(line_no) line_no from facts group by 1, 2, 3),
 c as (select *, case when lower(line_item) = alias then 0 else 1 end tier from l join a on contains(lower(line_item), alias) or contains(alias, lower(line_item))),
 b as (select * from c qualify row_number() over (partition by ticker, statement, metric order by alias_no, tier, line_no, line_item) = 1)
 select f.ticker, f.statement, b.metric, b.line_item, b.alias_no, f.period_year, f.value from facts f join b using (ticker, statement, line_item)""")
def n10(s, d):
    """Line items found by aliases, all periods."""
    out = N.lookup_metric(facts(s, d), {"rev": ["net sales", "sales"], "profit": ["profit"], "cash": ["cash"]})
    return out.select("ticker", "statement", "metric", "line_item", "alias_no", "period_year", "value")


@query("n11_latest_metric", oracle("facts") + """, v as (select * from facts where value is not null and statement = 'balance_sheet' and line_item in ('Inventories', 'Borrowings'))
 select ticker, case line_item when 'Borrowings' then 'debt' else 'stock' end metric, max_by(value, period_year) as value from v group by 1, 2""")
def n11(s, d):
    """The last figure of items found by a part of their label."""
    return N.latest_metric(facts(s, d).where("statement = 'balance_sheet'"), {"debt": ["Borrow"], "stock": ["Inventor"]})


@query("n12_tiered_lookup", "select n_name, case when n_name = 'NATION_1' then 'one' when n_name = 'NATION_2' then 'two' when levenshtein(lower(n_name), 'nation_1') <= 3 then 'one' else 'any' end category, case when n_name = 'NATION_1' then 0 when n_name = 'NATION_2' then 1 when levenshtein(lower(n_name), 'nation_1') <= 3 then 2 else 3 end tier from nation")
def n12(s, d):
    """Names to categories by tiers."""
    return N.tiered_lookup(table(s, d, "nation").select("n_name"), "n_name", [("one", "NATION_1", []), ("two", "zzzzzzzzzzzzzzzz", ["NATION_2"])], 0.6, "any").select("n_name", "category", "tier")


def _first(text: str, rules: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when contains(lower({text}), '{k}') then '{v}'" for k, v in rules) + f" else '{default}' end"


@query("n13_first_match", f"select doc_id, {_first("coalesce(text, '')", labels.METRIC_RULES, 'uncategorized')} metric_category, {_first("coalesce(source, '') || ' ' || coalesce(text, '')", labels.VERTICALS, 'other')} vertical from documents")
def n13(s, d):
    """The first keyword that a text holds decides its metric and its vertical."""
    both = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", labels.metric_category("text").alias("metric_category"), labels.vertical(both).alias("vertical"))


_RULE_ROWS = "(1, 'Buil', null, null, 5), (2, null, 1, null, 9), (3, null, null, 2, 5), (4, null, null, null, 1)"


@query("n14_active_rules", f"""with r(rule_no, seg, n, m, priority) as (values {_RULE_ROWS})
 select c_custkey entity, rule_no, row_number() over (partition by c_custkey order by priority desc, rule_no) place from customer, r
 where (seg is null or contains(lower(c_mktsegment), lower(seg)) or contains(lower(seg), lower(c_mktsegment))) and (n is null or n = c_nationkey % 3) and (m is null or m = c_custkey % 4)""")
def n14(s, d):
    """Rules that match a customer, by priority."""
    e = table(s, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"), (F.col("c_nationkey") % 3).cast("int").alias("agent"), (F.col("c_custkey") % 4).cast("int").alias("signal"))
    rules = s.createDataFrame([(1, "Buil", None, None, 5), (2, None, 1, None, 9), (3, None, None, 2, 5), (4, None, None, None, 1)], "rule_no int, rule_sector string, rule_agent int, rule_signal int, priority int")
    return N.active_rules(e, rules)


@query("n15_list_available", oracle("facts") + " select ticker, statement, list_sort(list(distinct period_year)) as \"years\", list_sort(list(distinct line_item)) line_items from facts group by 1, 2")
def n15(s, d):
    """Years and line items of every statement."""
    return N.list_available(facts(s, d))


@query("n16_get_metric", oracle("facts") + " select ticker, line_item, period, value from facts where statement = 'profit_loss' and line_item = 'Net Profit' and value is not null")
def n16(s, d):
    """All periods of one item."""
    return N.get_metric(facts(s, d), "net profit", "profit_loss")


@query("n17_chart_series", oracle("facts") + """, h as (select ticker, case line_item when 'Sales' then 'revenue' else 'pat' end metric, period, period_year, value from facts where line_item in ('Sales', 'Net Profit'))
 select ticker, metric, replace(replace(replace(period, 'Mar ', 'FY'), 'Dec ', 'Q3 '), 'Sep ', 'Q2 ') as label, period_year, value from h qualify row_number() over (partition by ticker, metric order by period_year desc) <= 4""")
def n17(s, d):
    """The last periods of chart series."""
    return N.series_last_n(facts(s, d), {"revenue": ("Revenue", "Sales"), "pat": ("Net Profit",)}, 4)


@query("n18_fcf_series", WIDE + " select ticker, period_year, ocf - nullif(abs(capex), 0) fcf from wide qualify row_number() over (partition by ticker order by period_year desc) <= 6")
def n18(s, d):
    """Free cash flow of the last years."""
    return N.fcf_series(Q.wide(facts(s, d)))


@query("n19_export_json", oracle("facts") + " select ticker, count(distinct statement) n_statements from facts group by 1")
def n19(s, d):
    """JSON of each ticker, parsed back."""
    j = N.export_json(facts(s, d))
    return j.select("ticker", F.size(F.json_object_keys(F.get_json_object("json", "$.statements"))).cast("long").alias("n_statements"))


# --- fiscal calendar -------------------------------------------------------------------------------


@query("f1_fiscal_period", """with o as (select o_orderkey k, cast(o_orderdate as date) d from orders), f as (select *, d - interval 3 month e from o)
 select k, 'FY' || lpad(cast((year(e) + 1) % 100 as varchar), 2, '0') as annual, 'Q' || quarter(e) || '_FY' || lpad(cast((year(e) + 1) % 100 as varchar), 2, '0') as quarterly from f""")
def f1(s, d):
    """Fiscal labels of order dates."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), fiscal.fiscal_period("o_orderdate", True).alias("annual"), fiscal.fiscal_period("o_orderdate", False).alias("quarterly"))


@query("f2_calendar_period", "select o_orderkey k, 'CY' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') as annual, 'Q' || quarter(o_orderdate) || '_CY' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') as quarterly from orders")
def f2(s, d):
    """Calendar labels of order dates."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), fiscal.calendar_period("o_orderdate", True).alias("annual"), fiscal.calendar_period("o_orderdate", False).alias("quarterly"))


@query("f3_calendar_filers", oracle("facts") + " select ticker, avg(case when period like 'Dec%' then 1.0 else 0 end) > 0.5 calendar_filer from (select distinct ticker, period from facts) group by 1")
def f3(s, d):
    """Tickers whose years end in December."""
    return N.calendar_filers(facts(s, d))


@query("f4_infer_period", oracle("facts", "quarters") + """, a as (select ticker, max_by(period, period_year) p from facts group by 1), q as (select ticker, max_by(period, period_no) p, max(period_no) no from quarters group by 1),
 dec as (select ticker, avg(case when period like 'Dec%' then 1.0 else 0 end) > 0.5 cal from (select distinct ticker, period from facts) group by 1),
 j as (select a.ticker, coalesce(q.p, a.p) p, q.p is not null isq, cal from a left join q on q.ticker = a.ticker and q.no % 2 = 0 join dec on dec.ticker = a.ticker),
 m as (select *, case left(p, 3) when 'Mar' then 3 when 'Jun' then 6 when 'Sep' then 9 else 12 end mo, cast(right(p, 4) as int) y from j)
 select ticker, case when isq and cal then 'Q' || cast(mo / 3 as int) || '_CY' || lpad(cast(y % 100 as varchar), 2, '0') when cal then 'CY' || lpad(cast(y % 100 as varchar), 2, '0')
   when isq then 'Q' || cast(((mo + 8) % 12) // 3 + 1 as int) || '_FY' || lpad(cast((y + case when mo >= 4 then 1 else 0 end) % 100 as varchar), 2, '0') else 'FY' || lpad(cast((y + case when mo >= 4 then 1 else 0 end) % 100 as varchar), 2, '0') end as active from m""")
def f4(s, d):
    """The active period: the latest quarter if it is known, else the latest year; labelled by the kind of filer."""
    f, q = facts(s, d), quarters(s, d)
    a = f.groupBy("ticker").agg(F.max_by("period", "period_year").alias("a"))
    b = q.groupBy("ticker").agg(F.max_by("period", "period_no").alias("b"), F.max("period_no").alias("no")).where("no % 2 = 0")
    rows = a.join(b, "ticker", "left").join(N.calendar_filers(f), "ticker", "left")
    label = F.coalesce("b", "a")
    date = F.make_date(N.period_year(label), fiscal.month_number(label), F.lit(1))
    quarterly = F.col("b").isNotNull()
    out = F.when(quarterly & F.col("calendar_filer"), fiscal.calendar_period(date, False)).when(F.col("calendar_filer"), fiscal.calendar_period(date, True)).when(quarterly, fiscal.fiscal_period(date, False)).otherwise(fiscal.fiscal_period(date, True))
    return rows.select("ticker", out.alias("active"))


@query("f5_fiscal_window", """with o as (select o_orderkey k, year(o_orderdate) % 100 y from orders), p as (select k, case k % 3 when 0 then 'Q3_FY' || lpad(cast(y as varchar), 2, '0') when 1 then 'CY' || lpad(cast(y as varchar), 2, '0') else 'none' end p, y from o)
 select k, case k % 3 when 0 then list_transform([y, y - 1], lambda v: 'FY' || lpad(cast((v + 100) % 100 as varchar), 2, '0')) when 1 then list_transform([y + 1, y, y - 1], lambda v: 'FY' || lpad(cast((v + 100) % 100 as varchar), 2, '0')) end as years from p""")
def f5(s, d):
    """Recent fiscal years of period labels."""
    y = F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    p = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Q3_FY"), y)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("CY"), y)).otherwise("none")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), fiscal.fiscal_window(p).alias("years"))


@query("f6_fiscal_years_spanned", """with o as (select o_orderkey k, cast(o_orderdate as date) a, cast(o_orderdate as date) + cast(o_orderkey % 1200 as int) b from orders),
 f as (select k, year(a - interval 3 month) + 1 x, year(b - interval 3 month) + 1 y from o) select k, list_transform(range(x, y + 1), lambda v: 'FY' || lpad(cast(v % 100 as varchar), 2, '0')) as years from f""")
def f6(s, d):
    """Fiscal years from an order date to a later one."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("a"))
    return o.select("k", fiscal.fiscal_years_spanned("a", F.date_add("a", (F.col("k") % 1200).cast("int"))).alias("years"))


_LOOSE = """l as (select o_orderkey k, case o_orderkey % 6 when 0 then 'FY' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') when 1 then 'Q' || (1 + o_orderkey % 4) || ' FY' || year(o_orderdate)
 when 2 then 'Dec-20' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') when 3 then 'the year 20' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') when 4 then 'N/A' else 'April 2003' end t, year(o_orderdate) y from orders)"""


def _loose(s, d):
    return s.sql("with " + _LOOSE.replace("from orders", "from {orders}").replace("as varchar", "as string") + " select * from l", orders=table(s, d, "orders"))


@query("f7_financial_yyyymm", "with " + _LOOSE + """ select k, cast(case k % 6 when 0 then (2000 + y % 100) * 100 + 3 when 1 then case 1 + k % 4 when 1 then (y - 1) * 100 + 6 when 2 then (y - 1) * 100 + 9 when 3 then (y - 1) * 100 + 12 else y * 100 + 3 end
 when 2 then (2000 + y % 100) * 100 + 12 when 3 then (2000 + y % 100) * 100 + 12 when 4 then 0 else 200304 end as int) m from l""")
def f7(s, d):
    """Sortable months from loose dates."""
    return _loose(s, d).select("k", fiscal.financial_yyyymm("t").alias("m"))


@query("f8_chronology", "with " + _LOOSE + """, m as (select k, cast(case k % 6 when 0 then (2000 + y % 100) * 100 + 3 when 1 then case 1 + k % 4 when 1 then (y - 1) * 100 + 6 when 2 then (y - 1) * 100 + 9 when 3 then (y - 1) * 100 + 12 else y * 100 + 3 end
 when 2 then (2000 + y % 100) * 100 + 12 when 3 then (2000 + y % 100) * 100 + 12 when 4 then 0 else 200304 end as int) m from l) select k, m = 0 or m <= 200103 as ok from m""")
def f8(s, d):
    """Whether a cause is no later than FY2001's end."""
    return _loose(s, d).select("k", fiscal.chronology_ok("t", F.lit("FY2001")).alias("ok"))


@query("f9_stamp_period", oracle("corpus") + """ select doc_id, 'FY' || cast(20 + doc_id % 7 as varchar) fiscal_year, 'Q' || (1 + doc_id % 4) fiscal_quarter, 'Q' || (1 + doc_id % 4) || '_FY' || (20 + doc_id % 7) fiscal_period,
 cast(case when 1 + doc_id % 4 = 4 then 2020 + doc_id % 7 else 2019 + doc_id % 7 end as int) calendar_year, 'filename_q_fy' rule_name from corpus where not regexp_matches(lower(coalesce(text, '')), 'ended')""")
def f9(s, d):
    """Periods of documents from their names; texts that speak of an ended period are left to the tests."""
    p = relation(s, d, "corpus").where("not coalesce(lower(text), '') rlike 'ended'").select("doc_id", fiscal.stamp_period("file_name", "text").alias("p"))
    return p.select("doc_id", "p.fiscal_year", "p.fiscal_quarter", "p.fiscal_period", "p.calendar_year", F.col("p.rule").alias("rule_name"))


@query("f10_fy_to_column", "select o_orderkey k, 'Mar 20' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') as c from orders")
def f10(s, d):
    """Column labels of fiscal years."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), fiscal.fy_to_column(F.concat(F.lit("FY"), F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"))).alias("c"))


@query("f11_quarter_order", oracle("quarters") + " select ticker, string_agg(period, ',' order by period_no) periods from (select distinct ticker, period, period_no from quarters) group by 1")
def f11(s, d):
    """Quarters in the order of their labels' dates."""
    q = quarters(s, d).select("ticker", "period").distinct()
    return q.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(fiscal.quarter_key("period"))), lambda x: x["label"]), ",").alias("periods"))


@query("f12_missing_quarters", """with q as (select unnest(range(date '1994-01-01', date '2002-01-01', interval 3 month)) qs), c as (select distinct c_nationkey n from customer),
 o as (select distinct c_nationkey n, date_trunc('quarter', cast(o_orderdate as date)) qs from orders join customer on o_custkey = c_custkey)
 select c.n, cast(q.qs as date) quarter_start from c, q where not exists (select 1 from o where o.n = c.n and o.qs = q.qs)""")
def f12(s, d):
    """Quarters in which a nation has no order."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter_start")).distinct()
    calendar = table(s, d, "customer").select(F.col("c_nationkey").alias("n")).distinct().withColumn("quarter_start", F.explode(F.expr("sequence(date'1994-01-01', date'2001-10-01', interval 3 months)")))
    return calendar.join(o, ["n", "quarter_start"], "left_anti")


_DATED = """l as (select o_orderkey k, cast(o_orderdate as date) d, case o_orderkey % 4 when 0 then 'on ' || strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%-d/%-m/%Y') when 2 then strftime(o_orderdate, '%b %Y') || ' call' else 'no date' end t from orders)"""


@query("f13_published_date", "with " + _DATED + " select k, cast(case k % 4 when 0 then d when 1 then d when 2 then last_day(d) end as date) p from l")
def f13(s, d):
    """Dates found in titles."""
    o, at = table(s, d, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.concat(F.lit("on "), F.date_format(at, "yyyy-MM-dd"))).when(k == 1, F.date_format(at, "d/M/yyyy")).when(k == 2, F.concat(F.date_format(at, "MMM yyyy"), F.lit(" call"))).otherwise("no date")
    return o.select(F.col("o_orderkey").alias("k"), fiscal.published_date(t).alias("p"))


@query("f14_fiscal_quarter", """select o_orderkey k, cast(1 + o_orderkey % 4 as int) q, cast(2000 + o_orderkey % 20 as int) fy,
 last_day(make_date(case when o_orderkey % 4 = 3 then 2000 + o_orderkey % 20 else 1999 + o_orderkey % 20 end, case o_orderkey % 4 when 3 then 3 else (o_orderkey % 4) * 3 + 6 end, 1)) as quarter_end from orders""")
def f14(s, d):
    """Fiscal quarters and their last days from labels."""
    k = F.col("o_orderkey")
    t = F.concat(F.lit("Q"), (1 + k % 4).cast("string"), F.lit(" FY"), F.lpad((k % 20).cast("string"), 2, "0"))
    p = table(s, d, "orders").select(k.alias("k"), fiscal.fiscal_quarter_of(t).alias("p"))
    return p.select("k", "p.q", "p.fy", fiscal.quarter_end(F.col("p.fy"), F.col("p.q")).alias("quarter_end"))


# --- quant -----------------------------------------------------------------------------------------

_PAIR = oracle("facts") + ", n as (select ticker, period_year, value n from facts where line_item = '{}'), p as (select ticker, period_year, value p from facts where line_item = '{}')"


@query("q1_ratio", _PAIR.format("Net Profit", "Interest") + f""", r as (select ticker, period_year, {SAFE("n", "p")} x from n full join p using (ticker, period_year))
 select ticker, period_year, case when x is null then 'DATA_NOT_AVAILABLE' when abs(x) > 3650 then 'OUT_OF_BOUNDS' else 'OK' end status, case when abs(x) <= 3650 then x end ratio, {R("case when abs(x) <= 3650 then x end * 100", 2)} pct from r""")
def q1(s, d):
    """Profit over interest, guarded."""
    return Q.compute_ratio(facts(s, d), "Net Profit", "Interest", "profit_loss")


_TWO = oracle("facts") + ", b as (select ticker, max(case when period_year = 1997 then value end) v1, max(case when period_year = 2000 then value end) v2 from facts where line_item = 'Sales' group by 1)"


@query("q2_compare_years", _TWO + f""", c as (select *, {R("(v2 - v1) / nullif(abs(v1), 0) * 100", 2)} x from b)
 select ticker, v1, v2, {R("v2 - v1", 2)} abs_change, case when abs(x) <= 365000 then x end pct_change, case when x is null then 'DATA_NOT_AVAILABLE' when abs(x) > 365000 then 'OUT_OF_BOUNDS' else 'OK' end status from c""")
def q2(s, d):
    """Sales of two years."""
    return Q.compare_years(facts(s, d), "Sales", "profit_loss", 1997, 2000)


_CHANGE = ", g as (select ticker, period_year, {0} x from (select *, lag(value) over (partition by ticker order by period_year) p from facts where line_item = '{1}'))"


@query("q3_anomaly", oracle("facts") + f""", g as (select ticker, period_year, {R("(value - p) / nullif(abs(p), 0) * 100", 1)} x from (select *, lag(value) over (partition by ticker order by period_year) p from facts where line_item = 'Net Profit'))
 select ticker, period_year, x change_pct, case when x > 0 then 'SPIKE' else 'DROP' end kind from g where abs(x) > 30 and abs(x) <= 365000""")
def q3(s, d):
    """Years of sharp rises and falls of profit."""
    return Q.detect_anomaly(facts(s, d), "Net Profit", "profit_loss")


@query("q4_divergence", _PAIR.format("Operating Profit", "Sales") + f""", x as (select ticker, period_year, {SAFE("n", "p")} x from n join p using (ticker, period_year)), e as (select ticker, min_by(x, period_year) a, max_by(x, period_year) b, count(*) c from x where abs(x) <= 3650 group by 1 having count(*) >= 2),
 z as (select ticker, a, b, {R("(b - a) / nullif(abs(a), 0) * 100", 1)} dr from e) select ticker, a first_ratio, b last_ratio, dr drift_pct, abs(dr) > 20 diverging from z""")
def q4(s, d):
    """Drift of the operating margin."""
    return Q.divergence(facts(s, d), "Operating Profit", "Sales", "profit_loss")


@query("q5_cagr", _TWO + f""", c as (select *, case when v1 > 0 and v2 > 0 then {R("(pow(v2 / v1, 1.0e0 / 3) - 1) * 100", 2)} end x from b)
 select ticker, x cagr_pct, case when v1 is null or v2 is null then 'DATA_NOT_AVAILABLE' when v1 <= 0 or v2 <= 0 then 'NOT_POSITIVE' else 'OK' end status from c""")
def q5(s, d):
    """Growth of sales a year."""
    return Q.compute_cagr(facts(s, d), "Sales", "profit_loss", 1997, 2000)


_TREND = oracle("quarters") + f""", t as (select ticker, line_item, period, period_no, value, {R("(value - lag(value) over w) / nullif(abs(lag(value) over w), 0) * 100", 2)} qoq_pct,
 {R("(value - lag(value, 4) over w) / nullif(abs(lag(value, 4) over w), 0) * 100", 2)} yoy_pct from quarters window w as (partition by ticker, line_item order by period_no))"""


@query("q6_trends", _TREND + " select * from t")
def q6(s, d):
    """Changes against the quarter before and four quarters back."""
    return Q.quarterly_trends(quarters(s, d))


_VERIFY = """, rel(line_item, related) as (values ('Net Profit', 'Other Income'), ('Operating Profit', 'Sales'), ('Sales', 'Operating Profit')),
 w as (select *, count(*) over (partition by ticker, line_item order by period_no rows between 2 preceding and 1 following) n from t)
 select q.ticker, q.line_item, q.period, w.qoq_pct, o.qoq_pct related_pct, cast(coalesce(w.n, 0) as int) n_near, w.qoq_pct is not null and abs(w.qoq_pct) > 30 confirmed,
 case when w.n is null then 'quarter not found' when w.qoq_pct is null then 'no base' when abs(w.qoq_pct) > 30 then 'confirmed' else 'below threshold' end reason
 from ({}) q left join w on w.ticker = q.ticker and w.line_item = q.line_item and w.period = q.period left join rel on rel.line_item = q.line_item left join t o on o.ticker = q.ticker and o.line_item = rel.related and o.period = q.period"""


@query("q7_verify_anomaly", _TREND + _VERIFY.format("select distinct ticker, line_item, case when ticker like '%7' then 'Mar 1901' else 'Mar 1998' end period from quarters"))
def q7(s, d):
    """Requests about one quarter of every series."""
    q = quarters(s, d)
    asked = q.select("ticker", "line_item").distinct().select("ticker", "line_item", F.when(F.col("ticker").endswith("7"), "Mar 1901").otherwise("Mar 1998").alias("period"), F.lit(30.0).alias("threshold_pct"))
    return Q.verify_anomaly(Q.quarterly_trends(q), asked)


@query("q8_scan_anomalies", _TREND + _VERIFY.format("select ticker, line_item, period from t where abs(qoq_pct) > 30"))
def q8(s, d):
    """Every sharp change, verified."""
    return Q.scan_anomalies(Q.quarterly_trends(quarters(s, d)))


@query("q9_cross_reference", oracle("facts") + f""", g as (select ticker, period_year, line_item, {R("(value - lag(value) over w) / nullif(abs(lag(value) over w), 0) * 100", 1)} x from facts where line_item in ('Sales', 'Operating Profit') window w as (partition by ticker, line_item order by period_year)),
 j as (select a.ticker, a.period_year, a.x ga, b.x gb, {R("a.x - b.x", 1)} gap from g a join g b using (ticker, period_year) where a.line_item = 'Sales' and b.line_item = 'Operating Profit' and a.x is not null and b.x is not null)
 select ticker, period_year, ga growth_a, gb growth_b, gap gap_pp, abs(gap) > 15 diverging from j""")
def q9(s, d):
    """Growth of sales against growth of operating profit."""
    return Q.cross_reference(facts(s, d), "Sales", "Operating Profit", "profit_loss")


_GAPS = "cast(pat is null or sales is null or sales = 0 as int) + cast(sales is null or assets is null or assets = 0 as int) + cast(assets is null or equity is null or equity = 0 as int) + cast(ocf is null or ebitda is null or ebitda = 0 as int) + cast(ebit is null or interest is null or interest = 0 as int) + cast(inventory is null or cogs is null or cogs = 0 as int)"


@query("q10_gap_ledger", WIDE + f" select ticker, period_year, {_GAPS} n_gaps, interest = 0 zero_interest from wide")
def q10(s, d):
    """Refused ratios of every year."""
    g = Q.wide(facts(s, d)).withColumn("gaps", Q.gap_columns())
    return g.select("ticker", "period_year", F.size("gaps").alias("n_gaps"), F.exists("gaps", lambda x: x["reason"] == "Interest is zero").alias("zero_interest"))


_DUPONT = f", dp as (select ticker, period_year, {SAFE('pat', 'sales')} m, {SAFE('sales', 'assets')} t, {SAFE('assets', 'equity')} x from latest), dq as (select *, {R('m * t * x', 4)} roe, case when m * t * x is not null then case when m > 0.15 then 'margin' when x > 2.5 then 'leverage' else 'turnover' end end driver from dp)"


@query("q11_dupont", WIDE + _DUPONT + " select ticker, period_year, m net_margin, t asset_turnover, x equity_multiplier, roe, driver from dq")
def q11(s, d):
    """Return on equity of the latest year in its three parts."""
    return Q.latest(Q.wide(facts(s, d))).withColumns(Q.dupont_columns()).select("ticker", "period_year", *Q.dupont_columns())


_ROIC = f", ri as (select *, equity + coalesce(debt, 0) - coalesce(cash, 0) ic from latest), rj as (select *, case when ebit is null then 'MISSING' when ic <= 0 then 'UNVERIFIABLE_NEGATIVE' when sales <> 0 and ic < sales * 0.05 then 'UNVERIFIABLE_SMALL' else 'OK' end st from ri), rk as (select *, case when st = 'OK' then {SAFE('ebit * 0.75', 'ic')} end rv from rj)"


@query("q12_roic", WIDE + _ROIC + " select ticker, rv roic, st roic_status, coalesce(rv < 0.12, false) roic_flag from rk")
def q12(s, d):
    """Return on invested capital of the latest year."""
    return Q.latest(Q.wide(facts(s, d))).select("ticker", *[c.alias(k) for k, c in Q.roic_columns().items()])


@query("q13_earnings_quality", WIDE + f" select ticker, {SAFE('ocf', 'ebitda')} ocf_ebitda, {SAFE('ocf - abs(capex)', 'pat')} fcf_pat from latest")
def q13(s, d):
    """Cash behind earnings of the latest year."""
    return Q.latest(Q.wide(facts(s, d))).select("ticker", *[c.alias(k) for k, c in Q.earnings_columns().items()])


_WC = f", wa as (select *, case when cogs > 0 and sales > 0 and inventory <> 0 then {R('inventory / cogs * 365', 1)} end a, case when cogs > 0 and sales > 0 then {R('receivables / sales * 365', 1)} end b, case when cogs > 0 and sales > 0 and payables <> 0 then {R('payables / cogs * 365', 1)} end c from latest), wc as (select *, case when abs(a) <= 3650 then a end dio, case when abs(b) <= 3650 then b end dso, case when abs(c) <= 3650 then c end dpo from wa)"


@query("q14_working_capital", WIDE + _WC + f" select ticker, dio, dso, dpo, {R('dio + dso - dpo', 1)} ccc from wc")
def q14(s, d):
    """Days of working capital of the latest year."""
    return Q.latest(Q.wide(facts(s, d))).select("ticker", *[c.alias(k) for k, c in Q.working_capital_columns().items()])


_RCAGR = f", re as (select ticker, min_by(sales, period_year) a, max_by(sales, period_year) b, count(*) n from wide where sales is not null group by 1), rg as (select ticker, n - 1 as \"years\", {R('(pow(b / a, 1.0e0 / (n - 1)) - 1) * 100', 2)} revenue_cagr_pct from re where n >= 4 and a > 0 and b > 0)"


@query("q15_revenue_cagr", WIDE + _RCAGR + " select * from rg")
def q15(s, d):
    """Growth of sales over the whole history."""
    return Q.revenue_cagr(Q.wide(facts(s, d)))


_LEV = f", lv as (select *, {SAFE('ebit', 'interest')} ic, case when ebitda > 0 then {SAFE('coalesce(debt, 0) - coalesce(cash, 0)', 'ebitda')} end nd from latest)"


@query("q16_leverage", WIDE + _LEV + " select ticker, ic interest_coverage, coalesce(ic < 3, false) coverage_flag, nd net_debt_ebitda from lv")
def q16(s, d):
    """Interest cover and net debt of the latest year."""
    return Q.latest(Q.wide(facts(s, d))).select("ticker", *[c.alias(k) for k, c in Q.leverage_columns().items()])


@query("q17_implied_growth", WIDE + f""", b as (select ticker, sales * 2 mc, ocf - abs(capex) f from latest), it as (select ticker, mc, f, 0 as i, 0.0e0 lo, 0.5e0 hi from b where mc > 0 and f > 0
 union all select ticker, mc, f, i + 1, case when v < mc then (lo + hi) / 2 else lo end, case when v < mc then hi else (lo + hi) / 2 end from (select *, f * (list_sum(list_transform(range(1, 11), lambda t: pow((1 + (lo + hi) / 2) / 1.12e0, t))) + pow((1 + (lo + hi) / 2) / 1.12e0, 10) * 1.05e0 / (0.12e0 - 0.05e0)) v from it) where i < 13)
 select b.ticker, {R("(lo + hi) / 2", 4)} implied_growth from b left join it on it.ticker = b.ticker and i = 13""")
def q17(s, d):
    """Growth that a market value of twice the sales implies."""
    w = Q.latest(Q.wide(facts(s, d))).select("ticker", (F.col("sales") * 2).alias("market_cap"), (F.col("ocf") - F.abs("capex")).alias("fcf"))
    return Q.implied_growth(w)


_QB = f""", qp as (select ticker, period, period_no, max(case when line_item = 'Net Profit' then value end) pat, max(case when line_item = 'Other Income' then value end) oi, max(case when line_item = 'Profit before tax' then value end) pbt from quarters group by 1, 2, 3),
 ql as (select *, lag(pat) over (partition by ticker order by period_no) prev from qp), qk as (select * from ql qualify row_number() over (partition by ticker order by period_no desc) = 1),
 qb as (select ticker, period, case when prev > 0 then {R('(pat - prev) / prev', 4)} end pat_growth, {SAFE('oi', 'pbt')} other_income_share from qk), qf as (select *, coalesce(pat_growth > 0.30, false) or coalesce(other_income_share > 0.15, false) flag from qb)"""


@query("q18_quarterly_bridge", oracle("quarters") + _QB + " select * from qf")
def q18(s, d):
    """Flags of the latest quarter."""
    return Q.quarterly_bridge(quarters(s, d))


_AB = f""", ay as (select ticker, period_year, pat, ocf, lag(pat) over w pat0, lag(ocf) over w ocf0 from wide window w as (partition by ticker order by period_year)), az as (select * from ay qualify row_number() over (partition by ticker order by period_year desc) = 1),
 ag as (select *, (pat - pat0) / pat0 g, coalesce((ocf - ocf0) / nullif(abs(ocf0), 0), 0) o from az where pat <> 0 and pat0 > 0), ab as (select ticker, period_year, {R('g', 4)} pat_growth, {R('o', 4)} ocf_growth, coalesce(g > o + 0.10 or pat > ocf, false) flag from ag where ticker not in (select ticker from qf where flag))"""


@query("q19_annual_bridge", WIDE + ", quarters as (" + QUARTERS + ")" + _QB + _AB + " select * from ab")
def q19(s, d):
    """Flags of the latest year where the quarter raised none."""
    return Q.annual_bridge(Q.wide(facts(s, d)), Q.quarterly_bridge(quarters(s, d)))


@query("q20_scorecard", WIDE + ", quarters as (" + QUARTERS + ")" + _DUPONT + _ROIC + _WC + _RCAGR + _LEV + _QB + _AB + f"""
 select l.ticker, l.period_year, roe, driver, rv roic, st roic_status, {SAFE('l.ocf', 'l.ebitda')} ocf_ebitda, {SAFE('l.ocf - abs(l.capex)', 'l.pat')} fcf_pat, {R('dio + dso - dpo', 1)} ccc, lv.ic interest_coverage, nd net_debt_ebitda, revenue_cagr_pct,
 cast(coalesce(rv < 0.12, false) as int) + cast(coalesce(lv.ic < 3, false) as int) + cast(coalesce(qf.flag, false) as int) + cast(coalesce(ab.flag, false) as int) n_flags, g.n n_gaps, {R('greatest(0.5, 1 - 0.1 * g.n)', 2)} confidence
 from latest l join dq using (ticker) join rk using (ticker) join wc using (ticker) join lv using (ticker) join (select ticker, {_GAPS} n from latest) g using (ticker) left join rg using (ticker) left join qf using (ticker) left join ab using (ticker)""")
def q20(s, d):
    """One row of findings a ticker."""
    return Q.scorecard(facts(s, d), quarters(s, d))


@query("q21_kill_screen", WIDE + f""", a as (select *, row_number() over (partition by ticker order by period_year desc) k, lag(sales) over w s0, lag(ebit) over w e0 from wide window w as (partition by ticker order by period_year)),
 b as (select ticker, cast(substr(ticker, 2) as int) tk, count(sales) yrs, count(pat) npat, count(ocf) nocf, count(*) filter (where k <= 2 and sales < s0) dec, max(case when k = 1 then sales end) sn, max(case when k = 6 then sales end) st, count(*) filter (where k <= 5 and pat < 0) los, count(*) filter (where k <= 5 and pat > 0 and ocf < 0) noc,
 max(case when k = 1 then debt end) debt, max(case when k = 1 then equity end) equity, max(case when k = 1 then ebit end) ebit, max(case when k = 1 then interest end) interest,
 count(*) filter (where k <= 2 and case when sales > 0 then ebit / sales end < case when s0 > 0 then e0 / s0 end) mf from a group by 1),
 c as (select *, case when tk % 4 <> 0 then tk % 45 end pl, tk % 70 ph, case when st > 0 and sn > 0 then (pow(sn / st, 0.2e0) - 1) * 100 end g, case when equity > 0 and debt > 0 then debt / equity end de, case when interest > 0 then ebit / interest end ic from b),
 e as (select *, array_to_string(list_filter([case when yrs >= 3 and dec >= 2 then 'revenue_decline' end, case when los >= 3 then 'losses' end, case when noc >= 3 then 'no_cash' end, case when de > 3 then 'debt' end, case when ic < 1.5 then 'coverage' end, case when pl > 30 then 'pledge' end], lambda x: x is not null), ',') kr,
 array_to_string(list_filter([case when g < 5 then 'slow_growth' end, case when los = 2 then 'losses' end, case when noc = 2 then 'no_cash' end, case when de > 1.5 and de <= 3 then 'debt' end, case when ic >= 1.5 and ic < 3 then 'coverage' end, case when pl > 15 and pl <= 30 then 'pledge' end, case when ph < 25 then 'promoter' end, case when mf >= 2 then 'margin' end], lambda x: x is not null), ',') wr,
 array_to_string(list_filter([case when yrs < 3 then 'revenue' end, case when npat = 0 or nocf = 0 then 'cash_flow' end, case when de is null then 'debt' end, case when pl is null then 'pledge' end], lambda x: x is not null), ',') gp from c)
 select ticker, kr = '' passed, kr kill_reasons, wr warnings, gp gaps, {R("g", 1)} revenue_cagr_5y, {R("de", 2)} debt_equity, {R("ic", 1)} interest_cover from e""")
def q21(s, d):
    """Eight rules that stop or warn."""
    rows = facts(s, d)
    k = F.substring("ticker", 2, 20).cast("int")
    holdings = rows.select("ticker").distinct().select("ticker", F.when(k % 4 != 0, k % 45).cast("double").alias("pledge"), (k % 70).cast("double").alias("promoter"))
    return Q.kill_screen(Q.wide(rows), holdings)


@query("q22_projection", WIDE + f""", c("case", growth, margin, tax) as (values ('bear', 0.05e0, 0.10e0, 0.25e0), ('base', 0.10e0, 0.15e0, 0.25e0), ('bull', 0.18e0, 0.2e0, 0.25e0)),
 it as (select ticker, "case", growth, margin, tax, 0 as i, sales rev, interest, depreciation, pat, eps from latest, c union all select ticker, "case", growth, margin, tax, i + 1, round_even(rev * (1 + growth), 0), interest, depreciation, pat, eps from it where i < 3),
 x as (select *, round_even(rev * margin, 0) ebitda from it where i > 0), y as (select *, ebitda - round_even(interest, 0) - round_even(depreciation, 0) pbt, nullif(round_even(pat / nullif(eps, 0), 0), 0) sh from x), z as (select *, round_even(pbt * (1 - tax), 0) profit from y), w as (select *, {R("profit / sh", 2)} e from z)
 select ticker, "case", i year_no, rev revenue, ebitda, pbt, profit, e eps, {R("e * 15", 0)} price from w""")
def q22(s, d):
    """Three cases over three years."""
    cases = s.createDataFrame([("bear", 0.05, 0.10, 0.25), ("base", 0.10, 0.15, 0.25), ("bull", 0.18, 0.2, 0.25)], "case string, growth double, margin double, tax double")
    base = Q.latest(Q.wide(facts(s, d))).select("ticker", "sales", "interest", "depreciation", "pat", "eps", F.lit(15.0).alias("pe"))
    return Q.project(base, cases)


_EPS = ", ep as (select ticker, period_year, value eps from facts where line_item = 'EPS in Rs'), px as (select ticker, period_year, max_by(close_px, dt) price from (select f.ticker, f.period_year, p.dt, p.close_px from (select distinct ticker, period_year from facts) f join prices p on p.ticker = f.ticker and p.dt between make_date(f.period_year, 3, 31) - 35 and make_date(f.period_year, 3, 31)) group by 1, 2), ph as (select ticker, period_year, eps, price, " + R("price / eps", 2) + " pe from ep join px using (ticker, period_year) where eps > 0 and price > 0)"


def _pe(s, d):
    from ledgerloom.operators.prices import year_end_price

    eps = facts(s, d).where("line_item = 'EPS in Rs'").select("ticker", "period_year", F.col("value").alias("eps"))
    px = year_end_price(relation(s, d, "prices"), eps.select("ticker", "period_year").distinct()).where("price is not null")
    return Q.pe_history(eps, px)


@query("q24_pe_history", oracle("facts", "prices") + _EPS + " select * from ph")
def q24(s, d):
    """PE of every year."""
    return _pe(s, d)


@query("q23_future_pe", oracle("facts", "prices") + _EPS + f""", l as (select *, lag(eps) over (partition by ticker order by period_year) e0, row_number() over (partition by ticker order by period_year desc) k from ph),
 o as (select ticker, median(pe) base, max(case when k = 1 then eps end) now, max(case when k = 4 then eps end) thn, avg(case when eps > 0 and e0 > 0 then ln(eps / e0) end) logs from l group by 1),
 t as (select *, coalesce(case when now > 0 and thn > 0 then pow(now / thn, 1.0e0 / 3) - 1 end, exp(logs) - 1, 0) tr, base * (1 + (case cast(substr(ticker, 2) as int) % 3 when 0 then 1.2e0 when 1 then 1.0e0 else 0.6e0 end) * (0.1e0 - coalesce(case when now > 0 and thn > 0 then pow(now / thn, 1.0e0 / 3) - 1 end, exp(logs) - 1, 0))) raw from o),
 u as (select *, greatest(least(raw, base * 1.3), base * 0.7) c1 from t) select ticker, {R("base", 2)} base_pe, {R("tr", 4)} trailing_cagr, {R("greatest(least(c1, 20e0 * 1.3), 20e0 * 0.7)", 2)} future_pe from u""")
def q23(s, d):
    """The PE to expect."""
    h = _pe(s, d).select("ticker", "period_year", "pe", "eps")
    size = F.element_at(F.array(F.lit("small"), F.lit("mid"), F.lit("large")), (F.substring("ticker", 2, 9).cast("int") % 3 + 1))
    return Q.future_pe(h, h.select("ticker").distinct().select("ticker", F.lit(0.1).alias("cagr"), F.lit(20.0).alias("sector_pe"), size.alias("size")))


@query("q25_size_class", "select p_partkey k, case when p_retailprice * p_partkey * 1e5 / 1e7 < 5000 then 'small' when p_retailprice * p_partkey * 1e5 / 1e7 <= 20000 then 'mid' else 'large' end size from part where p_retailprice > 0 and p_partkey > 0")
def q25(s, d):
    """Size classes."""
    return table(s, d, "part").where("p_retailprice > 0 and p_partkey > 0").select(F.col("p_partkey").alias("k"), Q.size_class(F.col("p_retailprice"), F.col("p_partkey") * 1e5).alias("size"))


@query("q26_cash_grade", WIDE + f""", c as (select ticker, {SAFE('ocf', 'ebitda')} x, cast(substr(ticker, 2) as int) % 4 k from latest), e as (select *, least(cast(floor(x * 100 + 0.5) as int), 100) p from c)
 select ticker, x ratio, case when x >= 0.8 then 'A' when x >= 0.5 then 'B' when x is not null then 'C' end grade, case when x is not null then p end pct,
 case when x is null then null when p >= 80 then 'STRONG' when p >= 50 then 'MODERATE' else 'WEAK' end strength, case k when 0 then 'add' when 1 then 'sell' when 2 then 'hold' end as "action" from e""")
def q26(s, d):
    """Letter grades of cash quality, capped percents and what a recommendation asks for."""
    rows = Q.latest(Q.wide(facts(s, d))).select("ticker", Q.earnings_columns()["ocf_ebitda"].alias("ratio"))
    pct, strength = Q.cash_strength(F.col("ratio"))
    k = F.substring("ticker", 2, 20).cast("int") % 4
    said = F.when(k == 0, "Add on dips").when(k == 1, "exit").when(k == 2, "Neutral").otherwise(" ")
    return rows.select("ticker", "ratio", Q.cash_grade(F.col("ratio")).alias("grade"), pct.alias("pct"), strength.alias("strength"), labels.action_bucket(said).alias("action"))


@query("q27_holdings_trend", oracle("quarters") + f""", h as (select ticker, period, period_no, {R("value / 1000", 2)} pct from quarters where line_item = 'Sales' and ticker not like '%5'), o as (select ticker, period, pct, {R("pct - lag(pct) over (partition by ticker order by period_no)", 2)} as change, 'OK' status from h)
 select * from o union all select distinct ticker, null, null, null, 'DATA_NOT_AVAILABLE' from quarters where ticker like '%5'""")
def q27(s, d):
    """A holder's share each quarter."""
    holder = F.when((F.col("line_item") == "Sales") & ~F.col("ticker").endswith("5"), "Promoters").otherwise("Public")
    return Q.holdings_trend(quarters(s, d).select("ticker", "period", "period_no", holder.alias("holder"), exprs.r(F.col("value") / 1000, 2).alias("pct")))


@query("q28_with_fallback", oracle("facts") + """, v as (select distinct ticker, cast(substr(ticker, 2) as int) k from facts), l as (select ticker, 'live ' || ticker p from v where k % 4 <> 0), o as (select ticker, 'old ' || ticker p, timestamp '2024-01-01' t from v where k % 3 <> 0)
 select coalesce(l.ticker, o.ticker) ticker, coalesce(l.p, o.p) payload, l.p is null stale, case when l.p is null then t end saved_at from l full join o on l.ticker = o.ticker""")
def q28(s, d):
    """Live tables, else the last snapshot."""
    v = facts(s, d).select("ticker").distinct().withColumn("k", F.substring("ticker", 2, 9).cast("int"))
    live = v.where("k % 4 <> 0").select("ticker", F.concat(F.lit("live "), "ticker").alias("payload"))
    return Q.with_fallback(live, v.where("k % 3 <> 0").select("ticker", F.concat(F.lit("old "), "ticker").alias("payload"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("saved_at")))
